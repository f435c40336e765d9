"""The engine: files and history in, ranked maps, searches and graphs out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from waymark.config import DEFAULT, HIGH, LOW, MEDIUM, Config
from waymark.functions import scoring
from waymark.operators import context, export, extract, factorised, graph, history, packing, statistics, views
from waymark.plans.tuner import TunerState, configured, overrides
from waymark.session import durable


@dataclass
class Engine:
    """Ranked maps of ``files(path, rel, text)``, optionally with ``history``.

    Tags may be given instead of being extracted.  ``now`` is a parameter:
    nothing reads the clock.  Results of a request are kept under its arguments
    (S15) until ``refresh``.
    """

    files: DataFrame | None = None
    tags: DataFrame | None = None
    history: DataFrame | None = None
    now: Column | None = None
    config: Config = DEFAULT
    symbol_rank: bool = True
    git_weight: bool = False
    exclude_unranked: bool = False
    #: Whether maps show bridges, phases, badges and change mates.
    marks: bool = False
    count_tokens: Callable[[str], int] = lambda s: -(-len(s) // 4)
    max_context_window: int | None = None
    iterations: int | None = None
    _known: dict = field(default_factory=dict, repr=False)

    @classmethod
    def tuned(cls, state: TunerState, **inputs: object) -> Engine:
        changes = overrides(state)
        flags = {k: changes[k] for k in ("symbol_rank", "git_weight", "exclude_unranked") if k in changes}
        return cls(config=configured(state), **flags, **inputs)

    def all_tags(self) -> DataFrame:
        if self.tags is None:
            self.tags = durable(extract.tags(self.files))
        return self.tags

    def symbol_edges(self) -> DataFrame:
        if "edges" not in self._known:
            self._known["edges"] = durable(graph.symbol_edges(self.all_tags()))
        return self._known["edges"]

    def ranks(self) -> tuple[DataFrame, DataFrame | None]:
        """File ranks and, in symbol mode, symbol ranks; by way of names, so that no table of edges is needed for them."""
        if "ranks" not in self._known:
            if self.symbol_rank:
                symbols = durable(factorised.symbol_pagerank(factorised.symbol_factors(self.all_tags()), iterations=self.iterations, config=self.config))
                self._known["ranks"] = durable(graph.file_ranks(symbols)), symbols
            else:
                nodes = self.all_tags().select(F.col("rel_fname").alias("id")).distinct()
                ranked = factorised.pagerank(graph.personalization(nodes, F.col("id"), config=self.config), factorised.file_factors(self.all_tags()), iterations=self.iterations, config=self.config)
                self._known["ranks"] = durable(ranked.select(F.col("id").alias("file"), F.col("rank").alias("file_rank"))), None
        return self._known["ranks"]

    def ranked(self, focus: list[str] | None = None, mentioned_files: list[str] | None = None, mentioned_idents: list[str] | None = None, query: str = "") -> DataFrame:
        """Entry A8 to A13: tags with ``rank``."""
        tags, focus = self.all_tags(), focus or []
        spark = tags.sparkSession
        one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
        focus_files, focus_names = context.resolve_focus(tags, focus)
        idents = one(mentioned_idents or [], "name").unionByName(focus_names).distinct()
        files = one(mentioned_files or [], "file")
        recipe = scoring.RECIPES[spark.range(1).select(scoring.intent(F.lit(" ".join([*focus, query]))).alias("i")).first()["i"]]
        weights = mates = callers = None
        if self.history is not None and self.git_weight:
            weights = history.file_weights(history.file_stats(history.horizon(self.history, self.config.max_commits)), self.now, recency=recipe[0], churn=recipe[1], config=self.config)
        if self.history is not None and focus:
            mates = history.mates(focus_files, history.coupling(self.history.select("commit_id", "file"), config=self.config))
        if recipe[2] > 1 and focus:
            named = tags.where("kind = 'def'").join(focus_names, "name", "left_semi").select(F.col("rel_fname").alias("file"), F.col("name").alias("symbol")).distinct()
            callers = durable(graph.callers(self.symbol_edges(), named))
            files = files.unionByName(callers).distinct()
        file_ranks, symbol_ranks = self.ranks()
        none = one([], "file")
        return context.boosted(tags.where("kind = 'def'"), file_ranks, symbol_ranks, idents=idents, files=files, focus=focus_files, mates=none if mates is None else mates, weights=weights, caller_files=callers, bias=recipe[2], exclude_unranked=self.exclude_unranked, config=self.config)

    def orphans(self) -> tuple[int, int]:
        """Symbols of the graph, and how many of them nothing refers to."""
        if "orphans" not in self._known:
            factors = factorised.symbol_factors(self.all_tags())
            got = factorised.degrees(factorised.vertices(factors), factors).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("in_degree") == 0).alias("o")).first()
            self._known["orphans"] = got["n"], got["o"]
        return self._known["orphans"]

    def confidence(self, ranked: DataFrame) -> Row:
        symbols, orphans = self.orphans() if self.symbol_rank else (0, 0)
        return statistics.confidence(ranked, orphans=orphans, symbols=symbols, config=self.config).first()

    def marked(self, rows: DataFrame, focus: list[str] | None = None) -> DataFrame:
        """Ranked tags with the marks of their files; change mates of focus files only."""
        found = graph.bridges(graph.collapse(self.symbol_edges()), config=self.config)
        if self.history is None:
            return views.annotate(rows, bridges=found)
        stats = durable(history.file_stats(history.horizon(self.history, self.config.max_commits)))
        mates = None
        if focus:
            files, _ = context.resolve_focus(self.all_tags(), focus)
            lists = history.coupling_lists(files, history.coupling(self.history.select("commit_id", "file"), config=self.config))
            mates = lists.select("file", F.slice("mates", 1, self.config.coupling_mates).alias("mates")).where("size(mates) > 0")
        return views.annotate(rows, bridges=found, phases=history.file_phases(stats, self.now, self.config), badges=history.file_badges(stats, self.now, self.config), mates=mates)

    def stats(self, tree: bool = False) -> list[str]:
        """The statistics listing, flat by rank or as a tree."""
        sizes = durable(views.file_sizes(self.files.withColumn("rel", F.coalesce("rel", "path")), self.all_tags()))
        if tree:
            return [r["line"] for r in views.stats_tree(sizes).collect()]
        ranks = self.ranks()[0].select(F.col("file").alias("rel_fname"), F.col("file_rank").alias("max_rank"))
        return [r["line"] for r in views.stats_lines(sizes, ranks, self.config).collect()]

    def map(self, focus: list[str] | None = None, *, budget: int | None = None, refresh: bool = False, adaptive: bool = False, **mentioned: list[str]) -> str | None:
        """Entry A: the rendered map, None where there is nothing to show."""
        key = (tuple(focus or ()), budget, adaptive, tuple(sorted((k, tuple(v)) for k, v in mentioned.items())))
        if refresh:
            self._known.clear()
        if key in self._known:
            return self._known[key]
        limit = scoring.effective_budget(budget or self.config.map_tokens, self.max_context_window, bool(focus), self.config)
        if limit <= 0:
            return None
        rows = durable(self.ranked(focus, **mentioned))
        sure = self.confidence(rows)
        if adaptive and (sure["level"] == "low" or {"fragmented", "sparse", "diffuse"} & set(sure["patterns"])):
            found = views.clusters(rows, config=self.config).collect()
            # without clusters of some size the best rows stand in
            self._known[key] = views.render_clusters(found) if found else views.render_flat(rows.orderBy(*context.by_rank()).limit(self.config.flat_tags).collect())
            return self._known[key]
        if self.marks:
            rows = self.marked(rows, focus)
        # types are shown where a file's classes come first, as the directory has them
        rows = views.with_fresh(rows, F.col("rel_fname"), F.col("parent_name").isNull(), *context.by_rank())
        for detail in (LOW, MEDIUM, HIGH):
            rows = views.rendered(rows, F.lit(detail)).withColumnRenamed("shown", f"shown_{detail}")
        sized = durable(packing.sizes(rows, *context.by_rank()))
        guess = packing.guesses(sized, limit)
        # a tag costs a token at least, so the budget bounds what can be shown; mostly a little more than guessed is enough
        wanted = min(limit, 2 * max(guess.values()) + 64)
        while True:
            head = sized.where(F.col("place") < wanted).orderBy("place").collect()
            if not head:
                return None
            try:
                tags, _, text, tokens = packing.pack(head, limit, views.render_directory, self.count_tokens, self.config, guess)
            except ValueError:
                text = views.render_directory(head[:10], LOW)
                tags, tokens = min(10, len(head)), self.count_tokens(text)
            if wanted == limit or len(head) < wanted or all(self.count_tokens(views.render_directory(head, d)) > limit for d in (LOW, MEDIUM, HIGH)):
                break
            wanted = limit
        lead = views.header_line(sure["level"], sure["patterns"], tokens, limit, tags)
        self._known[key] = f"{lead}\n\n{text}" if lead else text
        return self._known[key]

    def search(self, query: str, *, context_lines: int = 2, **options: object) -> DataFrame:
        """Entry B."""
        return context.search_context(context.search(self.all_tags(), query, **options), self.files, context_lines)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Entry C: nodes and links."""
        edges = self.symbol_edges()
        symbols = self.ranks()[1]
        found = graph.bridges(graph.collapse(edges), 10, config=self.config)
        return export.nodes(symbols, edges, bridges=found, api=graph.surface(edges, self.config)), export.links(edges)

    def report(self) -> DataFrame:
        return export.report(self.all_tags())
