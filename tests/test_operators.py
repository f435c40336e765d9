"""Closed forms and behaviours of ranking, history, statistics and views."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.config import DEFAULT, HIGH, LOW, MEDIUM
from waymark.functions import paths, scoring, text
from waymark.operators import context, export, extract, graph, history, ordering, packing, statistics, views
from waymark.plans.engine import Engine
from waymark.plans.tuner import PRESETS, TunerState, configured, overrides
from waymark.schema import FIELD, SIGNATURE, TAG


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")


def even(spark, ids):
    return spark.createDataFrame([(i, 1.0) for i in ids], "id string, weight double")


def test_pagerank_closed_forms(spark):
    both = {r.id: r["rank"] for r in graph.pagerank(even(spark, "ab"), edges(spark, ("a", "b"), ("b", "a"))).collect()}
    assert both == pytest.approx({"a": 0.5, "b": 0.5})
    one = {r.id: r["rank"] for r in graph.pagerank(even(spark, "ab"), edges(spark, ("a", "b"))).collect()}
    assert sum(one.values()) == pytest.approx(1, abs=1e-5)
    assert one["b"] / one["a"] == pytest.approx(1.85, abs=1e-3)
    assert graph.pagerank(even(spark, "ab").where("false"), edges(spark, ("a", "b")).where("false")).count() == 0


def between(spark, pairs, **options):
    return {r.id: r.betweenness for r in graph.betweenness(edges(spark, *pairs), **options).collect()}


def brute_betweenness(pairs):
    """All shortest paths, written out."""
    nodes, total = sorted({x for p in pairs for x in p}), {}
    for source in nodes:
        paths_, done = {source: [[source]]}, {source}
        level = [source]
        while level:
            reached = {}
            for v in level:
                for w in {b for a, b in pairs if a == v} - done:
                    reached.setdefault(w, []).extend(p + [w] for p in paths_[v])
            paths_ |= reached
            done |= set(reached)
            level = list(reached)
        for target, ways in paths_.items():
            for way in ways if target != source else ():
                for v in way[1:-1]:
                    total[v] = total.get(v, 0.0) + 1 / len(ways)
    n = len(nodes)
    return {v: total.get(v, 0.0) / ((n - 1) * (n - 2)) for v in nodes}


def test_betweenness(spark):
    chain = between(spark, [("a", "b"), ("b", "c")])
    assert chain["b"] == pytest.approx(0.5) and chain["a"] == chain["c"] == 0
    star = [(x, "center") for x in "abcde"] + [("center", x) for x in "abcde"]
    assert max(between(spark, star).items(), key=lambda x: x[1]) == ("center", pytest.approx(1.0))
    triangles = [(a, b) for t in (("a1", "a2", "a3"), ("b1", "b2", "b3")) for a in t for b in t if a != b]
    joined = triangles + [(x, "bridge") for x in ("a1", "a2", "a3", "b1", "b2", "b3")] + [("bridge", x) for x in ("a1", "a2", "a3", "b1", "b2", "b3")]
    found = between(spark, joined)
    assert max(found, key=found.get) == "bridge" and found == pytest.approx(brute_betweenness(joined))
    assert between(spark, []) == {}
    top = graph.bridges(edges(spark, ("a", "b"), ("b", "c"))).collect()
    assert [(r.id, sorted(r.connects)) for r in top] == [("b", ["a", "c"])]


def test_symbol_edges_multiply_duplicates(spark):
    rows = [("m.py", "f", "def", None), ("m.py", "f", "def", None), ("x.py", "C", "def", None), ("x.py", "f", "ref", "C"), ("x.py", "f", "ref", "C"), ("x.py", "f", "ref", None), ("x.py", "f", "ref", "unknown")]
    got = graph.symbol_edges(spark.createDataFrame(rows, "rel_fname string, name string, kind string, parent_name string")).collect()
    assert [(r.src_file, r.src_sym, r.dst_file, r.dst_sym, r.n) for r in got] == [("x.py", "C", "m.py", "f", 4)]


def test_surface(spark):
    def label(*calls):
        rows = spark.createDataFrame([(a, b, c, d, 1) for a, b, c, d in calls], "src_file string, src_sym string, dst_file string, dst_sym string, n long")
        return [(r.label, r.external, r.internal) for r in graph.surface(rows).collect()]

    assert label() == []
    assert label(("other.py", "caller", "main.py", "f")) == [("api", 1, 0)]
    assert label(("main.py", "main", "main.py", "helper")) == [("internal", 0, 1)]
    assert label(("o", "a", "m", "f"), ("o", "b", "m", "f"), ("o", "c", "m", "f"), ("m", "x", "m", "f")) == [("api", 3, 1)]


def ranks(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "rank double")


@pytest.mark.parametrize(("values", "level", "pattern"), [([], "low", "insufficient_data"), ([0.1] * 20, "low", "diffuse"), ([1.0] + [0.001] * 20, "high", None)])
def test_confidence(spark, values, level, pattern):
    got = statistics.confidence(ranks(spark, values)).first()
    assert got.level == level
    assert pattern in got.patterns if pattern else got.gini > 0.5


def test_statistics(spark):
    first = lambda df: df.first()[-1]
    assert first(statistics.gini(ranks(spark, [3, 3, 3]))) == pytest.approx(0)
    assert first(statistics.gini(ranks(spark, [0, 0, 1]))) == pytest.approx(2 / 3)
    assert first(statistics.gini(ranks(spark, [0, 0]))) == 0
    assert first(statistics.entropy(ranks(spark, [2, 2, 2, 2]))) == pytest.approx(2)
    assert tuple(statistics.percentiles(ranks(spark, range(1, 11)), (50, 90)).first()) == (6, 10)
    assert first(statistics.upper_median(ranks(spark, [1, 2, 3, 4]), "rank")) == 3
    assert first(statistics.upper_median(ranks(spark, []), "rank")) == 5
    assert first(statistics.cliff(ranks(spark, [1] * 9 + [0.1]))) == 90
    assert first(statistics.cliff(ranks(spark, [1, 0.1]))) is None


def test_placed_runs_over_partitions(spark):
    rows = spark.range(1000).repartition(7)
    got = ordering.placed(rows, F.desc("id"), value=F.col("id").cast("double")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and {r.total for r in got} == {1000}
    assert [r.id for r in got] == list(range(999, -1, -1))
    assert got[-1].running == sum(range(1000)) and got[1].running == 999 + 998


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_factors(spark):
    day = lambda n: value(spark, scoring.recency_factor(F.lit(n)))
    assert day(0) == 2 and day(30) == pytest.approx(1 + math.exp(-1))
    churn = lambda n: value(spark, scoring.churn_factor(F.lit(n)))
    assert churn(5) == 1 and churn(6) == pytest.approx(1 + math.log(2) * 0.1) and churn(10**6) == 1.5
    for factor, scale, want in ((1.5, 1, 1.5), (2, 0, 1), (1.5, 2, 2), (2, 0.5, 1.5)):
        assert value(spark, scoring.scaled(F.lit(float(factor)), scale)) == want
    assert value(spark, scoring.git_weight(F.lit(None).cast("long"), F.lit(None).cast("long"))) == 1
    assert scoring.effective_budget(100, None, False) == 100
    assert scoring.effective_budget(100, 1500, False) == 476
    assert scoring.effective_budget(100, 9999, True) == 100


@pytest.mark.parametrize(("words", "want"), [("", "explore"), ("fix this error", "debug"), ("handle the exception", "debug"), ("debug this issue", "debug"), ("refactor this module", "refactor"), ("add new feature", "extend")])
def test_intent(spark, words, want):
    assert value(spark, scoring.intent(F.lit(words))) == want


def test_recipes():
    r = scoring.RECIPES
    assert r["debug"][2] > 1 and r["refactor"][1] > 1 and r["extend"][1] < 1 and r["explore"][1:] == (1, 1)


def signature(spark, parameters, result=None, raw=None):
    return spark.createDataFrame([(([{"name": n, "type": t} for n, t in parameters], result, [], raw),)], "s " + SIGNATURE.simpleString())


def test_rendering(spark):
    shown = lambda df, detail: df.select(text.render_signature(F.col("s"), F.lit(detail)).alias("v")).first().v
    short = signature(spark, [("self", None), ("x", "int")], "bool")
    assert shown(short, LOW) == "..."
    wide = signature(spark, [("self", None), ("x", "int"), ("y", "str")], "bool")
    assert shown(wide, MEDIUM) == "(self, x, y)" and shown(wide, HIGH) == "(self, x: int, y: str) -> bool"
    field = lambda name, kind, detail: spark.createDataFrame([((name, kind, None),)], "f " + FIELD.simpleString()).select(text.render_field(F.col("f"), F.lit(detail)).alias("v")).first().v
    assert field("counter", "int", LOW) == "counter"
    assert field("callback", "Callable[[int], str]", MEDIUM) == "callback: Callable"
    assert field("callback", "Callable[[int], str]", HIGH) == "callback: Callable[[int], str]"


def test_first_types(spark):
    got = views.first_types(spark.createDataFrame([("a", "x:int", 1), ("a", "x:int", 2)], "file string, pattern string, seq int")).orderBy("seq").collect()
    assert [r.first for r in got] == [True, False]


def test_history(spark):
    now = datetime(2024, 3, 1)
    rows = [(str(i), now - timedelta(days=d), a, f) for i, (d, a, f) in enumerate([(0, "x", "hot"), (1, "x", "hot"), (400, "y", "old"), (5, "y", "new"), (6, "y", "hot")] + [(k, "z", "hot") for k in range(8, 18)])]
    h = spark.createDataFrame(rows, "commit_id string, ts timestamp, author string, file string")
    stats = history.file_stats(h)
    phase = {r.file: r.phase for r in history.file_phases(stats, F.lit(now)).collect()}
    assert phase == {"hot": "emergent", "old": "crystal", "new": "emergent"}
    badges = {r.file: r.badges for r in history.file_badges(stats, F.lit(now)).collect()}
    assert badges == {"hot": ["recent", "high-churn"], "old": [], "new": ["recent"]}
    story = {r.file: r for r in history.stories(h).collect()}["hot"]
    assert story.commits == 13 and story.primary_author == "z" and len(story.recent) == 10 and story.recent[0].commit_id == "0"


def test_coupling(spark):
    t = spark.createDataFrame([(c, f) for f, cs in (("a", "123"), ("b", "234"), ("c", "9")) for c in cs], "commit_id string, file string")
    pairs = history.coupling(t)
    assert [(r.a, r.b, r.together, r.score) for r in pairs.collect()] == [("a", "b", 2, 0.5)]
    lists = {r.file: [(m.mate, m.score) for m in r.mates] for r in history.coupling_lists(t.select("file").distinct(), pairs).collect()}
    assert lists == {"a": [("b", 0.5)], "b": [("a", 0.5)], "c": []}
    assert [r.file for r in history.mates(spark.createDataFrame([("a",)], "file string"), pairs).collect()] == ["b"]


CODE = "import os\n\ndef hello(name: str) -> str:\n    return name\n\nclass Greeter:\n    def greet(self):\n        def run():\n            return hello('x')\n        return run()\n"


def sources(spark, *rows):
    return spark.createDataFrame([(f"/r/{p}", p, t) for p, t in rows], "path string, rel string, text string")


def test_extraction(spark):
    got = extract.tags(sources(spark, ("test.py", CODE), ("empty.py", ""), ("bad.py", "def ("))).collect()
    defs = {(r.name, r.node_type, r.parent_name) for r in got if r.kind == "def"}
    assert defs == {("hello", "function", None), ("Greeter", "class", None), ("greet", "function", "Greeter"), ("run", "function", "greet")}
    assert {(r.name, r.parent_name) for r in got if r.kind == "ref"} == {("hello", "greet"), ("run", "Greeter")}
    assert next(r for r in got if r.name == "hello" and r.kind == "def").signature.return_type == "str"
    assert {(r.name, r.parent_name) for r in extract.tags(sources(spark, ("t.py", CODE)), enclosing=True).where("kind='ref'").collect()} == {("hello", "run"), ("run", "greet")}


def test_markdown():
    six = "\n".join("#" * i + f" T{i} ##" for i in range(1, 7))
    assert [(t["node_type"], t["name"]) for t in extract.markdown_tags(six)] == [(f"h{i}", f"T{i}") for i in range(1, 7)]
    assert extract.markdown_tags("") == [] == extract.markdown_tags("plain\ntext")
    fenced = "# A\n```\n# no\n```\n~~~\n## no\n~~~\n## B\n"
    assert [(t["name"], t["parent_name"]) for t in extract.markdown_tags(fenced)] == [("A", None), ("B", "A")]
    nested = extract.markdown_tags("# A\n## B\n### C\n## D\n# E\n### F\n")
    assert [t["parent_name"] for t in nested] == [None, "A", "B", "A", None, "E"]
    shown = extract.markdown_tags("# A\n" + "word " * 60)[0]["signature"]["raw"]
    assert "[...]" in shown and len(shown) <= 90
    assert extract.markdown_tags("# A\n```\ncode\n```\n# B")[0]["signature"] is None
    assert extract.markdown_tags("# A\n**bold** `code` [t](u) text")[0]["signature"]["raw"] == "bold code t text"


def modules(n):
    return [(f"module{i}.py", f"def f{i}_a(x):\n    return f{(i + 1) % n}_b(x)\n\ndef f{i}_b(y):\n    return y\n\nclass C{i}:\n    def one(self):\n        def inner():\n            return f{(i + 1) % n}_a(1)\n        return inner\n    def two(self):\n        return 2\n") for i in range(n)]


def test_engine(spark, tmp_path):
    engine = Engine(files=sources(spark, *modules(6)), iterations=10)
    whole, small = engine.map(budget=5000), engine.map(budget=60)
    assert "class C1" in whole and "f3_a" in whole and len(whole) > len(small) and engine.count_tokens(small) < 110
    assert engine.map(budget=5000) == whole
    assert "module3.py" in engine.map(["module3.py"], budget=60)
    assert engine.report().first().definition_matches == 6 * 6
    hits = engine.search("F2_A").collect()
    assert hits[0].kind == "def" and "def f2_a" in hits[0].context
    nodes, links = engine.graph()
    assert nodes.count() == 12 and links.count() == 6
    assert {r.is_api for r in nodes.where("symbol like 'f%'").collect()} == {True}
    export.write_graph(nodes, links, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/nodes")).count() == 12
    assert Engine(files=sources(spark, ("empty.py", "")), iterations=2).map() is None


def test_focus(spark):
    tags = spark.createDataFrame([("a.py", "/a.py", 1, "AuthHandler", "def"), ("b.py", "/b.py", 1, "parse_user_name", "def"), ("c.py", "/c.py", 1, "other", "ref")], "rel_fname string, fname string, line int, name string, kind string")
    files = lambda *t: sorted(r.file for r in context.resolve_focus(tags, list(t))[0].collect())
    assert files("auth") == ["a.py"] and files("user name") == ["b.py"] and files("c.py") == ["c.py"] and files("other") == [] and files("") == []


def test_packing():
    rows = ["x" * n for n in (10, 10, 10)]
    render = lambda head, detail: "".join(r * detail for r in head)
    tags, detail, out, size = packing.pack(rows, 40, render, len)
    assert (tags, detail, size) == (3, LOW, 30)
    assert packing.pack(rows, 95, render, len)[:2] == (3, HIGH)
    with pytest.raises(ValueError, match="budget"):
        packing.pack(rows, 5, render, len)


def test_tree_views(spark):
    sizes = spark.createDataFrame([("src/a.py", 10, 2), ("src/sub/b.py", 5, 1), ("z.py", 1, 0)], "path string, loc long, defs long")
    assert [r.line for r in views.stats_tree(sizes).collect()] == ["src/ 2 files; 15 loc; 3 def", "  sub/ 1 files; 5 loc; 1 def", "    b.py 5 loc; 1 def", "  a.py 10 loc; 2 def", "z.py 1 loc; 0 def"]
    files = sources(spark, ("t.py", CODE))
    lines = views.tree_lines(files, extract.tags(files).where("kind='def'")).collect()
    assert lines[0].code == "def hello(name: str) -> str"
    depth = {r.line: r.depth for r in views.depths(extract.tags(files)).collect()}
    assert depth[3] == 0 and depth[7] == 1 and depth[8] == 2
    assert [r.methods for r in views.methods_of(extract.tags(files)).collect()] == [["greet"]]


def test_paths(spark):
    got = {p: value(spark, paths.depth_weight(F.lit(p))) for p in ("a.py", "a/b/c/d.py", "a/b/c/d/e/f.py", "x/vendor/y.py")}
    assert list(got.values()) == [1.0, 0.5, 0.1, 0.01]
    assert value(spark, paths.cluster_key(F.lit("pkg/src/core/util/x.py"))) == "core/util"
    assert value(spark, paths.cluster_key(F.lit("x.py"))) == "(root)"
    assert value(spark, paths.prefixes(F.lit("a/b/c.py"))) == [".", "a", "a/b"]


def test_tuner():
    state = TunerState.preset("debug")
    assert TunerState.from_json(state.to_json()) == state and state.warnings() == []
    changed = overrides(state)
    assert changed["git_weight"] and changed["recency_max"] == 3.0 and changed["boost_focus"] == 30.0
    assert configured(state).weight_deep == 0.25 and DEFAULT.weight_deep == 0.1
    assert TunerState({"nope": {}}).warnings() and len(PRESETS) == 5
    assert "churn_max" not in overrides(TunerState({"git_churn": {"enabled": False, "max_boost": 9}}))


def test_schema_fits_tags(spark):
    assert extract.tags(sources(spark, ("t.py", CODE))).schema == TAG


def test_important_files(spark):
    names = ["CHANGELOG.md", "a/go.sum", "docs/x.rst", "a/docs/x.rst", "docs/a/x.txt", ".github/workflows/ci.yml", "a/.github/workflows/ci.yml", ".github/notes.md", ".github/x/notes.md", ".env", "x.py"]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path for r in rows.where(paths.is_important(F.col("path"))).collect()}
    assert got == {"CHANGELOG.md", "a/go.sum", "docs/x.rst", ".github/workflows/ci.yml", ".github/notes.md", ".env"}


def test_deep_expressions():
    """Nesting that the parser takes but calls could not follow."""
    code = "x = " + " + ".join(f"f{i}()" for i in range(1500)) + "\ndef g():\n    h()\n"
    tags = extract.python_tags(code)
    assert sum(t["node_type"] == "call" for t in tags) in (0, 1501) and (not tags or tags[-1]["name"] == "h")


def test_marks_and_statistics_of_the_engine(spark):
    """Bridge, phase and badge marks and the change-mates line; R04: both listings; X17: orphans make a graph sparse."""
    code = "class C:\n    def m(self, x: int): pass\n    def k(self, x: int): pass\ndef f(x: int): pass\ndef g():\n    def h():\n        f()\n"
    files = spark.createDataFrame([("a.py", None, code), ("b.py", None, "def use():\n    def inner():\n        f()\n"), ("c/d.py", None, "x = 1\n")], "path string, rel string, text string")
    history = spark.createDataFrame([(f"c{i}", datetime(2024, 1, i + 1), "ann", file) for i in range(12) for file in ("a.py", "b.py")], "commit_id string, ts timestamp, author string, file string")
    engine = Engine(files=files, history=history, now=F.lit(datetime(2024, 1, 12)), marks=True, iterations=3)
    shown = engine.map(["a.py"])
    assert "a.py:" in shown and "[emergent] [recent] [high-churn]" in shown
    assert "  ⇄ changes with: b.py(100%)" in shown
    # a type is shown once a file, in the order of the directory: methods come before functions
    assert "m(self, x: int)" in shown and "k(self, x)" in shown and "f(x)" in shown
    assert any(line.endswith("a.py") for line in engine.stats()) and any("d.py" in line for line in engine.stats(tree=True))
    symbols, orphans = engine.orphans()
    assert 0 < orphans < symbols
    # nothing refers to half of the symbols
    flat = spark.createDataFrame([(1.0,)] * 4, "rank double")
    assert "sparse" in engine.confidence(flat)["patterns"] and "sparse" not in Engine(files=files, symbol_rank=False).confidence(flat)["patterns"]
