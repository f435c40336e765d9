"""Learned operators on rows, or whole hosts, that they have not seen."""

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import queries, toxicity, url_filter
from waymark.llm.common import table

SF2, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_url_model_on_hosts_held_out(spark):
    """Each unwanted host is judged by trees that have seen neither it nor a share of the other hosts."""
    labelled = url_filter.labelled(url_filter.parse(table(spark, SF2, "pages", "page_id", "url"))).cache()
    hosts = {r.host: r.label for r in labelled.select("host", "label").distinct().collect()}
    bad, good = sorted(h for h, y in hosts.items() if y), sorted(h for h, y in hosts.items() if not y)
    right = {0: [], 1: []}
    for k, host in enumerate(bad):
        out = [host, *good[k :: len(bad)]]
        model = url_filter.fit(labelled.where(~F.col("host").isin(out)))
        for r in url_filter.judge(labelled.where(F.col("host").isin(out)), model, rules=()).collect():
            right[r.label].append((r.unwanted >= 0.5) == bool(r.label))
    assert len(right[0]) + len(right[1]) == labelled.count()
    assert np.mean(right[1]) >= 0.9 and np.mean(right[0]) >= 0.98


def test_url_suffixes_cover_all_urls(spark):
    """Repeated urls neither fill the sample nor hide suffixes; rare suffixes share their odds."""
    rows = [(f"http://a{i}.com/x", int(i % 2)) for i in range(40)] + [("http://copy.org/y", 1)] * 5000 + [(f"http://b.rare{i}/", 0) for i in range(30)]
    known = url_filter.parse(spark.createDataFrame(rows, "url string, label int"))
    model = url_filter.fit(known, sample=50)
    odds = dict(model.suffixes)
    assert set(odds) == {"com", "org", url_filter.RARE} and odds["org"] > 0 > odds[url_filter.RARE]
    verdict = {r.url: r.verdict for r in url_filter.judge(known.dropDuplicates(["url"]), model, rules=()).collect()}
    assert verdict["http://copy.org/y"] == "block"


def test_url_query(spark):
    """Hosts, paths and rules by plain string work; the verdict is the rule's, else that of the labels the trees learned."""
    urls = {r.page_id: r.url for r in table(spark, SF2, "pages", "page_id", "url").collect()}
    got = queries.op5_url_filter(spark, SF2).collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        _, found, rest = (urls[r.page_id] or "").partition("://")
        rest = rest if found else ""
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(rule), rule, verdict) for rule, verdict in url_filter.RULES if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        want = max(fits)[1:] if fits else (None, "block" if set(host.split(".")) & set(url_filter.UNWANTED) else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want)


def test_toxicity_on_rows_held_out(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, SF1, "labels").collect()}
    rows = queries.op8_toxicity(spark, SF1).collect()
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    score, toxic = np.array([s for s, _ in held]), np.array([y for _, y in held]) == 1
    better = score[toxic][:, None] - score[~toxic][None]
    assert ((better > 0) + 0.5 * (better == 0)).mean() > 0.95
    assert (score[toxic] >= 0.5).mean() > 0.9 and (score[~toxic] >= 0.5).mean() < 0.02
    assert len(rows) == table(spark, SF1, "documents").count() and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_unlike_labels_and_misspellings(spark, docs):
    """A toxic label wins over others of its document; misspellings count by what labelled texts show of them."""
    frame = docs(*[(i, f"you utter blackguard number{i}") for i in range(12)], *[(100 + i, f"a fine day number{i} with blackboard") for i in range(40)])
    labels = [(i, 1) for i in range(12)] + [(100 + i, 0) for i in range(40)] + [(0, 0)]
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "blackguard" in {t for t, *_ in model.terms}
    assert all(0 <= near <= full for near, full in zip(model.near_strength, model.strength))
    assert all(fuzzy == (not stem and len(t) >= 4) for t, stem, fuzzy in model.terms)
    got = {r.doc_id: r.score for r in toxicity.score(docs((1, "you blackgaurd number3"), (2, "a fine day"), (3, "x" * 100_000)), model).collect()}
    assert got[1] > 0.5 > got[2] == got[3]


def test_toxicity_moves_few_texts_at_once(spark):
    """The query bounds the rows of its Arrow batches and of Parquet's decoding; a smaller bound stays, and scores don't hang on it."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before, found = {k: spark.conf.get(k) for k in keys}, []
    try:
        for given, want in ((("10000", "4096"), ("1024", "1024")), (("7", "5"), ("7", "5"))):
            for k, v in zip(keys, given):
                spark.conf.set(k, v)
            found.append(sorted(map(tuple, queries.op8_toxicity(spark, "/root/testdata/sf0.001").collect())))
            assert tuple(spark.conf.get(k) for k in keys) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] and len(found[0]) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
