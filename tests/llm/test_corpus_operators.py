"""Operators over whole tables against brute force, and their edge cases."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_near_copies import brute_kept
from waymark.llm import decontamination, licenses, queries, simhash_dedup, toxicity, url_filter, warc

SF2 = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, k=3):
    """By id: the smallest id reachable."""
    label = {i: i for i, _ in pairs}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(pairs):
        for j, b in pairs[:n]:
            if (a ^ b).bit_count() <= k:
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in pairs}


def test_simhash_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_dedup(spark, SF2).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps}


def test_simhash_edges(spark, docs):
    long = "Some words that go on and on with little change " * 3000
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, long), (7, long + "x"), (8, "Ünïcode straße"), (8, "Ünïcode straße"), (9, " \n ")]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash_dedup.near_duplicates(docs(*rows)).collect()]
    texts = dict(rows)
    assert len(got) == len(rows)
    for i, fp, component in got:
        assert fp == brute_fingerprint(texts[i])
        assert component == {2: 1, 9: 1, 4: 3, 7: 6}.get(i, i)
    assert simhash_dedup.near_duplicates(docs((1, "x")).where("false")).count() == 0
    odd = simhash_dedup.near_duplicates(docs((None, "same text here"), (5, "same text here"))).collect()
    assert {r.component_id for r in odd} == {5}


@pytest.mark.parametrize("limit", [4, 16, 2048])
def test_simhash_links_cut_large_keys_again(spark, limit):
    """Dense clouds of fingerprints, so that keys go over the limit and are cut to the last level."""
    rnd = random.Random(limit)
    fps = set()
    for _ in range(6):
        center = rnd.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(rnd.randrange(9)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    pairs = list(enumerate(sorted(fps)))
    table = spark.createDataFrame([(int(np.array(f, "u8").view("i8")), i) for i, f in pairs], "fp long, root long")
    label = {r.node: r.component for r in simhash_dedup.components(simhash_dedup.links(table, limit=limit)).collect()}
    assert {i: label.get(i, i) for i, _ in pairs} == brute_components(pairs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a long, b long")
    label = {r.node: r.component for r in simhash_dedup.components(edges).collect()}
    assert {label[i] for i in range(1, 201)} == {0} and label[901] == 900


BENCH = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


def overlap_rows(docs_df, bench, **options):
    return {(r.doc_id, r.item_id): r for r in decontamination.overlaps(docs_df, bench, **options).collect()}


@pytest.mark.parametrize("inline", [100_000, 0])
def test_decontamination(spark, docs, inline):
    words = BENCH.split()
    swapped = [("zzz" if i % 6 == 5 else w) for i, w in enumerate(words)]
    bench = spark.createDataFrame([(1, BENCH), (2, None), (3, ""), (4, "too short to count")], "item_id long, text string")
    filler = "some other prose goes here without any overlap at all " * 5
    frame = docs((1, filler + BENCH.upper().replace(" ", ", ") + " " + filler), (2, filler + " ".join(swapped)), (3, filler), (4, None), (5, ""), (6, " ".join(words[:5])), (7, BENCH), (7, BENCH), (8, "too short to count"), (None, BENCH))
    got = overlap_rows(frame, bench, inline=inline)
    assert set(got) == {(1, 1), (2, 1), (7, 1), (None, 1)}
    assert got[7, 1].n_matched == 20 and got[7, 1].start == 0 and got[7, 1].length == 20 and got[2, 1].n_matched >= 10
    assert sorted(r.doc_id for r in decontamination.clean(frame, bench, inline=inline).collect()) == [3, 4, 5, 6, 8]
    assert decontamination.clean(frame, bench.where("false"), inline=inline).count() == frame.count()
    assert overlap_rows(frame.where("false"), bench, inline=inline) == {}


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/en/5"), (2, "http://Example.COM/en/77?x=1"), (3, "https://b.net/de/8"), (4, "https://x.example.net/de/8#t"), (5, "http://q.org/es/"), (6, None), (7, "no scheme"), (8, "http://com/en/"), (9, "http://xcom/en/"), (10, "http://a.example.com/fr/"), (1, "http://a.example.com/en/5"), (11, "http://h?x"), (12, "://"), (13, "http://É.com/en/É")], "page_id long, url string")
    rule, verdict = url_filter.rule_for()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.parse(pages).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")).collect()}
    assert got[1] == ("a.example.com", "/en/5", "com/en/", "block")
    assert got[2] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[3] == ("b.net", "/de/8", "net/de/", "allow")
    assert got[4] == ("x.example.net", "/de/8", "example.net/de/8", "block")
    assert got[5][2:] == ("org/es/", "block") and got[6] == ("", "", None, None) == got[7] and got[8][3] == "block" and got[9][3] is None and got[10][3] is None
    assert got[11][:2] == ("h", "") and got[12][:2] == ("", "") and got[13] == ("É.com", "/en/É", "com/en/", "block")


def test_url_model(spark):
    rows = queries.op5_url_filter(spark, SF2).collect()
    assert len(rows) == 250 and {r.verdict for r in rows} <= {"allow", "block"}
    pages = url_filter.parse(spark.read.parquet(f"{SF2}/pages.parquet").select("page_id", "url"))
    test = url_filter.labelled(pages).where("page_id % 5 = 0")
    model = url_filter.fit(url_filter.labelled(pages).where("page_id % 5 <> 0"))
    judged = url_filter.judge(test, model, rules=()).collect()
    assert sum((r.unwanted >= 0.5) == bool(r.label) for r in judged) / len(judged) > 0.9
    empty = pages.where("false")
    assert url_filter.judge(empty, url_filter.fit(url_filter.labelled(empty))).count() == 0
    nothing = url_filter.parse(spark.createDataFrame([(1, None), (2, "x")], "page_id long, url string"))
    assert [r.verdict for r in url_filter.judge(nothing, url_filter.fit(url_filter.labelled(nothing))).collect()] == ["allow", "allow"]


def test_url_trees_agree_with_columns(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random((200, len(url_filter.FEATURES)))
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    base, trees = url_filter.boost(x, y, np.ones(200), trees=5)
    frame = spark.createDataFrame([(*map(float, r),) for r in x], ", ".join(f"__f_{f} double" for f in url_filter.FEATURES))
    got = [r.p for r in frame.select(url_filter.UrlModel(base, trees, ()).probability().alias("p")).collect()]
    want = 1 / (1 + np.exp(-(base + sum(t.apply(x) for t in trees))))
    assert got == pytest.approx(want.tolist()) and ((want > 0.5) == y).mean() > 0.9


def test_licenses(spark, docs):
    full = licenses.TEMPLATES[9][1]
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, full.replace(". ", ".\n")), (3, "nothing"), (4, None), (5, ""), (6, "intro\n\n" + full.replace("provided", "given") + "\n\nend of it"), (7, "LICENSED UNDER the apache license -- version 2.0!!"), (7, "x"), (None, "Licensed under CC BY-NC 4.0."), (8, "licence " * 50_000)]
    got = [(r.doc_id, r.license) for r in licenses.scan(docs(*rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT"), (7, "Apache-2.0"), (7, "Apache-2.0"), (None, "CC-BY-NC-4.0"), (8, None)], key=str)
    assert licenses.scan(docs((1, "x")).where("false")).count() == 0


def test_matcher_against_edit_distance():
    def near(a, b):
        """One edit at most, a swap of neighbours included."""
        if a == b:
            return 0
        cut = {a[:i] + a[i + 1 :] for i in range(len(a))}
        swap = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        other = {b[:i] + b[i + 1 :] for i in range(len(b))}
        same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        return 1 if b in cut or a in other or same or b in swap else None

    terms = [("idiot", False, True), ("moron", False, True), ("scum", False, False), ("trash", False, True)]
    matcher, rnd = toxicity.Matcher(terms), random.Random(2)
    words = {t for t, *_ in terms}
    for t, *_ in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(rnd.randrange(3)):
                i = rnd.randrange(len(w) + 1)
                w[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "i", "o", "t", "s"])
            words.add("".join(w))
    for w in words:
        best = min(((d, t) for t, _, fuzzy in terms if (d := near(w, t)) is not None and (fuzzy or d == 0)), default=None)
        got = matcher.look_up(w)
        assert (got is None) == (best is None) and (got is None or got[1] == best[0]), w


def test_toxicity(spark, docs):
    rows = queries.op8_toxicity(spark, SF2).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows) and held
    assert sum((s >= 0.5) == bool(t) for s, t in held) / len(held) > 0.85
    model = toxicity.ToxicityModel((("idiot", False, True), ("réeux", True, False)), (5.0, 5.0), (3.5, 3.5), (3.0, 0.5, 1.0, 0.2, 0.2), -4.0)
    frame = docs((1, "you are an idiot today"), (2, 'he said "you idiot" to us'), (3, "you are an idoit today"), (4, "plain words here"), (5, None), (6, ""), (7, "un réeuxpa ici"), (8, "word " * 100_000), (4, "plain words here"))
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert got[1].score > 0.5 > got[2].score and got[3].misspelled > 0 and got[3].score > 0.5 and got[7].hits > 0
    assert got[4].score == got[5].score == got[6].score == got[8].score
    none = toxicity.fit(frame, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert none.constant == 0.0 and toxicity.score(frame, none).count() == 9
    assert toxicity.score(frame.where("false"), model).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "y" * 200
    rows = [(5, "http://a/", big), (3, "http://b/", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, None, None), (6, "x\r\ny", "é" * 60), (None, "n", big), (7, "", ""), (3, "http://b/", big), (8, "z", "WARC/1.1\r\n\r\n" + "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(warc.plan_records(pages), str(tmp_path / "w"), per_file=4)
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert all(r.state == "ok" for r in back) and len(back) == len(rows)
    by = {}
    for r in back:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[3]] == ["response"] * 2 and {(by[k][0].record_type, by[k][0].refers_to) for k in (5, 9, None)} == {("revisit", 3)}
    assert all(by[k][0].record_type == "response" for k in (1, 2, 4, 7, 8)) and bytes(by[6][0].payload).decode() == "é" * 60 and by[5][0].payload_bytes == len(big)
    for file in (tmp_path / "w").rglob("part-*"):
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")
    warc.write(warc.plan_records(pages.where("false")), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    import hashlib

    records = [warc.build_record(i, f"http://x/{i}", b"body %d " % i * 30, hashlib.sha256(b"body %d " % i * 30).hexdigest(), None, False) for i in range(6)]
    members = [gzip.compress(r) if packed else r for r in records]
    ids = lambda data: [h["warc-record-id"].split(":")[-1].strip(">") for s, _, _, h, _ in warc.salvage(data) if s == "ok"]
    gaps = lambda data: [(o, n) for s, o, n, _, _ in warc.salvage(data) if s != "ok"]
    whole = b"".join(members)
    assert ids(whole) == list("012345") and gaps(whole) == []
    hurt = bytearray(whole)
    at = len(members[0]) + len(members[1]) - 20  # within the block, which has a digest
    hurt[at] ^= 0xFF
    assert ids(bytes(hurt)) == list("02345") and gaps(bytes(hurt)) == [(len(members[0]), len(members[1]))]
    assert ids(whole[:-10]) == list("01234") and gaps(whole[:-10]) == [(len(whole) - len(members[5]), len(members[5]) - 10)]
    assert ids(members[0] + b"junk" * 9 + members[1]) == ["0", "1"] and gaps(members[0] + b"junk" * 9 + members[1]) == [(len(members[0]), 36)]
    assert ids(b"") == [] and gaps(b"garbage") == [(0, 7)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, SF2).cache()
    verdict = {r.doc_id for r in queries.op4_quality_rules(spark, SF2).where("kept").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == verdict
    single = corpus_pipeline.dedup_stage(spark, kept, SF2).cache()
    # the stage's bound is a five-word Jaccard of 0.8, not op1's 3 bits of three-word fingerprints
    assert sorted(r.doc_id for r in single.collect()) == brute_kept([(r.doc_id, r.text) for r in kept.collect()])
    clean = corpus_pipeline.decontamination_stage(spark, single, SF2).cache()
    bad = {r.doc_id for r in queries.op2_decontamination(spark, SF2).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    masked = corpus_pipeline.pii_stage(spark, clean, SF2)
    assert masked.columns == columns and masked.where("n_chars <> length(text)").count() == 0
    coded = corpus_pipeline.bpe_stage(spark, masked, SF2)
    assert coded.count() == clean.count() and coded.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_edges(spark, docs):
    good = "".join(f"Word{i} goes{i % 9} along thing{i * 7} end. " for i in range(80))
    frame = docs((1, good), (1, good), (2, None), (3, ""), (4, good + "more"), (None, good.replace("Word", "Item")), (5, good.replace("thing", "stuff") + " mail a@b.co"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == list(corpus_pipeline.COLUMNS)
    ids = sorted(str(r.doc_id) for r in frame.collect())
    assert "1" in ids and ids.count("1") == 1 and "2" not in ids and "5" in ids and "None" in ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs((1, "x")).where("false"), SF).count() == 0
