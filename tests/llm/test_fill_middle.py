"""Fill-in-middle against brute force, by code points, words and lines, and exact round trips."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.llm import fill_middle, oracles, queries

SF2 = "/root/testdata/sf0.01"
MARKS = ("<P>", "<S>", "<M>")


def brute(doc_id, text, starts=None):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    starts = list(range(len(text))) if starts is None else starts(text)
    n = len(starts)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ([*starts, len(text)][i] for i in (low, high))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}")


def word_starts(text):
    return sorted({0, *(m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text))}) if text else []


def line_starts(text):
    return sorted({0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))}) if text else []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = queries.op11_fill_middle(spark, SF2).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        *want, output = brute(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == want
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id] or ""))


def test_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF2}/documents.parquet'")
    cursor = duck.execute(oracles.oracle_sql()["op11_fill_middle"])
    names = [x[0] for x in cursor.description]
    df = queries.op11_fill_middle(spark, SF2)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


@pytest.mark.parametrize("unit,starts", [("code point", None), ("word", word_starts), ("line", line_starts)])
def test_units(spark, docs, unit, starts):
    rnd = random.Random(3)
    letters = "ab é€😀\n\t<PSM>\r\x0b"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))) for i in range(400)]
    rows += [(-5, "negative id"), (None, "no id at all"), (7, None), (8, ""), (9, "x"), (10, "\n"), (11, "😀"), (12, "a<P>b"), (13, "a<<S>"), (14, "<M"), (14, "<M"), (15, "long wörds\n" * 200_000)]
    table = docs(*rows)
    cut = fill_middle.transform(table, unit=unit, keep=("fingerprint",))
    assert cut.columns == ["doc_id", "fingerprint", "n", "form", "prefix_units", "middle_units", "output"]
    got = cut.collect()
    want = [(i, "x", *brute(i, t, starts)) for i, t in rows]
    assert sorted(((r.doc_id, r.fingerprint, r.n, r.form, r.prefix_units, r.middle_units, r.output.decode()) for r in got), key=repr) == sorted(want, key=repr)
    back = fill_middle.restore(cut).select("doc_id", F.decode("restored", "utf-8").alias("t")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_select_by_halving():
    rnd = random.Random(1)
    for size in (1, 2, 3, 7, 64, 1000):
        bits = rnd.getrandbits(size)
        places = [i for i in range(size) if bits >> (size - 1 - i) & 1]
        ranks = sorted(rnd.randrange(len(places) + 3) for _ in range(5))
        assert fill_middle.select(bits, size, ranks) == [places[r] if r < len(places) else size for r in ranks]


def test_marks_and_odd_bytes(spark):
    assert fill_middle.marks(b"a<P><<P>", b"<P>") == 0b01000100
    odd = b"\x80\xff\xc3ab\xa9"
    assert fill_middle.code_points(odd).bit_count() == 5
    table = spark.createDataFrame([(1, odd), (2, odd * 50)], "doc_id long, text binary")
    assert {r.doc_id: bytes(r.restored) for r in fill_middle.restore(fill_middle.transform(table, fim_percent=100)).collect()} == {1: odd, 2: odd * 50}


def test_sentinels_and_names(spark, docs):
    for wrong in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("<a<", "b", "c"), ("|p|", "|s|", "|m|"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.Sentinels(*wrong).encoded()
    with pytest.raises(ValueError):
        fill_middle.transform(docs((1, "x")).withColumn("form", F.lit(1)), keep=("form",))
    other = fill_middle.Sentinels("⟨pre⟩", "⟨suf⟩", "⟨mid⟩")
    cut = fill_middle.transform(docs(*((i, f"some <P> text {i} ⟨") for i in range(50))), sentinels=other, fim_percent=100, spm_percent=50)
    assert {r.form for r in cut.collect()} == {"psm", "spm"}
    assert {r.doc_id: r.restored.decode() for r in fill_middle.restore(cut, sentinels=other).collect()} == {i: f"some <P> text {i} ⟨" for i in range(50)}
    assert fill_middle.transform(docs((1, "x")).where("false")).count() == 0


def test_query_moves_few_texts_at_once(spark):
    """The query bounds the rows of its Arrow batches and of Parquet's decoding; a smaller bound stays, and rows don't hang on it."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before, found = {k: spark.conf.get(k) for k in keys}, []
    try:
        for given, want in ((("10000", "4096"), ("1024", "1024")), (("0", "4096"), ("1024", "1024")), (("7", "5"), ("7", "5"))):
            for k, v in zip(keys, given):
                spark.conf.set(k, v)
            found.append(sorted(queries.op11_fill_middle(spark, SF2).collect(), key=lambda r: r.doc_id))
            assert tuple(spark.conf.get(k) for k in keys) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2] and len(found[0]) == spark.read.parquet(f"{SF2}/documents.parquet").count()
