"""Per-document operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import time
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from waymark.llm import bpe, packing, pii, quality, queries

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c a b c"), (5, "a b c a b c"), (None, "null id"), (7, "ñandú  é\n\n  x " * 3), (8, "Lo ng " * 30_000), (9, "😀 é  x y"), (10, "\x00\x1c a\x85b  don't 12345 ...  ")]


def sf_texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def reference_encoding():
    import tiktoken

    path, pattern = queries.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_matches_tiktoken(spark, docs):
    path, pattern = queries.vocabulary()
    rows = EDGES + [(i + 1000, t) for i, t in sf_texts(spark)]
    got = bpe.encode(docs(*rows), path, pattern, offsets=True)
    back = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(got, path).collect())
    coding = reference_encoding()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == sorted((str(i), coding.encode_ordinary(t or "")) for i, t in rows)
    assert back == sorted((str(i), (t or "").encode()) for i, t in rows)
    texts = dict(rows)
    for r in got.where("doc_id in (5, 7, 9)").collect():
        t, table = texts[r.doc_id], bpe.byte_table(path)
        for token, start, end in zip(r.ids, r.starts, r.ends):
            piece = table[token]
            assert 0 <= start < end <= len(t) and (t[start:end].encode() == piece or piece in t[start:end].encode())
    assert bpe.encode(docs((1, "x")).where("false"), path, pattern).count() == 0


def test_bpe_random_spacing():
    path, pattern = queries.vocabulary()
    coding, coder, rnd = reference_encoding(), bpe.PieceEncoder(*queries.vocabulary(), limit=50), random.Random(7)
    texts = ["".join(rnd.choice(["a", "Bc", " ", "  ", "\n", "\t", "'s", "é", "9", "!", " ", "\x1c", "　", "don't"]) for _ in range(rnd.randrange(40))) for _ in range(600)]
    for at in range(0, 600, 100):
        got = [np.frombuffer(c, "<i4").tolist() for c in coder.encode(texts[at : at + 100])]
        assert got == [coding.encode_ordinary(t) for t in texts[at : at + 100]]


def test_op3_digests(spark):
    coding = reference_encoding()
    texts = dict(sf_texts(spark))
    for r in queries.op3_bpe(spark, SF).collect():
        ids = coding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_decodes_all_ids_at_once(spark):
    """Odd ids add no bytes, lists keep their own bytes over slices, and no Python step runs for each id."""
    path, _ = queries.vocabulary()
    table, rnd = bpe.byte_table(path), random.Random(3)
    rows = [(0, None), (1, []), (2, [None, 5, -1, 10**6, len(table), 7]), *((i, [rnd.randrange(len(table)) for _ in range(rnd.randrange(6))]) for i in range(3, 1400)), (1400, [])]
    want = {i: b"".join(table[t] for t in ids or [] if t is not None and 0 <= t < len(table)) for i, ids in rows}
    got = bpe.decode(spark.createDataFrame(rows, "doc_id int, ids array<int>").coalesce(1), path)
    assert {r.doc_id: bytes(r.decoded) for r in got.collect()} == want
    entries, full = pa.array([*table, b""], pa.binary()), dict(enumerate(table))
    assert bpe.joined(pa.array([[], []], pa.list_(pa.int32())), entries).to_pylist() == [b"", b""]
    lists = pa.array([[rnd.randrange(len(table)) for _ in range(1000)] for _ in range(1000)], pa.list_(pa.int32()))
    start = time.process_time()
    one_by_one = [b"".join(map(full.__getitem__, ids.values.to_pylist())) for ids in lists]
    middle = time.process_time()
    assert bpe.joined(lists, entries).to_pylist() == one_by_one
    assert 3 * (time.process_time() - middle) < middle - start


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, None if covered is None else len(covered)


def test_quality_counts(spark, docs):
    rows = [r for r in EDGES if r[0] != 8] + [r for r in sf_texts(spark) if len(r[1]) < 8000]
    got = quality.features(docs(*rows))
    want = sorted((str(i), *brute_quality(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()) == want
    long = quality.features(docs(EDGES[8])).first()
    assert (long.n_words, long.n_repeat_words) == (60_000, 60_000)


def test_stages_send_few_texts_at_once(spark, docs):
    """Stages bound their Arrow batches; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "1024"), ("0", "1024"), ("100", "100")):
            spark.conf.set(key, given)
            sizes = corpus_pipeline.bpe_stage(spark, docs(*EDGES), SF)
            assert sizes.count() == len(EDGES) and spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_quality_sends_a_kept_text_once(spark, docs):
    """A kept text is measured as one that is not, and no second copy of it goes to Python."""
    table = docs(*EDGES)
    with_text = quality.features(table, keep=("doc_id", "text"))
    want = [(r.doc_id, *(r[f] for f in quality.FEATURES)) for r in quality.features(table).collect()]
    rows = with_text.collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, *(r[f] for f in quality.FEATURES))) for r in rows)
    assert sorted(repr((r.doc_id, r.text)) for r in rows) == sorted(map(repr, EDGES))
    assert "as binary" not in with_text._jdf.queryExecution().optimizedPlan().toString()


def test_quality_verdicts(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [r for r in queries.op4_quality_rules(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    right = sum(r.kept == bool(labels[r.doc_id]) for r in judged) / len(judged)
    clean = [r.kept for r in judged if labels[r.doc_id]]
    assert right > 0.97 and sum(clean) / len(clean) > 0.99
    empty = docs((1, "x")).where("false")
    assert quality.judge(quality.features(empty), quality.fit(quality.features(empty))).count() == 0
    same = docs((1, None), (2, "")) # nothing passes the base rule
    assert [r.kept for r in quality.judge(quality.features(same), quality.fit(quality.features(same))).collect()] == [False, False]


def brute_base(text):
    text, found = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base(spark):
    rnd = random.Random(3)
    parts = ["a", "@", ".", "b@c.de", "x.y@z", "12", "4111 1111 1111 1111", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "+1 (555) 123-4567", "-", " ", "é", "+", "@@", "a@b@c.d.", "4111-1111-1111-11112", "\n", "0001.002.3.4"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(5000)] + [t for _, t in sf_texts(spark)]
    for t in texts:
        assert pii.detect(t) == brute_base(t)


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("mail bob [at] mail [dot] example [dot] com now", "email", "bob [at] mail [dot] example [dot] com"),
        ("write to bob.lee at example dot com please", "email", "bob.lee at example dot com"),
        ("bob(at)example.com", "email", "bob(at)example.com"),
        ("reach bоb＠example.com", "email", "bоb＠example.com"),
        ("host 192[.]168[.]0[.]12 is", "ip", "192[.]168[.]0[.]12"),
        ("call +1 five five five one two three four five six seven", "phone", "+1 five five five one two three four five six seven"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("card ４１１１ １１１１ １１１１ １１１１ end", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card 4​111 1111 1111 1111 end", "card", "4​111 1111 1111 1111"),
    ],
)
def test_pii_disguised(text, kind, shown):
    plain, spans = pii.scan(text)
    assert [(text[s:e], k) for s, e, k in spans if (s, e, k) not in plain] == [(shown, kind)] or [(text[s:e], k) for s, e, k in spans] == [(shown, kind)]


@pytest.mark.parametrize("text", ["meet me at noon, the dot is red", "one two buckle my shoe", "look at example.com", "three at home", "a (at) b", "Привет, мир", "eins zwei drei"])
def test_pii_leaves_prose_alone(text):
    assert pii.scan(text) == ([], [])


def test_pii_tables(spark, docs):
    rows = [*EDGES, (20, "mail a@b.co or x at y dot org")]
    got = {str(r.doc_id): r for r in pii.find(docs(*rows)).collect()}
    assert [s.kind for s in got["20"].plain] == ["email"] and [s.start for s in got["20"].spans] == [5, 15]
    assert all(not got[k].spans for k in ("1", "2", "3"))
    frame = docs(*rows)
    masked = {str(r.doc_id): r for r in pii.redact(frame, length_col="n_chars").collect()}
    assert masked["20"].text == "mail <email> or <email>" and masked["20"].n_chars == len(masked["20"].text) and masked["1"].text is None and masked["20"].fingerprint == "x"
    assert pii.find(frame.where("false")).count() == 0


def test_best_fit_decreasing():
    rnd = random.Random(5)
    for _ in range(200):
        size = rnd.randrange(1, 40)
        lengths = [rnd.randrange(1, size + 1) for _ in range(rnd.randrange(60))]
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room[room.index(min(fits))] -= lengths[i]
            else:
                room.append(size - lengths[i])
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_packing_is_lossless(spark, docs, tmp_path):
    path, pattern = queries.vocabulary()
    rows = [r for r in EDGES if r[0] not in (5,)] + sf_texts(spark)[:60]
    rows = [(None if i is None else i + 1000 * (k > len(EDGES) - 3), t) for k, (i, t) in enumerate(rows)]
    coded = bpe.encode(docs(*rows), path, pattern)
    options = {"row_length": 256, "end_id": queries.END_ID, "pad_id": queries.END_ID, "shard_tokens": 5000}
    packing.write(coded, str(tmp_path / "rows"), **options)
    packed = packing.read(spark, str(tmp_path / "rows"))
    assert sorted(map(repr, packing.pack(coded, **options).collect())) == sorted(map(repr, packed.collect()))
    for r in packed.collect():
        assert len(r.ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256 and r.position_resets == r.cu_seqlens[:-1]
    whole = {}
    for r in packing.unpack(packed).orderBy("doc_id", "doc_offset").collect():
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u2").tolist())
    assert whole == {r.doc_id: [*r.ids, queries.END_ID] for r in coded.collect()}
    assert packing.pack(coded.where("false"), row_length=8).count() == 0


def test_packing_query(spark):
    """Every document of the table comes back from the files, whole; the rows are nearly full."""
    coding, packed = reference_encoding(), queries.op7_token_packing(spark, SF)
    want = {i: [*coding.encode_ordinary(t or ""), queries.END_ID] for i, t in sf_texts(spark)}
    whole = {}
    for r in packing.unpack(packed).orderBy("doc_id", "doc_offset").collect():
        assert r.doc_offset == len(whole.setdefault(r.doc_id, []))
        whole[r.doc_id].extend(np.frombuffer(bytes(r.ids), "<u2").tolist())
    assert whole == want
    rows = packed.collect()
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) / (2048 * len(rows)) > 0.9


def test_packing_encodes_in_the_same_worker(spark, docs, tmp_path):
    """Texts packed with an encoder give the rows that their table of ids gives."""
    texts = docs((1, "one two three"), (2, None), (3, ""), (None, "fo  ur\tfive"), (4, "word " * 100))
    path, pattern = queries.vocabulary()
    options = dict(row_length=16, end_id=queries.END_ID, pad_id=0)
    want = packing.pack(bpe.encode(texts, path, pattern), **options)
    packing.write(texts, str(tmp_path / "rows"), ids_col="text", encode=partial(bpe.coded, path=path, pattern=pattern, names=["id", "ids"]), **options)
    assert sorted(map(repr, packing.read(spark, str(tmp_path / "rows")).collect())) == sorted(map(repr, want.collect()))


def test_bpe_cache_is_bounded_as_a_whole():
    """Pieces of evenly and of oddly spaced texts together keep the bound, but for those of the last call."""
    coder = bpe.PieceEncoder(*queries.vocabulary(), limit=200)
    for n in range(60):
        coder.encode([f"a{n} b{n} c{n} d{n} e{n}", f"f{n}  g{n}\th{n} i{n} j{n}"])
        assert len(coder.spaced) + len(coder.plain) <= 200 + 20


def test_bpe_texts_in_parts_and_with_long_gaps(monkeypatch):
    """Well-spaced texts need no cache of pieces; parts and long gaps change no ids, where ``tiktoken`` alone would overflow its stack too."""
    path, pattern = queries.vocabulary()
    reference, rnd = reference_encoding(), random.Random(11)
    want = lambda texts: [reference.encode_ordinary(t) for t in texts]
    got = lambda texts: [np.frombuffer(c, "<i4").tolist() for c in bpe.text_ids(texts, path, pattern, 77)]
    plain = ["".join(rnd.choice(["a", "Bc", " ", "  ", "\n", "\t", "'s", "é", "9", "!", "\x1c", "　", "don't "]) for _ in range(rnd.randrange(300))) for _ in range(200)]
    gaps = [f"ab{gap * n}{end}" for gap in (" ", "\n", " \t", "　\x85") for n in (510, 511, 512, 513, 2000) for end in ("", "x", " y")]
    assert got(plain + gaps) == want(plain + gaps)
    monkeypatch.setattr(bpe, "PART", 10)
    assert any(len(list(bpe.parts(t))) > 3 for t in plain) and all("".join(bpe.parts(t)) == t for t in plain + gaps)
    assert got(plain) == want(plain)
    vast = got([" " * 1_500_000 + "x", "a" + "\n" * 1_500_000])
    table = bpe.byte_table(path)
    assert [b"".join(table[i] for i in ids) for ids in vast] == [b" " * 1_500_000 + b"x", b"a" + b"\n" * 1_500_000]
    monkeypatch.setattr(bpe, "encoder", None)
    assert got(["one two\nthree", "a\n\nb  c\td"]) == want(["one two\nthree", "a\n\nb  c\td"])


def test_packing_refuses_ids_that_do_not_fit():
    for ids in ([70000], [-1], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            packing.narrow(np.array(ids), 2)
    assert packing.narrow(np.array([65535]), 2).tolist() == [65535] and packing.narrow(np.array([70000]), 4).tolist() == [70000]
    assert packing.narrow(np.array([], "i4"), 2).tolist() == []
