"""Substring dedup against SQL over a whole table, and against brute force around every edge of the method."""

import random

import duckdb
import numpy as np
import pytest

from waymark.llm import oracles, queries, repeated_phrases

SF2 = "/root/testdata/sf0.01"


def brute(rows, width):
    """By row: words, ranges of removed ones; of equal windows those at the least id and start stay."""
    first = {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, words in texts:
        gone = {s + k for s in range(len(words) - width + 1) if first[tuple(words[s : s + width])] != (i, s) for k in range(width)}
        out.append((len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def found(df, rows, **options):
    got = repeated_phrases.deduplicated(df, **options).collect()
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    want = [(i, *b) for (i, _), b in zip(rows, brute(rows, options.get("width", 20)))]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(want, key=repr)


def test_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF2}/documents.parquet'")
    cursor = duck.execute(oracles.oracle_sql()["op12_substring_dedup"])
    names = [x[0] for x in cursor.description]
    df = queries.op12_substring_dedup(spark, SF2)
    assert sorted(names) == sorted(df.columns)
    got = sorted(map(tuple, df.select(*names).collect()), key=repr)
    assert got == sorted(cursor.fetchall(), key=repr)
    assert sum(r[2] for r in got) > 10_000


def test_edges(spark, docs):
    base = [f"w{i}" for i in range(200)]
    text = lambda a, b: " ".join(base[a:b])
    rows = [(5, text(0, 60)), (2, "x " + text(10, 30) + " y"), (9, text(10, 29)), (11, text(0, 200)), (-4, text(150, 171)), (None, text(0, 40) + " z"), (None, text(0, 40) + " q")]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, "a " * 60), (25, "a " * 19), (26, "ä\x0b" + text(100, 130).replace(" ", "\n")), (27, text(100, 130) + " " + text(100, 130))]
    rows += [(30, text(40, 90)), (30, text(40, 90)), (31, text(40, 90)), (32, "p " + text(60, 80)), (32, text(60, 80) + " r"), (40, "loop de " * 3000)]
    found(docs(*rows), rows)
    assert repeated_phrases.deduplicated(docs((1, "x")).where("false")).count() == 0


@pytest.mark.parametrize("width,gram,rows_", [(20, None, 128), (5, 2, 3), (6, 6, 4), (4, 1, 2), (1, 1, 5)])
def test_random_texts_of_few_words(spark, docs, monkeypatch, width, gram, rows_):
    """Few different words, so that passages overlap, repeat within texts and are cut at every place; several shards."""
    monkeypatch.setattr(repeated_phrases, "SHARD_ROWS", rows_)
    monkeypatch.setattr(repeated_phrases, "WORDS", 50)
    monkeypatch.setattr(repeated_phrases, "PIECE", 7)
    rnd = random.Random(width)
    pool = [[rnd.choice("abcdé") * rnd.randrange(1, 3) for _ in range(rnd.randrange(3 * width))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rnd.randrange(5)):
            part = rnd.choice(pool)
            a = rnd.randrange(len(part) + 1)
            words += part[a : rnd.randrange(a, len(part) + 1)] + [f"n{rnd.randrange(30)}"] * rnd.randrange(2)
        rows.append((rnd.randrange(80), " ".join(words)))
    found(docs(*rows), rows, width=width, gram=gram)


@pytest.mark.parametrize("part,longest", [(4 << 20, 1024), (16, 1024), (16, 5), (1, 3)])
def test_word_hashes_in_parts(monkeypatch, part, longest):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abé \n\t\x0b\x0c\r") * rnd.randrange(1, 4) for _ in range(rnd.randrange(80))) for _ in range(300)]
    texts += ["", " ", "x" * 5000, " " + "y" * 40 + " ", "ab ba", "a\x00 \x00a \x00 \x00\x00"]
    monkeypatch.setattr(repeated_phrases, "PART", part)
    monkeypatch.setattr(repeated_phrases, "LONGEST", longest)
    names = {}
    for t in texts:
        words, hashes = t.encode().split(), repeated_phrases.word_hashes(t.encode())[0].tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert names.setdefault(w, h) == h or len(w) > part
    short = {w: h for w, h in names.items() if len(w) <= part}
    assert len(set(short.values())) == len(short)


def test_codes_of_many_words():
    text, digits = repeated_phrases._coded(np.arange(300_000, dtype="u8"))
    assert len(text) == 900_000 and digits == 3
    assert len({text[i : i + 3] for i in range(0, 900_000, 3)}) == 300_000
    places = [set(text[i::3]) for i in range(3)]
    assert not places[0] & places[1] and not places[1] & places[2]
