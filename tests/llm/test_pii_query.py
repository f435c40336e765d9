"""The op9 query against a plain version, and scans of texts that are hard on patterns."""

import hashlib
import re
import time

import pytest

from tests.llm.test_text_operators import brute_base
from waymark.llm import pii, queries

SF2 = "/root/testdata/sf0.01"


def brute_addresses(text):
    """Addresses of the normal form that are none of the text, spelled normally."""
    text = "".join(pii._CHARS.get(c, c) for c in text)
    dots = r"(?i)\s*(?:[\[({]\s*(?:dot|\.)\s*[\])}]|<\s*dot\s*>|_dot_|(?<=\s)dot(?=\s))\s*"
    ats = r"(?i)\s*(?:[\[({]\s*(?:at|@)\s*[\])}]|<\s*at\s*>|_at_)\s*"
    normal = re.sub(ats, "@", re.sub(dots, ".", text))
    return {m[0] for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", normal)}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = queries.op9_pii(spark, SF2).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    shown = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    for r in got:
        base, text = brute_base(texts[r.doc_id]), texts[r.doc_id] or ""
        counts = [sum(k == kind for *_, k in base) for kind in pii.KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(spans) >= {s for s in shown(base).split(",") if s}
        order = [(int(a), pii.KINDS.index(k)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)
        plain = {text[s:e] for s, e, k in base if k == "email"}
        more = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans) if k == "email"} - plain
        assert brute_addresses(text) - plain == set().union(*(brute_addresses(m) for m in more)) if more else brute_addresses(text) <= plain


@pytest.mark.parametrize(
    ("text", "kind"),
    [("+34 uno tres cuatro cinco seis siete ocho nueve uno tres cuatro", "phone"), ("+49 drei vier fünf sechs sieben acht neun drei vier fünf sechs", "phone"), ("bob<at>example.com", "email"), ("bob_at_example.com", "email"), ("10 dot 0 dot 0 dot 7", "ip")],
)
def test_disguises(text, kind):
    assert [(text[s:e], k) for s, e, k in pii.scan(text)[1]] == [(text, kind)]


def test_addresses_side_by_side():
    shown = lambda t: [t[s:e] for s, e, _ in pii.scan(t)[1]]
    assert shown("me at bob [at] x.com") == ["bob [at] x.com"] and shown("x@y.com dot net") == ["x@y.com", "x@y.com dot net"]
    assert shown("a@b.c_x@d.e") == ["a@b.c", "_x@d.e"] and shown("look at example.com") == [] and shown("bob @ example dot com") == ["bob @ example dot com"]


def test_zeros():
    text = f"{'0' * 5000}.1.1.{'0' * 5000}7 {'0' * 5000}256.1.1.1"
    assert [k for *_, k in pii.scan(text)[0]] == ["ip"]


@pytest.mark.parametrize("text", ["a", "1", " ", "+", "@", "a@", "[ ", "a.", "\n", "<", "_", "dot "])
def test_long_runs(text):
    """A million characters; what is quadratic would take hours."""
    text = text * (1_000_000 // len(text))
    for tail in ("", "@", " [at] x.y dot z"):
        began = time.process_time()
        pii.scan(text + tail)
        assert time.process_time() - began < 20
