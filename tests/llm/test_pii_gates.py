"""Every entry of the tables of disguises is looked for, whatever else a text holds."""

import pytest

from waymark.llm import pii


@pytest.mark.parametrize("word", sorted(pii._SPELLED))
def test_each_spelled_digit(word):
    text = f"call +49 555 123 45 {word} {word}"
    assert (5, len(text), "phone") in pii.scan(text)[1]


@pytest.mark.parametrize("at", ["[at]", "(at)", "{at}", "<at>", "_at_", "< AT >", "( @ )"])
def test_each_at_mark(at):
    text = f"john{at}example.com"
    assert pii.scan(text)[1] == [(0, len(text), "email")]


def test_spelled_runs():
    shown = lambda t: [(t[a:b], k) for a, b, k in pii.scan(t)[1]]
    phone = "+49 drei vier fünf sechs sieben acht neun drei vier fünf"
    assert shown(phone) == [(phone, "phone")]
    assert shown("4111 1111 1111 111 one") == [("4111 1111 1111 111 one", "card")] and shown("1.2.3.four") == [("1.2.3.four", "ip")]
    assert pii.mask("at +1 555 123 456 seven ok") == "at <phone> ok"
    assert shown("see 1.2.3. One of them") == [] and shown("+49 ſechs 123 456 7891") == [("+49 ſechs 123 456 7891", "phone")]
    assert shown("one two " + "1" * 60 + "x") == []
