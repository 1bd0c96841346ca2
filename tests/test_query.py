import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seamfinder.functions.analyzer import tokenize
from seamfinder.functions.porter import stem
from seamfinder.operators.blocks import match_pattern
from seamfinder.plans import query as Q

split = lambda w: [x for x in w.lower().replace("_", " ").split() if x]


@pytest.mark.parametrize("text,present,want", [
    ("a b", "a", True), ("a AND b", "a", False), ("a b AND c", "a", False), ("a b AND c", "ac", True), ("a OR b AND c", "a", True),
    ("+a b", "b", False), ("+a b", "a", True), ("(+a) OR b", "b", False), ("a -b", "ab", False), ("-b", "", True), ("-b", "b", False), ("f:a", "a", True), ("zz", "a", False),
])
def test_rules(text, present, want):
    assert Q.evaluate(Q.parse(text, split), set(present)) is want


def test_files_ignore_exclusions():
    assert Q.evaluate(Q.parse("a -b", split), {"a", "b"}, files=True)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_never_fails(text):
    Q.parse(text, split)
    assert len(set(tokenize(text))) == len(tokenize(text))


def test_tokens():
    assert tokenize("IpWhitelist parseHTTPResponse") == ["ip", "white", "list", "pars", "http", "respons"]
    assert tokenize("the 7 users -user") == []


@pytest.mark.parametrize("words", [
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist",
    "knack knack knackeries knackeri knaves knave knavish knavish kneaded knead kneel kneel knightly knight knitting knit knots knot knowing know",
    "running run happily happili relational relat conditional condit rationalize ration generously generous communities communiti arsenal arsenal",
    "skies sky dying die news news ties tie cried cri by by say say hoping hope hopping hop falling fall controlled control agreed agre succeed succeed",
    "formalize formal hopefulness hope national nation argument argument replacement replac adoption adopt apology apolog controll control",
])
def test_stems(words):
    w = words.split()
    assert [stem(x) for x in w[::2]] == w[1::2]


def test_excluded_words_stay_as_written():
    assert Q.leaves(Q.parse("running -running", tokenize))[1].keywords == ("running",)
    assert Q.leaves(Q.parse("running -running", tokenize))[0].keywords == ("run",)


def test_patterns():
    src = "foo(a, (b, c)); foo(a, d)"
    assert [src[s:e] for s, e in match_pattern(src, "foo($X, $Y)")] == ["foo(a, (b, c))", "foo(a, d)"]
    assert match_pattern("f(a, a) f(a, b)", "f($X, $X)") == [(0, 7)]
    import time

    began = time.time()
    assert match_pattern("call(" + "a, b, " * 800 + "c)", "call($$$A, $$$B, $$$C, nothing)") == []
    assert time.time() - began < 5
