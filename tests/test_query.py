import pytest

from phrasewell.errors import PhrasewellError, QuerySyntaxError
from phrasewell.functions.analysis import Analyzer
from phrasewell.plans.query import Query, Term, analyze, auto_fuzz, build, parse


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("hello", Query((Term("hello"),))),
        ("Hello  WORLD ", Query((Term("hello"), Term("world")))),
        ('"a b"~3', Query((Term("a"), Term("b")), 3)),
        (' "a~ bcd~ efghij~"~12 ', Query((Term("a", 0), Term("bcd", 1), Term("efghij", 2)), 12)),
        ("x~1 y~02", Query((Term("x", 1), Term("y", 2)))),
        ("ÀB", Query((Term("Àb"),))),
        ("faq? u.s.", Query((Term("faq?"), Term("u.s.")))),
    ],
)
def test_valid(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["", "   ", '""', '" a"', '"a "', "a~1~2", '"a"~', '"a', 'a"', '"a"b', "a~3", '"a"~123', "~1", " a", '"a" ~1'])
def test_invalid(text):
    with pytest.raises(QuerySyntaxError) as error:
        parse(text)
    assert isinstance(error.value, ValueError) and isinstance(error.value, PhrasewellError)


def test_every_fault_is_listed():
    with pytest.raises(QuerySyntaxError, match="3.*4"):
        parse("a~3 b~4")


def test_auto_fuzz_counts_bytes():
    assert [auto_fuzz(t) for t in ("ab", "abc", "abcde", "abcdef", "éé")] == [0, 1, 1, 2, 1]


def test_analysis_drops_stop_words_and_stems():
    query = parse('"the ponies~1 of hoping"~2')
    assert analyze(query, Analyzer()) == Query((Term("poni", 1), Term("hope")), 2)
    assert analyze(query, Analyzer.of(["ponies"], stem=False)) == Query((Term("the"), Term("of"), Term("hoping")), 2)
    assert analyze(parse("the of"), Analyzer()).terms == ()


def test_build():
    assert build("Ottawa, Ontario", 1, 2) == '"ottawa,~1 ontario~1"~2'
