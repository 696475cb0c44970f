"""The query language.

    query  := [space] phrase [space]  |  terms [space]
    phrase := '"' terms '"' ['~' slop]
    terms  := term (space term)*
    term   := token ['~' [fuzz]]

A token is any run of characters other than white space, ``"`` and ``~``.  Slop
has one or two digits; fuzz is 0, 1 or 2, and a bare ``~`` picks it by the
token's length in bytes (up to 2: 0, up to 5: 1, else 2).  Terms without quotes
are a phrase of slop 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QuerySyntaxError
from ..functions.analysis import LOWER, UPPER, Analyzer
from ..functions.stemmer import stem

_LOWER = str.maketrans(UPPER, LOWER)
_TOKEN = re.compile(r'[^\s"~]+')
_FUZZ = re.compile(r"~([0-9]{0,2})")
_SLOP = re.compile(r"~([0-9]{1,2})")
_SPACE = re.compile(r"\s+")
MAX_FUZZ = 2


@dataclass(frozen=True)
class Term:
    text: str
    fuzz: int = 0


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...]
    slop: int = 0


def auto_fuzz(token: str) -> int:
    size = len(token.encode())
    return 0 if size <= 2 else 1 if size <= 5 else 2


def parse(text: str) -> Query:
    """The query that a text states; QuerySyntaxError if it states none."""
    source = text.translate(_LOWER)
    faults: list[str] = []
    at = 0

    def fail(what: str) -> QuerySyntaxError:
        return QuerySyntaxError(f"invalid query {source!r}: " + "; ".join([*faults, f"{what} at {at}"]))

    opening = re.compile(r'\s*"').match(source)
    if opening:
        at = opening.end()
    terms: list[Term] = []
    while True:
        token = _TOKEN.match(source, at)
        if not token:
            raise fail("a term is expected")
        at, fuzz = token.end(), 0
        if mark := _FUZZ.match(source, at):
            fuzz = int(mark[1]) if mark[1] else auto_fuzz(token[0])
            if fuzz > MAX_FUZZ:
                faults.append(f"fuzziness must be at most {MAX_FUZZ}, not {fuzz}, at {at}")
            at = mark.end()
        terms.append(Term(token[0], fuzz))
        space = _SPACE.match(source, at)
        if not space or space.end() == len(source):
            break
        if opening and source[space.end()] == '"':
            break
        at = space.end()
    slop = 0
    if opening:
        if source[at : at + 1] != '"':
            raise fail("a closing quote is expected")
        at += 1
        if source[at : at + 1] == "~":
            mark = _SLOP.match(source, at)
            if not mark:
                raise fail("a slop of one or two digits is expected")
            slop, at = int(mark[1]), mark.end()
    if space := _SPACE.match(source, at):
        at = space.end()
    if at < len(source):
        raise fail("the end is expected")
    if faults:
        raise QuerySyntaxError(f"invalid query {source!r}: " + "; ".join(faults))
    return Query(tuple(terms), slop)


def analyze(query: Query, analyzer: Analyzer) -> Query:
    """The query without stop words, its terms stemmed as documents are."""
    kept = [t for t in query.terms if t.text not in analyzer.stop_words]
    return Query(tuple(Term(stem(t.text) if analyzer.stem else t.text, t.fuzz) for t in kept), query.slop)


def build(text: str, fuzz: int, slop: int) -> str:
    """A query string: the words of a text as a phrase, each with that fuzz."""
    return '"' + " ".join(f"{w}~{fuzz}" for w in text.translate(_LOWER).split()) + f'"~{slop}'
