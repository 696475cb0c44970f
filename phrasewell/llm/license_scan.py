"""Operator 7, licence scans: winnowed fingerprints, then banded alignment.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.
The templates' ``GRAM``-word sequences are hashed and winnowed: of every
``WINDOW`` neighbouring ones the least is a fingerprint; a template of at most
``SHORT`` words keeps all.  An inverted index leads from a fingerprint to the
templates and places that have it.  Every word sequence of a document is looked
up there.  Hits of a template on neighbouring diagonals make a candidate (of at
most ``WIDEST`` diagonals: notices may follow each other without end), which a
local alignment (+1 for an equal word, -1 for a replaced, missing or added one)
confirms within ``BAND`` diagonals around the hits.  What lies before and after
a confirmed alignment is aligned again, until nothing covers enough: every
notice is found, also one right after another.  Reported are alignments that
match at least ``MIN_COVERAGE`` of the template's words, with their words'
span; of overlapping ones of the same template the better.  An
alignment within one of another template that matches more words, or as many and
covers its template better, is left out: similar names of licences are told apart.

Defined results: null, empty and wordless texts match nothing; a null id is
reported as null; repeated rows are each reported.  Texts have no length limit.
Of equally good alignments that overlap the first is reported; templates that
match the same words equally well are all reported.  An empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import textvec as V
from .license_templates import TEMPLATES

GRAM = 3
WINDOW = 4
SHORT = 16
BAND = 6
WIDEST = 24
MIN_COVERAGE = 0.7
_FILTER_BITS = 16


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    hash: np.ndarray
    template: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window (the last of equal ones), each once."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], window)
    return np.unique(len(h) - 1 - (np.arange(len(view)) + view.argmin(axis=1)))


def index(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Index:
    names, words, hashes, owners, places = [], [], [], [], []
    for k, (name, text) in enumerate(templates):
        (w,) = V.slices(pa.array([text]), V.ALNUM)
        h, valid = V.grams(w, GRAM)
        h = h[valid]
        at = np.arange(len(h)) if len(w.hash) <= SHORT else winnow(h, WINDOW)
        names.append(name)
        words.append(w.hash)
        hashes.append(h[at])
        owners.append(np.full(len(at), k))
        places.append(at)
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(names, words, h[order], np.concatenate(owners)[order], np.concatenate(places)[order], maybe)


def align(template: np.ndarray, text: np.ndarray, low: int | None = None, high: int | None = None) -> tuple[int, int, int, int]:
    """(score, matched words, start, end) of the best local alignment of template in text.

    Only diagonals (place in text minus place in template) low..high are
    searched; without them, all.  Of equal scores the one with more matched
    words, then the one that ends first, then the one that starts last.
    """
    low = -len(template) if low is None else low
    high = len(text) if high is None else high
    # A cell: (score, matched, -end, start); kept as score with its path's matched count and start.
    best = (0, 0, 0, 0)
    row: dict[int, tuple[int, int, int]] = {}  # diagonal -> (score, matched, start) of the template word before
    for i, word in enumerate(template.tolist()):
        fresh: dict[int, tuple[int, int, int]] = {}
        for d in range(max(low, -i), min(high, len(text) - 1 - i) + 1):
            j = i + d
            score, matched, start = row.get(d, (0, 0, j))
            if score <= 0:
                score, matched, start = 0, 0, j
            cell = (score + 1, matched + 1, start) if text[j] == word else (score - 1, matched, start)
            if d - 1 in fresh:  # the text's word is added
                s, m, b = fresh[d - 1]
                cell = max(cell, (s - 1, m, b))
            if d + 1 in row:  # the template's word is missing
                s, m, b = row[d + 1]
                cell = max(cell, (s - 1, m, b))
            if cell[0] > 0:
                fresh[d] = cell
                found = (cell[0], cell[1], -(j + 1), cell[2])
                if found > best:
                    best = found
        row = fresh
    return best[0], best[1], best[3], -best[2]


def alignments(template: np.ndarray, text: np.ndarray, low: int | None = None, high: int | None = None) -> list[tuple[int, int, int, int]]:
    """All alignments of align() that cover enough: the best, then those of the text before and after it."""
    low = -len(template) if low is None else low
    high = len(text) if high is None else high
    least, out, work = MIN_COVERAGE * len(template), [], [(0, len(text))]
    while work:
        a, b = work.pop()
        # Only the words that these diagonals reach.
        a, b = max(a, low), min(b, high + len(template))
        if b - a < least:
            continue
        score, matched, start, end = align(template, text[a:b], low - a, high - a)
        if matched >= least:
            out.append((score, matched, a + start, a + end))
            work += [(a, a + start), (a + end, b)]
    return out


def scan(column, ix: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched words, first word, end) of the alignments that cover enough."""
    out = []
    shift = np.uint64(64 - _FILTER_BITS)
    for w in V.slices(column, V.ALNUM):
        h, valid = V.grams(w, GRAM)
        at = np.flatnonzero(ix.maybe[(h >> shift).astype(np.int64)] & valid)
        lo, hi = np.searchsorted(ix.hash, h[at]), np.searchsorted(ix.hash, h[at], side="right")
        n = hi - lo
        pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        if not len(at):
            continue
        text = np.searchsorted(w.bounds, at, side="right") - 1
        hits = np.unique(np.stack([text, ix.template[pick], at - w.bounds[text] - ix.place[pick]], axis=1), axis=0)
        new = np.ones(len(hits), bool)
        new[1:] = (np.diff(hits[:, :2], axis=0) != 0).any(axis=1) | (np.diff(hits[:, 2]) > BAND)
        # Longer chains of diagonals are cut.
        head = np.repeat(hits[new, 2], np.diff(np.append(np.flatnonzero(new), len(hits))))
        piece = (hits[:, 2] - head) // WIDEST
        new[1:] |= np.diff(piece) != 0
        starts = np.append(np.flatnonzero(new), len(hits))
        rows: dict[tuple[int, int], list] = {}
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            k, t = int(hits[a, 0]), int(hits[a, 1])
            mine, low, high = w.hash[w.bounds[k] : w.bounds[k + 1]], int(hits[a, 2]) - BAND, int(hits[b - 1, 2]) + BAND
            for score, matched, start, end in alignments(ix.words[t], mine, low, high):
                rows.setdefault((k, t), []).append((-score, start, end, matched))
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for (k, t), found in rows.items():
            for _, start, end, matched in apart(found):
                by.setdefault(k, []).append((t, matched, start, end))
        for k, found in by.items():
            out += [(k + w.first, *x) for x in outermost(found, ix)]
    return out


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of alignments (-score, start, end, matched) that overlap, the better."""
    starts: list[int] = []
    out: dict[int, tuple[int, int, int, int]] = {}
    for x in sorted(found):
        k = bisect(starts, x[1])
        if (k == 0 or out[starts[k - 1]][2] <= x[1]) and (k == len(starts) or starts[k] >= x[2]):
            starts.insert(k, x[1])
            out[x[1]] = x
    return list(out.values())


def outermost(found: list[tuple[int, int, int, int]], ix: Index) -> list[tuple[int, int, int, int]]:
    """Alignments (template, matched, start, end) that are not within a better one; only neighbours can be."""
    found = sorted(found, key=lambda x: x[2])
    starts, longest = [x[2] for x in found], max(x[3] - x[2] for x in found)
    out = []
    for x in found:
        near = found[bisect_left(starts, x[2] - longest) : bisect(starts, x[2])]
        if not any(within(x, y, ix) for y in near):
            out.append(x)
    return out


def within(x: tuple[int, int, int, int], y: tuple[int, int, int, int], ix: Index) -> bool:
    """Whether another template's alignment y covers x's words and matches more of them, or as many but more of its template."""
    return y[2] <= x[2] and x[3] <= y[3] and (y[1], -len(ix.words[y[0]])) > (x[1], -len(ix.words[x[0]]))


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, template, matched_words, template_words, coverage, first_word, end_word) of each match."""
    source = docs.select("doc_id", "text")
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), StructField("license", StringType())])
    for name in ("template", "matched_words", "template_words"):
        schema.add(name, LongType())
    schema.add("coverage", DoubleType()).add("first_word", LongType()).add("end_word", LongType())
    ix = index(templates)  # the templates are part of the program: a fixed size

    def find(batches):
        sizes = np.array([len(x) for x in ix.words])
        for batch in batches:
            of = np.array(scan(batch.column(1), ix), np.int64).reshape(-1, 5)
            total = sizes[of[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of[:, 0])),
                    pa.array([ix.names[t] for t in of[:, 1].tolist()], pa.string()),
                    *(pa.array(x) for x in (of[:, 1], of[:, 2], total, np.round(of[:, 2] / total, 6), of[:, 3], of[:, 4])),
                ],
                names=schema.names,
            )

    return source.mapInArrow(find, schema)
