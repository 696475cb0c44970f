"""Operator 9, benchmark decontamination: spaced-seed hashing and verified overlaps.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.
A spaced seed hashes the words at the positions that a fixed mask selects, so
a word that was replaced at an ignored position doesn't hide the overlap.  The
seeds of all benchmark items are joined with the seeds at every position of
every document; a hit fixes a document, an item and a shift between the two.
Along that shift the overlap is verified: the best segment, counting +1 for an
equal word and -2 for a replaced one.  A document is contaminated if a segment
reaches ``MIN_SCORE``, or 60 % of the item's words if that is less.

Items with fewer words than the longest mask spans (``SPAN``) have no seeds:
they are looked for as they are, all their words one after the other.  Fewer
than ``SHORTEST`` words ("what is it") are no evidence of anything.

The benchmark's seeds are broadcast in parts of at most ``SEEDS_AT_ONCE``; a
larger benchmark takes several passes over the documents, so nothing grows
beyond that size in the driver or in a worker.

Defined results: null, empty and wordless texts are never contaminated; items
with a null text or fewer than ``SHORTEST`` words are not searched.  A very long
text is searched whole.  Of equally good segments of a document and an item the
first is reported, of those the shortest.  Repeated items or documents are each
reported.  A null doc_id or item_id is reported as null.  Without documents or
without items there are no rows, and the filter keeps all.  Extra columns are
kept by the filter and ignored else, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textvec as V
from .common import free, union_all

#: 1: the word counts, 0: it is ignored.
MASKS = ("1101110011", "111010010111", "110010111011")
SPAN = max(map(len, MASKS))
SHORTEST = 4
MIN_SCORE = 10
MIN_SHARE = 0.6
MISMATCH = -2
SEEDS_AT_ONCE = 4_000_000
#: Bits of a hash that the filter before the search looks at, at least and at most.
_FILTER_BITS = 16, 25


def seeds(w: V.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask, (word index, hash) of each place where the mask fits into a text."""
    h = V.mix(w.hash)
    left = np.repeat(w.bounds[1:], w.counts()) - np.arange(len(h))
    out = []
    for number, mask in enumerate(MASKS):
        size = len(h) - len(mask) + 1
        if size <= 0:
            continue
        value = np.full(size, number + 1, np.uint64)
        for k, taken in enumerate(mask):
            if taken == "1":
                value *= np.uint64(0xD6E8FEB86659FD93)
                value += h[k : k + size]
        at = np.flatnonzero(left[:size] >= len(mask))
        out.append((at, V.mix(value[at])))
    return out


@dataclass
class Items:
    """Benchmark items: their words, and their seeds sorted by hash."""

    words: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    short_hash: np.ndarray  #: of the first SHORTEST words of items without seeds, sorted
    short_item: np.ndarray


def _filter(h: np.ndarray) -> np.ndarray:
    """Which leading bits some hash has: at least eight times as many values as hashes, within limits."""
    bits = int(np.clip(np.ceil(np.log2(max(1, 8 * len(h)))), *_FILTER_BITS))
    out = np.zeros(1 << bits, bool)
    out[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def _maybe(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    return known[(h >> np.uint64(65 - len(known).bit_length())).astype(np.int64)]


def index(texts: pa.Array) -> Items:
    words, sizes, hashes, items, places, short_hashes, short_items = [], [], [], [], [], [], []
    for w in V.slices(texts, V.ALNUM):
        n = w.counts()
        words.append(w.hash)
        sizes.append(n)
        for at, h in seeds(w):
            owner = np.searchsorted(w.bounds, at, side="right") - 1
            long = n[owner] >= SPAN
            hashes.append(h[long])
            items.append((owner + w.first)[long])
            places.append((at - w.bounds[owner])[long])
        some = np.flatnonzero((n >= SHORTEST) & (n < SPAN))
        if len(some):
            short_hashes.append(V.grams(w, SHORTEST)[0][w.bounds[some]])
            short_items.append(some + w.first)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    h = join(hashes, np.uint64)
    order = np.argsort(h, kind="stable")
    short = join(short_hashes, np.uint64)
    by = np.argsort(short, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(join(sizes, np.int64))))
    of, at = join(items, np.int64)[order], join(places, np.int64)[order]
    return Items(join(words, np.uint64), bounds, h[order], of, at, _filter(h), short[by], join(short_items, np.int64)[by])


def _segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(score, first, length) of the best segment; of equal scores the first start, then the shortest."""
    upto = np.concatenate(([0], np.cumsum(np.where(equal, 1, MISMATCH))))
    low = np.minimum.accumulate(upto)
    gain = upto - low
    best = int(gain.max())
    best_at = None
    for end in np.flatnonzero(gain == best):
        # The earliest start with that low reaches the same score, over more words.
        start = int(np.flatnonzero(upto[: end + 1] == low[end])[0])
        if best_at is None or (start, end - start) < best_at:
            best_at = (start, int(end) - start)
    return best, best_at[0], best_at[1]


def _met(known: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index among the sorted known hashes) of each pair of equal hashes."""
    lo, hi = np.searchsorted(known, h), np.searchsorted(known, h, side="right")
    n = hi - lo
    return np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _short(w: V.Words, items: Items):
    """(text, item, first word) of each place where a whole short item stands."""
    if not len(items.short_hash):
        return
    h, valid = V.grams(w, SHORTEST)
    at = np.flatnonzero(valid)
    at, pick = _met(items.short_hash, at, h[at])
    text = np.searchsorted(w.bounds, at, side="right") - 1
    for place, k, item in zip(at.tolist(), text.tolist(), items.short_item[pick].tolist()):
        theirs = items.words[items.bounds[item] : items.bounds[item + 1]]
        if place + len(theirs) <= w.bounds[k + 1] and (w.hash[place : place + len(theirs)] == theirs).all():
            yield k, item, int(place - w.bounds[k])


def overlaps(column, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word in the text, words, score) of the verified overlaps, best for each text and item."""
    out = []
    for w in V.slices(column, V.ALNUM):
        found = [np.zeros((0, 3), np.int64)]
        for at, h in seeds(w) if len(items.hash) else ():
            some = np.flatnonzero(_maybe(items.maybe, h))
            at, pick = _met(items.hash, at[some], h[some])
            text = np.searchsorted(w.bounds, at, side="right") - 1
            found.append(np.stack([text, items.item[pick], at - w.bounds[text] - items.place[pick]], axis=1))
        best: dict[tuple[int, int], tuple] = {}
        for text, item, first in _short(w, items):
            n = int(items.bounds[item + 1] - items.bounds[item])
            best[text, item] = min(best.get((text, item), (-n, first, n)), (-n, first, n))
        for text, item, moved in np.unique(np.concatenate(found), axis=0).tolist():
            theirs = items.words[items.bounds[item] : items.bounds[item + 1]]
            mine = w.hash[w.bounds[text] : w.bounds[text + 1]]
            first = max(0, -moved)
            last = min(len(theirs), len(mine) - moved)
            score, start, size = _segment(theirs[first:last] == mine[first + moved : last + moved])
            if score >= min(MIN_SCORE, -int(-MIN_SHARE * len(theirs) // 1)):
                row = (-score, first + moved + start, size)
                best[text, item] = min(best.get((text, item), row), row)
        out += [(text + w.first, item, row[1], row[2], -row[0]) for (text, item), row in best.items()]
    return out


def _parts(benchmark: DataFrame) -> list[pa.Table]:
    """The items with a text, in parts of about SEEDS_AT_ONCE seeds at most."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    passes = 1 + int(len(MASKS) * (size[0] or 0) // 4 // SEEDS_AT_ONCE)
    if passes == 1:
        return [items.toArrow()]
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    return [items.where(bucket == k).toArrow() for k in range(passes)]


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, score) of each document and item that overlap."""
    source = docs.select("doc_id", "text")
    kinds = source.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = StructType([StructField("doc_id", kinds[0]), StructField("item_id", kinds[1])])
    for name in ("first_word", "n_words", "score"):
        schema.add(name, LongType())

    def one(part: pa.Table) -> DataFrame:
        shared = source.sparkSession.sparkContext.broadcast((index(part["text"].combine_chunks()), part["item_id"].combine_chunks()))

        def find(batches):
            items, names = shared.value
            for batch in batches:
                rows = overlaps(batch.column(1), items)
                of = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of[:, 0])), names.take(pa.array(of[:, 1])), *(pa.array(of[:, k]) for k in (2, 3, 4))],
                    names=["doc_id", "item_id", "first_word", "n_words", "score"],
                )

        return source.mapInArrow(find, schema)

    return union_all([one(part) for part in _parts(benchmark)])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap no item, with docs's columns."""
    out = docs
    for part in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index(part["text"].combine_chunks()))

        @F.arrow_udf("boolean")
        def clean(text: pa.Array) -> pa.Array:
            keep = np.ones(len(text), bool)
            rows = overlaps(text, shared.value)  # noqa: B023
            keep[[r[0] for r in rows]] = False
            return pa.array(keep)

        flag = free(out, "is_clean")
        out = out.withColumn(flag, clean(F.col("text"))).where(F.col(flag)).drop(flag)
    return out
