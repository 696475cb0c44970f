"""Operator 2, SimHash near-duplicates: deletion-variant signatures.

A document's signature is a 128-bit SimHash of the set of its words (runs of
ASCII letters, digits and non-ASCII characters, lower-cased).  Documents whose
signatures differ in at most ``MAX_BITS`` bits are near-duplicates; every such
pair is found.  Different signatures are dealt into bands, and each pair of bands
is one task.  There signatures are cut into 6, 7 or 8 segments, whatever is least
work for their number; two that differ in at most ``MAX_BITS`` bits have a
segment that differs in no more than its share of them (pigeonhole).  So the task
looks up each segment with up to that many bits changed, and verifies all that
it meets on all bits.  Groups are the connected components of the verified pairs;
the smallest doc_id of a group stays.

No bucket is cut.  A task returns links that connect what all its pairs connect,
no more of them than it has signatures; in a bucket of very many copies a search
over the not yet reached signatures takes the place of comparing all pairs.  A
signature is shuffled once for each band (``BAND_ROWS`` signatures or fewer), so
work and shuffle grow with the square of the different signatures, both from
small beginnings.

Defined results: documents with a null id, or whose text is null, empty or
wordless, are in no group and stay.  Rows with the same id are one document if
their texts are equal too, else the same id counts once (the texts' groups are
joined); the filter keeps one row of a repeated row.  A very long text is one
signature of all its words.  Of equally similar documents the one with the
smallest id stays.  An empty table gives no rows; the filter keeps extra columns,
whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as V
from .common import checked, components, free, materialize, release

BITS = 128
SEGMENTS = 7
WIDTH = BITS // SEGMENTS
MAX_BITS = 22
#: Different signatures that a band holds at most, and above FEW_BANDS bands at least.
BAND_ROWS, FEW_ROWS, FEW_BANDS = 1_000_000, 50_000, 8
#: Pairs that are compared at once; buckets with more than PAIRS_SEARCHED are searched.
PAIRS_AT_ONCE, PAIRS_SEARCHED = 1 << 18, 1 << 20


def signatures(array) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of 2 x 64 bits, number of different words) of each text."""
    out, size = np.zeros((len(array), 2), np.uint64), np.zeros(len(array), np.int64)
    for w in V.slices(array, V.ALNUM):
        text = w.text_of()
        order = np.lexsort((w.hash, text))
        h, text = w.hash[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        bounds = np.searchsorted(text[new], np.arange(len(w.bounds)))
        at = slice(w.first, w.first + len(w.bounds) - 1)
        out[at], size[at] = V.simhash(h[new], bounds, 2), np.diff(bounds)
    return out, size


def variants(sig: np.ndarray) -> np.ndarray:
    """The one-wildcard variants of each signature: SEGMENTS * WIDTH keys in a row."""
    mask = np.uint64((1 << WIDTH) - 1)
    out = np.empty((len(sig), SEGMENTS * WIDTH), np.uint64)
    for s in range(SEGMENTS):
        lane, at = divmod(s * WIDTH, 64)
        part = sig[:, lane] >> np.uint64(at)
        if at + WIDTH > 64:
            part = part | (sig[:, lane + 1] << np.uint64(64 - at))
        part = part & mask
        for k in range(WIDTH):
            tag = np.uint64((s * WIDTH + k) << WIDTH)
            out[:, s * WIDTH + k] = tag | (part & ~np.uint64(1 << k))
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def links(sig: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes that connect what all verified pairs within one bucket connect."""
    left, first, second = np.arange(len(sig)), [], []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = differing(sig[left], sig[x]) <= most
            found = left[near]
            if len(found):
                first.append(np.full(len(found), x))
                second.append(found)
                stack += found.tolist()
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def bucket_edges(key: np.ndarray, node: np.ndarray, sig: np.ndarray, most: int = MAX_BITS, small: int = 32) -> np.ndarray:
    """Verified links (pairs of nodes, each once) of all buckets of equal keys."""
    order = np.argsort(key, kind="stable")
    key, node, sig = key[order], node[order], sig[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    out = []
    for d in range(1, small):  # small buckets: all pairs, a distance at a time
        rows = start[(size > d) & (size <= small)]
        of = size[(size > d) & (size <= small)]
        if len(rows):
            n = of - d
            a = np.repeat(rows, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            near = differing(sig[a], sig[a + d]) <= most
            out.append(np.stack([node[a][near], node[a + d][near]], axis=1))
    for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
        a, b = links(sig[s : s + n], most)
        out.append(np.stack([node[s + a], node[s + b]], axis=1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    pairs = np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)
    return np.unique(pairs, axis=0)


def cuts(most: int, n: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, bits that may differ) of the segments that are least work for n signatures.

    Of signatures that differ in at most most bits, one segment at least differs in
    no more than it may: else all together differ in the sum of (may + 1), most + 1.
    """
    best = None
    for m in (6, 7, 8):
        spare, out, at, work = most + 1 - m, [], 0, 0.0
        if spare < 0:
            raise ValueError(f"at least {m - 1} bits may differ")
        for k in range(m):
            width, may = BITS // m + (k < BITS % m), spare // m + (k < spare % m)
            out.append((at, width, may))
            at += width
            near = sum(comb(width, r) for r in range(may + 1))
            # A look-up costs about a third of a comparison.
            work += near * (min(n, 1 << width) / 3 + n * n / (1 << width))
        if best is None or work < best[0]:
            best = work, out
    return best[1]


def segment(sig: np.ndarray, at: int, width: int) -> np.ndarray:
    lane, at = divmod(at, 64)
    part = sig[:, lane] >> np.uint64(at)
    if at + width > 64:
        part = part | (sig[:, lane + 1] << np.uint64(64 - at))
    return (part & np.uint64((1 << width) - 1)).astype(np.int64)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give what the pairs (a, b) connect the same label, that of its smallest index."""
    while True:
        x, y = label[a], label[b]
        other = x != y
        if not other.any():
            return
        a, b, x, y = a[other], b[other], x[other], y[other]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            following = label[label]
            if (following == label).all():
                break
            label[:] = following


def band_links(sig: np.ndarray, split: int, most: int = MAX_BITS) -> np.ndarray:
    """For each of two bands' signatures (the second begins at split, or there is one alone) the smallest index that it is connected to.

    All pairs of a signature of the one and one of the other that differ in at most
    most bits are connected (of one band, all its pairs).
    """
    label = np.arange(len(sig))
    alone = split == len(sig)
    if not split:
        return label

    def by_value(value: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(value, kind="stable")
        values, start, count = np.unique(value[order], return_index=True, return_counts=True)
        return order + first, values, start, count

    for at, width, may in cuts(most, max(split, len(sig) - split)):
        value = segment(sig, at, width)
        order, values, start, count = by_value(value[:split], 0)
        order2, values2, start2, count2 = (order, values, start, count) if alone else by_value(value[split:], split)
        lane, lane2 = sig[order, 0], sig[order2, 0]
        where = np.full(1 << width, -1, np.int32)
        where[values2] = np.arange(len(values2))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def compare() -> None:
            i, j = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            n, n2 = count[i], count2[j]
            for k in np.flatnonzero(n * n2 > PAIRS_SEARCHED).tolist():
                some = np.concatenate((order[start[i[k]] :][: n[k]], order2[start2[j[k]] :][: n2[k]]))
                some = np.unique(some) if alone else some
                a, b = links(sig[some], most)
                join_labels(label, some[a], some[b])
            small = n * n2 <= PAIRS_SEARCHED
            i, j, n, n2 = i[small], j[small], n[small], n2[small]
            upto = np.cumsum(n * n2)
            begin = 0
            while begin < len(i):  # so many pairs at a time
                stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right")))
                k, m, m2 = slice(begin, stop), n[begin:stop], n2[begin:stop]
                size = m * m2
                if size.max() == 1:
                    x, y = start[i[k]], start2[j[k]]
                else:
                    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    wide = np.repeat(m2, size)
                    row = place // wide
                    x, y = np.repeat(start[i[k]], size) + row, np.repeat(start2[j[k]], size) + place - row * wide
                differ = np.bitwise_count(lane[x] ^ lane2[y])
                near = np.flatnonzero(differ <= most)  # few are, so the other lane is read for these alone
                a, b = order[x[near]], order2[y[near]]
                near = differ[near] + np.bitwise_count(sig[a, 1] ^ sig[b, 1]) <= most
                join_labels(label, a[near], b[near])
                begin = stop

        for r in range(may + 1):
            for bits in combinations(range(width), r):
                mask = sum(1 << x for x in bits)
                other = values ^ mask
                j = where[other]
                i = np.flatnonzero((j >= 0) & (values <= other) if alone else j >= 0)
                if len(i):
                    j = j[i]
                    waiting.append((i, j))
                    held += int((count[i] * count2[j]).sum())
                    if held >= PAIRS_AT_ONCE:
                        compare()
                        held = 0
        if waiting:
            compare()
    return label


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, root) of each document in a group of at least two, root the smallest id of its group."""

    def sign(batches):
        for batch in batches:
            sig, size = signatures(batch.column(1))
            keep = pa.array(size > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sig[:, 0].view(np.int64)), pa.array(sig[:, 1].view(np.int64))], names=["id", "s0", "s1"]
            ).filter(keep)

    ids = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    signed = materialize(ids.mapInArrow(sign, "id bigint, s0 bigint, s1 bigint"), "signatures")
    nodes = materialize(signed.groupBy("s0", "s1").agg(F.min("id").alias("node")), "nodes")

    n = nodes.count()
    bands = max(-(-n // BAND_ROWS), min(FEW_BANDS, -(-n // FEW_ROWS)), 1)

    def join(batches):
        some = [b for b in batches if b.num_rows]
        if some:
            t = pa.Table.from_batches(some)
            second, node, s0, s1 = (t.column(name).to_numpy() for name in ("second", "node", "s0", "s1"))
            order = np.argsort(second, kind="stable")
            node = node[order]
            label = band_links(np.stack([s0.view(np.uint64), s1.view(np.uint64)], axis=1)[order], int((~second).sum()))
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[linked]]), pa.array(node[linked])], names=["a", "b"])

    # Bands i <= k meet in the partition of their number among all pairs of bands.
    dealt = nodes.withColumn("band", F.pmod(F.xxhash64("s0", "s1"), F.lit(bands)).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    low, high = F.least("band", "with"), F.greatest("band", "with")
    dealt = dealt.select((high * (high + 1) / 2 + low).cast("int").alias("task"), (F.col("band") > F.col("with")).alias("second"), "node", "s0", "s1")
    met = dealt.repartitionById(bands * (bands + 1) // 2, "task").mapInArrow(join, "a bigint, b bigint")
    # A document with several signatures (its id repeats) joins their groups.
    same = signed.join(nodes, ["s0", "s1"]).select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b")
    edges = materialize(met.unionAll(same).distinct(), "near")
    out = components(edges).select(F.col("node").alias("doc_id"), "root")
    release(edges, signed, nodes)
    return materialize(out, "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_id) of each document that goes, and the document of its group that stays."""
    return groups(docs).where("doc_id <> root").select("doc_id", F.col("root").alias("kept_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, with docs's columns."""
    gone = groups(docs).where("doc_id <> root").select(F.col("doc_id").alias(free(docs, "gone_id")))
    kept = docs.join(checked(gone), docs["doc_id"].cast("bigint") == gone[gone.columns[0]], "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    # Ids that repeat are rare: one row of each stays, the one with the longest text.
    n, again = free(docs, "copy_number"), free(docs, "again_id")
    seldom = repeated.select(F.col("doc_id").alias(again))
    once = kept.join(seldom, kept["doc_id"] == seldom[again], "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text"))
    many = kept.join(seldom, kept["doc_id"] == seldom[again], "left_semi").withColumn(n, F.row_number().over(first))
    return once.unionByName(many.where(F.col(n) == 1).drop(n))
