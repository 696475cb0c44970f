"""Operator 4, suffix-array dedup: the difference-cover algorithm, distributed.

Found are all passages of at least ``MIN_WORDS`` words that occur twice or more
in the corpus.  Words are runs of ASCII letters, digits and non-ASCII
characters, lower-cased.

1. Text that can't be part of such a passage is set aside, without loss.  Every
   ``SEED``-word sequence is hashed and winnowed with a window of ``MIN_WORDS -
   SEED + 1``: two equal passages have the same selected sequences, one in every
   window, so only the surroundings of selected sequences that occur twice need
   sorting.  Documents with the same words are one here.
2. Those regions are the strings of a generalised suffix array.  Suffixes at
   places that aren't multiples of 3 (the difference cover) are sorted by their
   triples of words and named; the names make a string of two thirds the length,
   whose suffixes are sorted in the same way.  After ``LEVELS`` sorts a name
   stands for 3**LEVELS words, more than ``MIN_WORDS``: suffixes that are still
   alike can stay in any order.  Going back up, each level's remaining suffixes
   are merged with the sorted ones, comparing (word, rank) or (word, word, rank).
3. Neighbours in the suffix array whose first ``MIN_WORDS`` words are the same
   (a 64-bit fingerprint of them) mark repeated places; their union are spans.

Sorting is a range partition of packed numpy records: a row that Spark moves is
a block of records that go from one chunk of strings to one range, so nothing is
spent on single suffixes in the JVM, and bytes of equal significance stand
together, so that shuffles compress.  Equal triples always meet in one range.

Defined results: a span is (doc_id, first_word, n_words, removable_words), the
last being how many of its words lie in a passage that occurs earlier, in a
document with a smaller id or before in the same one.  Documents with a null id
or a null, empty or wordless text are not searched.  Rows with the same id and
words are one document.  Among different texts with the same id any may count
as the earlier.  A very long text is searched whole.  An empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .common import materialize, release, tidy

MIN_WORDS = 50
SEED = 20
WINDOW = MIN_WORDS - SEED + 1
LEVELS = 4
assert 3**LEVELS >= MIN_WORDS
#: A word's code has so many bits, so that three fit in 64; 0 is the end of a region.
CODE_BITS = 21
#: Words in a chunk of regions, and suffixes in a range, about.
CHUNK = 1 << 18
RANGE = 1 << 18
#: Selected sequences in a bucket.
BUCKET = 1 << 20
#: Keys from which a level's ranges are chosen: so many, or some for each range.
SAMPLE, EACH = 200_000, 8
_U = np.uint64


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) of x[i:i+width], for each i that has so many."""
    size, out = 1, x
    while size < width:
        step = min(size, width - size)
        out = of(out[: len(out) - step], out[step:])
        size += step
    return out


def selected(h: np.ndarray) -> np.ndarray:
    """Places of the least hash of any WINDOW neighbouring ones; of equal ones all."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    least = _sliding(h, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, _U)
    return np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), WINDOW, np.maximum) == h)


def _cell(x: np.ndarray) -> bytes:
    """The values of an array (or its rows), all first bytes first: what is constant or small in them compresses away."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _values(cell: bytes, kind, width: int = 1) -> np.ndarray:
    """The array that _cell() stored; width: values in a row."""
    size = np.dtype(kind).itemsize * width
    x = np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(size, -1).T).view(kind)
    return x if width > 1 else x[:, 0]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_SKETCH = _schema(id=pa.int64(), h=pa.int64(), n_words=pa.int64(), hashes=pa.binary(), places=pa.binary())
_MET = _schema(id=pa.int64(), h=pa.int64(), places=pa.binary())
_REGION = _schema(id=pa.int64(), h=pa.int64(), first=pa.int64(), codes=pa.binary(), prints=pa.binary())
_CHUNK = _schema(chunk=pa.int64(), codes=pa.binary(), prints=pa.binary(), ids=pa.binary(), hs=pa.binary(), firsts=pa.binary(), at=pa.binary())
_STRING = _schema(chunk=pa.int64(), codes=pa.binary())
_PART = _schema(bucket=pa.int64(), chunk=pa.int64(), offs=pa.binary(), keys=pa.binary(), a=pa.binary(), b=pa.binary(), prints=pa.binary(), ids=pa.binary(), coarse=pa.binary())
_RANKS = _schema(chunk=pa.int64(), offs=pa.binary(), ranks=pa.binary())
_SPANS = _schema(id=pa.int64(), h=pa.int64(), first_word=pa.int64(), n_words=pa.int64(), removable_words=pa.int64())


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary'}" for f in schema)


def sketch(batches):
    """(id, hash of all words, number of words, selected sequences and their places) of each text that is long enough."""
    for batch in batches:
        ids, rows = batch.column(0).to_numpy(zero_copy_only=False), []
        for w in V.slices(batch.column(1), V.ALNUM):
            sums = V.prefix_sums(w)
            n = w.counts()
            whole = V.sequence_hash(sums, w.bounds[:-1], w.bounds[1:])
            for k in np.flatnonzero(n >= MIN_WORDS).tolist():
                first = np.arange(w.bounds[k], w.bounds[k + 1] - SEED + 1)
                h = V.sequence_hash(sums, first, first + SEED)
                at = selected(h)
                rows.append((int(ids[k + w.first]), int(whole[k].view(np.int64)), int(n[k]), _cell(h[at]), _cell(at.astype(np.int32))))
        if rows:
            yield from _batch(rows, _SKETCH).to_batches()


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, the columns' values in it) of each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    starts = np.append(np.flatnonzero(np.diff(sorted_, prepend=-1)), len(sorted_)) if len(sorted_) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield int(sorted_[a]), [c[a:b] for c in columns]


def _read(cells, kind, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(values of all cells, number of values (or rows of width values) in each cell)."""
    parts = [_values(c, kind, width) for c in cells.to_pylist()]
    none = np.zeros((0, width) if width > 1 else 0, kind)
    return np.concatenate(parts) if parts else none, np.array([len(x) for x in parts], np.int64)


def repeated_seeds(uniq: DataFrame) -> DataFrame:
    """(id, h, places): the selected sequences of each text that occur twice or more in the corpus."""
    total = uniq.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    buckets = max(1, -(-int(total) // 8 // BUCKET))
    kinds = _schema(bucket=pa.int64(), hashes=pa.binary(), ids=pa.binary(), hs=pa.binary(), places=pa.binary())

    def scatter(batches):
        for batch in batches:
            h, n = _read(batch.column(2), _U)
            place, _ = _read(batch.column(3), np.int32)
            ids = np.repeat(batch.column(0).to_numpy(), n)
            hs = np.repeat(batch.column(1).to_numpy(), n)
            bucket = ((h >> _U(32)) % _U(buckets)).astype(np.int64)
            rows = [(b, *map(_cell, c)) for b, c in _by_bucket(bucket, h, ids, hs, place)]
            if rows:
                yield from _batch(rows, kinds).to_batches()

    def meet(t: pa.Table) -> pa.Table:
        h, ids, hs, place = (_read(t[name], kind)[0] for name, kind in (("hashes", _U), ("ids", np.int64), ("hs", np.int64), ("places", np.int32)))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        ids, hs, place = ids[twice], hs[twice], place[twice]
        order = np.lexsort((hs, ids))
        ids, hs, place = ids[order], hs[order], place[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1])
        at = np.append(np.flatnonzero(new), len(ids))
        return _batch([(int(ids[a]), int(hs[a]), _cell(place[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], _MET)

    parts = uniq.select("id", "h", "hashes", "places").mapInArrow(scatter, _ddl(kinds))
    return parts.groupBy("bucket").applyInArrow(meet, _ddl(_MET))


def regions(batches):
    """The surroundings of repeated sequences: codes of their words, and fingerprints of the MIN_WORDS words from each on."""
    shift = _U(64 - CODE_BITS)
    for batch in batches:
        ids, hs, parts = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
        rows = []
        for w in V.slices(batch.column(2), V.ALNUM):
            sums = V.prefix_sums(w)
            whole = V.sequence_hash(sums, w.bounds[:-1], w.bounds[1:]).view(np.int64)
            code = np.maximum(V.mix(w.hash) >> shift, _U(1)).astype(np.int32)
            for k in range(len(w.bounds) - 1):
                if whole[k] != hs[k + w.first]:
                    continue  # another text with the same id
                n = int(w.bounds[k + 1] - w.bounds[k])
                place = np.sort(np.concatenate([_values(x, np.int32) for x in parts[k + w.first]])).astype(np.int64)
                a, b = np.maximum(place - (WINDOW - 1), 0), np.minimum(place + SEED + WINDOW - 1, n)
                cut = np.flatnonzero(a[1:] > b[:-1])
                for first, end in zip(a[np.append(0, cut + 1)].tolist(), b[np.append(cut, len(b) - 1)].tolist()):
                    at = np.arange(w.bounds[k] + first, w.bounds[k] + end - MIN_WORDS + 1)
                    if len(at):
                        prints = V.sequence_hash(sums, at, at + MIN_WORDS)
                        rows.append((ids[k + w.first], int(whole[k]), first, _cell(code[w.bounds[k] + first : w.bounds[k] + end]), _cell(prints)))
        if rows:
            yield from _batch(rows, _REGION).to_batches()


def chunks(batches):
    """Regions strung together; a region is followed by zeros, at least three, up to a multiple of three."""
    number, held, size = TaskContext.get().partitionId() << 30, [], 0

    def close():
        at = np.cumsum([0] + [x[3] for x in held[:-1]], dtype=np.int64)
        codes, prints = np.zeros(size, np.int32), np.zeros(size, _U)
        for start, (_, _, _, _, c, p) in zip(at.tolist(), held):
            codes[start : start + len(c)] = c
            prints[start : start + len(p)] = p
        of = [np.array([x[k] for x in held], np.int64) for k in range(3)]
        return _batch([(number, _cell(codes), _cell(prints), *map(_cell, of), _cell(at))], _CHUNK).to_batches()

    for batch in batches:
        for id, h, first, code, prints in zip(*(c.to_pylist() for c in batch.columns)):
            code, prints = _values(code, np.int32), _values(prints, _U)
            room = -(-(len(code) + 3) // 3) * 3
            held.append((id, h, first, room, code, prints))
            size += room
            if size >= CHUNK:
                yield from close()
                number, held, size = number + 1, [], 0
    if held:
        yield from close()


def _keys(codes: np.ndarray, level: int, at: np.ndarray) -> np.ndarray:
    """The triples at these places, a row each: one packed number at level 0, three names beyond."""
    x = np.concatenate((codes, np.zeros(2, codes.dtype))).astype(_U)
    if level == 0:
        return ((x[at] << _U(2 * CODE_BITS)) | (x[at + 1] << _U(CODE_BITS)) | x[at + 2])[:, None]
    return np.stack((x[at], x[at + 1], x[at + 2]), axis=1)


def _kind(level: int):
    return np.int32 if level == 0 else _U


def _ranges(strings: DataFrame, level: int, n: int) -> np.ndarray:
    """Bounds between ranges of about RANGE suffixes, by the first number of their keys."""
    wanted = -(-n // RANGE)
    if wanted <= 1:
        return np.zeros(0, _U)
    step = max(1, n // max(SAMPLE, EACH * wanted))

    def some(batches):
        for batch in batches:
            for chunk, codes in zip(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                codes = _values(codes, _kind(level))
                first = int(V.mix(np.array([chunk], np.int64).view(_U))[0] % _U(step))  # differs by chunk, which may be shorter than a step
                yield pa.RecordBatch.from_arrays([pa.array(_keys(codes, level, np.arange(first, len(codes), step))[:, 0].view(np.int64))], names=["key"])

    keys = np.sort(strings.select("chunk", "codes").mapInArrow(some, "key bigint").toPandas()["key"].to_numpy().view(_U))
    return np.unique(keys[(np.arange(1, wanted) * len(keys)) // wanted]) if len(keys) else keys


def _offsets(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, chunk of each row, offset) of all records of a table."""
    offs, n = _read(t["offs"], np.int32)
    return np.repeat(np.arange(len(n)), n), t["chunk"].to_numpy(), offs


def _back(row: np.ndarray, chunk: np.ndarray, offs: np.ndarray, values: np.ndarray) -> pa.Table:
    """Records grouped by the chunk that they belong to."""
    places, owner = np.unique(chunk, return_inverse=True)
    rows = [(int(places[k]), *map(_cell, c)) for k, c in _by_bucket(owner[row], offs, values)]
    return _batch(rows, _RANKS)


def _name_triples(strings: DataFrame, level: int, bounds: np.ndarray) -> DataFrame:
    """(chunk, offs, ranks): the names of the triples at the places of the difference cover, in order."""

    def scatter(batches):
        for batch in batches:
            for chunk, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = _values(codes, _kind(level))
                at = np.arange(len(codes))
                at = at[at % 3 != 0]
                keys = _keys(codes, level, at)
                bucket = np.searchsorted(bounds, keys[:, 0], side="right")
                rows = [(b, chunk, _cell(o), _cell(k)) for b, (o, k) in _by_bucket(bucket, at.astype(np.int32), keys)]
                yield from _batch(rows, pa.schema(list(_PART)[:4])).to_batches()

    def name(key, t):
        row, chunk, offs = _offsets(t)
        keys = _read(t["keys"], _U, 1 if level == 0 else 3)[0].reshape(len(offs), -1)
        order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        names = np.empty(len(keys), _U)
        names[order] = (_U(key[0].as_py() + 1) << _U(40)) + np.cumsum(new).astype(_U)
        return _back(row, chunk, offs, names)

    parts = strings.select("chunk", "codes").mapInArrow(scatter, _ddl(pa.schema(list(_PART)[:4])))
    return parts.groupBy("bucket").applyInArrow(name, _ddl(_RANKS))


def _shorter(key, t):
    """The string of names of a chunk: those at places 1, 4, ..., a zero, those at places 2, 5, ..."""
    _, _, offs = _offsets(t)
    names = _read(t["ranks"], _U)[0]
    second = offs % 3 == 2
    n1 = int((~second).sum())
    out = np.zeros(len(offs) + 1, _U)
    out[np.where(second, n1 + 1 + (offs - 2) // 3, (offs - 1) // 3)] = names
    return _batch([(key[0].as_py(), _cell(out))], _STRING)


def merge_order(keys: np.ndarray, offs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order of the suffixes of one range.

    keys: first and second code of each.  a: the rank of the suffix one place on
    (two places on at places 2, 5, ...); b: its own rank, or two places on at
    places 0, 3, ...
    """
    kind = offs % 3
    i0, i1, i2 = (np.flatnonzero(kind == k) for k in range(3))
    first = np.unique(keys[:, 0], return_inverse=True)[1].astype(_U)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    both = np.empty(len(order), _U)
    both[order] = np.cumsum(new).astype(_U)
    i12 = np.concatenate((i1, i2))
    i12 = i12[np.argsort(b[i12], kind="stable")]
    # Ranks as small numbers, so that a code and a rank fit in 64 bits.
    ranks = np.unique(np.concatenate((a, b[i0])), return_inverse=True)[1].astype(_U)
    one, two = ranks[: len(a)], ranks[len(a) :]
    key1 = (first << _U(32)) | one
    i0_order = np.argsort(key1[i0], kind="stable")
    i0, two = i0[i0_order], two[i0_order]
    less = np.searchsorted(np.sort(key1[i1]), key1[i0])
    less += np.searchsorted(np.sort((both[i2] << _U(32)) | one[i2]), (both[i0] << _U(32)) | two)
    # Suffixes alike in 3**LEVELS words may have been compared either way.
    at0 = np.maximum.accumulate(less) + np.arange(len(i0)) if len(i0) else np.zeros(0, np.int64)
    out = np.empty(len(offs), np.int64)
    taken = np.zeros(len(offs), bool)
    taken[at0] = True
    out[at0] = i0
    out[~taken] = i12
    return out


def _ranked_parts(level: int, last: bool, bounds: np.ndarray):
    """From a chunk's string and the ranks at its difference cover: what the merge compares, by range."""

    def parts(key, t):
        cells = t["codes"].to_pylist()
        whole = next(k for k, c in enumerate(cells) if c is not None)
        codes = _values(cells[whole], _kind(level))
        n = len(codes)
        known = t.filter(pa.compute.is_valid(t["offs"]))
        _, _, offs = _offsets(known)
        values = _read(known["ranks"], _U)[0]
        if not last:  # places in the string of names
            n1 = (n + 1) // 3
            keep = offs != n1
            offs, values = offs[keep], values[keep]
            offs = np.where(offs < n1, 3 * offs + 1, 3 * (offs - n1 - 1) + 2)
        rank = np.zeros(n + 2, _U)
        rank[offs] = values
        prints = _values(t["prints"].to_pylist()[whole], _U) if level == 0 else None
        at = np.flatnonzero(prints) if level == 0 else np.arange(n)
        third = at % 3
        a = np.where(third == 2, rank[at + 2], rank[at + 1])
        b = np.where(third == 0, rank[at + 2], rank[at])
        x = np.concatenate((codes, np.zeros(1, codes.dtype)))
        range_key = _keys(codes, level, at)[:, 0]
        keys = np.stack((x[at], x[at + 1]), axis=1)
        columns = [at.astype(np.int32), keys, a, b]
        if level == 0:
            starts = _values(t["at"].to_pylist()[whole], np.int64)
            ids = _values(t["ids"].to_pylist()[whole], np.int64)
            sums = np.zeros(n + 1, _U)
            np.cumsum(V.mix(codes.astype(_U)) * V.powers(V.BASE, n), out=sums[1:])
            # Neighbours that differ in it differ in their codes; others may, too: a few bits are enough.
            coarse = V.sequence_hash(sums, at, at + MIN_WORDS).astype(np.uint16)
            columns += [prints[at], ids[np.searchsorted(starts, at, side="right") - 1], coarse]
        bucket = np.searchsorted(bounds, range_key, side="right")
        chunk = key[0].as_py()
        rows = [(b, chunk, *map(_cell, c), *[None] * (7 - len(c))) for b, c in _by_bucket(bucket, *columns)]
        return _batch(rows, _PART)

    return parts


def _merge(level: int):
    def merge(key, t):
        row, chunk, offs = _offsets(t)
        keys = _read(t["keys"], _kind(level), 2)[0].astype(_U)
        order = merge_order(keys, offs, _read(t["a"], _U)[0], _read(t["b"], _U)[0])
        if level:
            rank = np.empty(len(order), _U)
            rank[order] = (_U(key[0].as_py() + 1) << _U(40)) + np.arange(len(order)).astype(_U) + _U(1)
            return _back(row, chunk, offs, rank)
        prints, ids = _read(t["prints"], _U)[0][order], _read(t["ids"], np.int64)[0][order]
        row, offs = row[order], offs[order]
        # Words may share a code: neighbours alike in their codes are told apart by their words.
        coarse = _read(t["coarse"], np.uint16)[0][order]
        alike = np.concatenate(([0], np.cumsum(coarse[1:] != coarse[:-1])))
        finer = np.lexsort((prints, alike))
        prints, ids, row, offs, alike = prints[finer], ids[finer], row[finer], offs[finer], alike[finer]
        same = (prints[1:] == prints[:-1]) & (alike[1:] == alike[:-1])
        run = np.concatenate(([0], np.cumsum(~same)))
        repeated = np.zeros(len(order), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        # The first of a run: the smallest id, then the first place.
        by = np.lexsort((offs, chunk[row], ids, run))
        first = np.zeros(len(order), np.uint64)
        first[by[np.concatenate(([True], run[by][1:] != run[by][:-1]))]] = 1
        return _back(row[repeated], chunk, offs[repeated], first[repeated])

    return merge


def _joined(strings: DataFrame, ranks: DataFrame) -> DataFrame:
    """A string's row and the rows of its ranks, to be grouped by chunk."""
    return strings.unionByName(ranks, allowMissingColumns=True).groupBy("chunk")


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the MIN_WORDS-word passages from starts on."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + MIN_WORDS, -1)
    return np.cumsum(edge)[:n] > 0


def _spans(t: pa.Table) -> pa.Table:
    cells = t["codes"].to_pylist()
    whole = next(k for k, c in enumerate(cells) if c is not None)
    meta = {name: _values(t[name].to_pylist()[whole], np.int64) for name in ("ids", "hs", "firsts", "at")}
    known = t.filter(pa.compute.is_valid(t["offs"]))
    if not known.num_rows:
        return _SPANS.empty_table()
    _, _, offs = _offsets(known)
    later = _read(known["ranks"], _U)[0] == 0
    n = len(cells[whole]) // 4
    inside, removable = _covered(offs, n), np.concatenate(([0], np.cumsum(_covered(offs[later], n))))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(meta["at"], a, side="right") - 1
    columns = [meta["ids"][of], meta["hs"][of], meta["firsts"][of] + a - meta["at"][of], b - a, removable[b] - removable[a]]
    return pa.table([pa.array(c) for c in columns], schema=_SPANS)


def _suffix_spans(pieces: DataFrame) -> DataFrame:
    """Spans within the chunks of regions, by the suffix array over all of them."""
    words = int(pieces.agg(F.sum(F.octet_length("codes"))).first()[0] or 0) // 4
    strings, bounds, n = [pieces], [], words
    ranks = None
    for level in range(LEVELS):
        bounds.append(_ranges(strings[level], level, n))
        ranks = _name_triples(strings[level], level, bounds[level])
        if level < LEVELS - 1:
            strings.append(materialize(ranks.groupBy("chunk").applyInArrow(_shorter, _ddl(_STRING)), "names"))
            n = 2 * n // 3
            ranks = None
            tidy(pieces.sparkSession)
    for level in reversed(range(LEVELS)):
        mine = strings[level]
        if level:
            mine = mine.select("chunk", "codes")
        below = ranks
        parts = _joined(mine, ranks).applyInArrow(_ranked_parts(level, level == LEVELS - 1, bounds[level]), _ddl(_PART))
        ranks = materialize(parts.groupBy("bucket").applyInArrow(_merge(level), _ddl(_RANKS)), "ranks")
        release(below, *([strings[level]] if level else []))
        parts = below = None
        tidy(pieces.sparkSession)
    spans = materialize(_joined(pieces.drop("prints"), ranks).applyInArrow(_spans, _ddl(_SPANS)), "spans")
    release(ranks)
    return spans


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words, removable_words) of each span of repeated passages."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("body")).where("id is not null and body is not null")
    sketches = materialize(source.mapInArrow(sketch, _ddl(_SKETCH)), "sketches")
    # One document for each word sequence: that with the smallest id.
    least = F.min(F.struct("id", "hashes", "places"))
    uniq = sketches.groupBy("h", "n_words").agg(least.alias("m")).select("h", "n_words", "m.*")
    met = repeated_seeds(uniq).groupBy("id", "h").agg(F.collect_list("places").alias("parts"))
    near = met.join(source, "id").select("id", "h", "body", "parts")
    found = near.mapInArrow(regions, _ddl(_REGION))
    if not sketches.groupBy("id", "h").count().where("count > 1").isEmpty():  # repeated rows
        found = found.dropDuplicates(["id", "h", "first"])
    pieces = materialize(found.mapInArrow(chunks, _ddl(_CHUNK)), "pieces")
    met = near = found = None
    tidy(docs.sparkSession)
    spans = _suffix_spans(pieces)
    # Documents with the same words: each is one span, to be removed but for the first.
    members = sketches.select("id", "h", "n_words").distinct()
    alike = members.groupBy("h", "n_words").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    whole = members.join(alike, ["h", "n_words"]).select("id", "h", "n_words", "least")
    own = spans.groupBy("id", "h").agg(F.sum("removable_words").alias("removable"))
    removable = F.when(F.col("id") == F.col("least"), F.coalesce("removable", F.lit(0))).otherwise(F.col("n_words"))
    copies = whole.join(own, ["id", "h"], "left").select("id", F.lit(0).cast("bigint").alias("first_word"), "n_words", removable.alias("removable_words"))
    single = spans.join(whole.select("id", "h"), ["id", "h"], "left_anti").drop("h")
    out = materialize(single.unionByName(copies).withColumnRenamed("id", "doc_id"), "passages")
    release(sketches, pieces, spans)
    return out
