"""Operator 6, token-id output: patched frame-of-reference blocks.

A text's token ids are cut into blocks of ``BLOCK``.  From each block its least
id is subtracted; the differences are packed at the number of bits that
``PERCENTILE`` of them need; those that need more are exceptions, whose high
bits follow the packed ones.  A block is

    base uint32 | width uint8 | exceptions uint8 | count uint8 | 0 |
    packed low bits, ceil(count * width / 8) bytes, least bit first |
    position uint8 of each exception | high bits uint32 of each exception

in little-endian order.  ``block_starts`` gives the byte at which each block of
a payload starts, so a block can be decoded alone.

Defined results: null, empty texts have 0 tokens, an empty payload and no
blocks; ids are kept as they are, null included; rows that repeat are encoded
each time.  Texts are encoded whole, very long ones, too; the strings of special
tokens are ordinary text.  Ids that tie at the percentile need the same width.  An
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import tokenizer_path

BLOCK = 128
PERCENTILE = 0.9
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SLICE_IDS = 1 << 17
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once in a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Encode consecutive runs of ids, counts[i] to run i.

    Returns (payload bytes, offset of each run, block starts within their runs,
    offset of each run's block starts).
    """
    per_run = -(-counts // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(per_run)))
    n_blocks = int(first_block[-1])
    run_of = np.repeat(np.arange(len(counts)), per_run)
    nth = np.arange(n_blocks) - first_block[:-1][run_of]
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1][run_of] + nth * BLOCK
    size = np.minimum(BLOCK, counts[run_of] - nth * BLOCK)
    at = np.minimum(begin[:, None] + np.arange(BLOCK), len(ids) - 1) if n_blocks else np.zeros((0, BLOCK), np.int64)
    inside = np.arange(BLOCK) < size[:, None]
    value = ids[at].astype(np.uint32) if n_blocks else np.zeros((0, BLOCK), np.uint32)
    base = np.where(inside, value, np.uint32(0xFFFFFFFF)).min(axis=1, initial=0xFFFFFFFF).astype(np.uint32)
    rest = np.where(inside, value - base[:, None], np.uint32(0))
    ordered = np.sort(np.where(inside, rest, np.uint32(0xFFFFFFFF)), axis=1)
    chosen = ordered[np.arange(n_blocks), np.maximum(np.ceil(PERCENTILE * size).astype(np.int64) - 1, 0)] if n_blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.int64)
    high = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    outlier = high > 0
    n_out = outlier.sum(axis=1)
    packed = -(-size * width // 8)
    length = 8 + packed + 5 * n_out
    start = np.concatenate(([0], np.cumsum(length)))
    out = np.zeros(int(start[-1]), np.uint8)
    head = np.zeros((n_blocks, 8), np.uint8)
    head[:, :4] = base.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5], head[:, 6] = width, n_out, size
    out[start[:-1, None] + np.arange(8)] = head
    low = rest & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        words = np.zeros((2 * w + 1, len(rows)), np.uint64)
        mine = np.ascontiguousarray(low[rows].T).astype(np.uint64)
        for i in range(BLOCK):
            k, shift = divmod(i * w, 64)
            words[k] |= mine[i] << np.uint64(shift)
            if shift + w > 64:
                words[k + 1] |= mine[i] >> np.uint64(64 - shift)
        flat = np.ascontiguousarray(words[:-1].T).astype("<u8").view(np.uint8).reshape(len(rows), 16 * w)
        full = packed[rows] == 16 * w
        out[start[:-1][rows[full], None] + 8 + np.arange(16 * w)] = flat[full]
        for r, line in zip(rows[~full].tolist(), flat[~full]):
            out[start[r] + 8 : start[r] + 8 + packed[r]] = line[: packed[r]]
    block, place = np.nonzero(outlier)
    if len(block):
        order = np.arange(len(block)) - np.concatenate(([0], np.cumsum(n_out)))[:-1][block]
        tail = start[:-1][block] + 8 + packed[block]
        out[tail + order] = place
        out[(tail + n_out[block] + 4 * order)[:, None] + np.arange(4)] = high[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    run_start = start[first_block]
    return out, run_start, start[:-1] - run_start[:-1][run_of], first_block


def unpack(payload: bytes) -> list[int]:
    """The ids of a payload (or of the part of it from a block's start on)."""
    out: list[int] = []
    data, at = memoryview(payload), 0
    while at < len(data):
        base = int.from_bytes(data[at : at + 4], "little")
        width, n_out, size = data[at + 4], data[at + 5], data[at + 6]
        at += 8
        n = -(-size * width // 8)
        bits = int.from_bytes(data[at : at + n], "little")
        values = [(bits >> (i * width)) & ((1 << width) - 1) for i in range(size)]
        at += n
        for k in range(n_out):
            high = at + n_out + 4 * k
            values[data[at + k]] |= int.from_bytes(data[high : high + 4], "little") << width
        at += 5 * n_out
        out += [base + v for v in values]
    return out


def encode_column(texts: pa.Array, path: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of tokens, payload, block starts) of each text."""
    encode = encoding(path).encode_ordinary
    n = len(texts)
    counts, parts = np.zeros(n, np.int64), []
    group: list[np.ndarray] = []
    held, first = 0, 0

    def close(last: int) -> None:
        ids = np.concatenate(group) if group else np.zeros(0, np.uint32)
        parts.append(pack(ids, counts[first:last]))
        group.clear()

    for k, text in enumerate(texts):
        text = text.as_py()
        if text:
            ids = np.array(encode(text), np.uint32)
            counts[k] = len(ids)
            group.append(ids)
            held += len(ids)
        if held >= _SLICE_IDS:
            close(k + 1)
            held, first = 0, k + 1
    if first < n:
        close(n)
    data = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)
    ends = np.concatenate([np.zeros(1, np.int64), *(np.diff(p[1]) for p in parts)]).cumsum()
    starts = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
    lists = np.concatenate([np.zeros(1, np.int64), *(np.diff(p[3]) for p in parts)]).cumsum()
    payload = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return pa.array(counts), payload.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(starts))


def token_blocks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, payload, block_starts) of each document."""
    path = path or tokenizer_path(VOCABULARY)
    source = docs.select("doc_id", F.col("text"))
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType)])
    schema.add("n_tokens", LongType()).add("payload", BinaryType()).add("block_starts", ArrayType(IntegerType()))

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), *encode_column(some.column(1), path)], names=["doc_id", "n_tokens", "payload", "block_starts"])

    return source.mapInArrow(encode, schema)
