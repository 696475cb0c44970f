"""Text analysis as column expressions: words, stop words, positions, postings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .stemmer import stem

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP_WORDS = frozenset(
    "a and are as at be but by for if in into is it no not of on or s such t that the their then there these they "
    "this to was will with www".split()
)
#: Words that Python groups or stems at once (some 200 bytes of memory each), and stems that it remembers.
WORDS_AT_ONCE, STEMS_KEPT = 100_000, 100_000
#: Word boundaries as Unicode's annex 29 has them.  What extends a character stays with it.
_E = r"\p{M}\p{Cf}&&[^\x{200B}]"
_SINGLES = r"\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}"
_KANA = r"\p{IsKatakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}"
#: Letters that join up: not ideographs, hiragana and the scripts of South East Asia, which are words of one character, nor katakana.
_L = rf"[\p{{L}}\p{{Nl}}&&[^{_SINGLES}{_KANA}]]"
#: Most letters and digits, in plain ranges that are matched fast.
_FAST_LETTER = r"a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
_LETTER = rf"(?:[{_FAST_LETTER}]|{_L})"
_MORE = rf"(?:[0-9{_FAST_LETTER}]++|[{_L}\p{{Nd}}[{_E}]]++)"
_MID_LETTER = r"['.:\x{B7}\x{387}\x{55F}\x{5F4}\x{2018}\x{2019}\x{2024}\x{2027}\x{FE13}\x{FE52}\x{FE55}\x{FF07}\x{FF0E}\x{FF1A}]"
_MID_DIGIT = r"['.,;\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2018}\x{2019}\x{2024}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE52}\x{FE54}\x{FF07}\x{FF0C}\x{FF0E}\x{FF1B}]"
_JOIN = (
    rf"(?! )(?:{_MID_LETTER}(?<={_LETTER}[{_E}]{{0,8}}.)[{_E}]*+(?={_LETTER})|{_MID_DIGIT}(?<=\p{{Nd}}[{_E}]{{0,8}}.)[{_E}]*+(?=\p{{Nd}}))"
)
_RUN = rf"(?:[0-9{_FAST_LETTER}]|[{_L}\p{{Nd}}]){_MORE}*+(?:{_JOIN}{_MORE}++)*+"
_KANA_RUN = rf"[{_KANA}][{_KANA}[{_E}]]*+"
_LINK = rf"\p{{Pc}}[\p{{Pc}}[{_E}]]*+"
#: What begins no word is passed over fast.  All loops are possessive: they neither back up nor recurse, however long a word is.
WORD_PATTERN = (
    rf"(?![\x00-/:-\x{{5E}}`\x7B-\x{{A9}}])(?:(?:(?<!\p{{Pc}}){_LINK})?+(?:{_RUN}|{_KANA_RUN})(?:(?! ){_LINK}(?:{_RUN}|{_KANA_RUN}))*+(?:(?! ){_LINK})?+"
    rf"|[{_SINGLES}&&[\p{{L}}\p{{N}}]][{_E}]*+|[\p{{L}}\p{{N}}][{_E}]*+)"
)
#: The same for lower-cased ASCII text.
ASCII_PATTERN = (
    r"(?:(?<!_)_++)?+[a-z0-9]++(?:(?! )(?:['.:](?<=[a-z].)(?=[a-z])|['.,;](?<=[0-9].)(?=[0-9])|_++(?=[a-z0-9]))[a-z0-9]++)*+(?:_++)?+"
)


@dataclass(frozen=True)
class Analyzer:
    """How documents and query terms become tokens."""

    stop_words: frozenset[str] = STOP_WORDS
    stem: bool = True

    @classmethod
    def of(cls, stop_words: Iterable[str] | None = None, stem: bool = True) -> Analyzer:
        return cls(STOP_WORDS if stop_words is None else frozenset(stop_words), stem)


def ascii_lower(text: Column) -> Column:
    """Lower case of the ASCII letters alone."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order, lower-cased; null gives none."""
    lower = ascii_lower(text)
    every, plain = (F.regexp_extract_all(lower, F.lit(p), F.lit(0)) for p in (WORD_PATTERN, ASCII_PATTERN))
    return F.coalesce(F.when(F.octet_length(text) == F.length(text), plain).otherwise(every), F.array().cast("array<string>"))


def kept_words(text: Column, analyzer: Analyzer = Analyzer()) -> Column:
    """The words that are no stop words: those that take positions."""
    if not analyzer.stop_words:
        return words(text)
    return F.filter(words(text), lambda w: ~w.isin(*sorted(analyzer.stop_words)))


def _slices(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of lists of WORDS_AT_ONCE words at most; a longer list is one of its own."""
    ends, a = np.asarray(lists.offsets), 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, int(ends[a]) + WORDS_AT_ONCE, side="right")) - 1)
        yield a, b
        a = b


def _stems(words: pa.Array, known: dict[str, str]) -> pa.Array:
    """The stems of words; known: those of words seen before, some of them."""
    if len(known) > STEMS_KEPT:
        known.clear()
    out = []
    for w in words.to_pylist():
        if (x := known.get(w)) is None:
            x = known[w] = stem(w)
        out.append(x)
    return pa.array(out, pa.string())


@F.arrow_udf(ArrayType(StringType()))
def stem_lists(words: pa.Array) -> pa.Array:
    """Lists of words with each word stemmed; Python sees the different words alone, of some lists at a time."""
    known: dict[str, str] = {}
    parts = [pa.array([], pa.string())]
    for a, b in _slices(words):
        flat = words.slice(a, b - a).flatten().dictionary_encode()
        parts.append(_stems(flat.dictionary, known).take(flat.indices))
    ends = np.asarray(words.offsets)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.concat_arrays(parts))


def tokens(text: Column, analyzer: Analyzer = Analyzer()) -> Column:
    """A text's tokens: its kept words, stemmed if the analyzer stems."""
    kept = kept_words(text, analyzer)
    return stem_lists(kept) if analyzer.stem else kept


def occurrences(docs: DataFrame, analyzer: Analyzer = Analyzer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token): a row for each kept word of each document.  Nothing is shuffled."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(F.col(text_col), analyzer)).alias("pos", "token"))


def _grouped(ids: pa.Array, lists: pa.ListArray, known: dict[str, str] | None) -> pa.RecordBatch:
    """Rows of indexed() of some documents; known: for _stems(), None if words aren't stemmed."""
    bounds = np.asarray(lists.offsets, np.int64)
    bounds = bounds - bounds[0]
    flat = lists.flatten().dictionary_encode()
    code, names = np.asarray(flat.indices, np.int64), flat.dictionary
    if known is not None:
        stems = _stems(names, known).dictionary_encode()
        code, names = np.asarray(stems.indices, np.int64)[code], stems.dictionary
    width = len(names).bit_length()
    key = np.repeat(np.arange(len(lists)), np.diff(bounds)) << width | code
    order = np.argsort(key, kind="stable")
    key = key[order]
    pos = order - bounds[key >> width]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    distinct = np.bincount(key[at] >> width, minlength=len(lists))
    ends = pa.array(np.concatenate(([0], np.cumsum(distinct))), pa.int32())
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), pa.array(pos, pa.int32()))
    own = names.take(pa.array(key[at] & ((1 << width) - 1)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(bounds)), pa.array(distinct, pa.int64()), pa.ListArray.from_arrays(ends, own), pa.ListArray.from_arrays(ends, places)],
        names=["doc_id", "len", "n_distinct", "tokens", "positions"],
    )


def _analyzed(batches: Iterable[pa.RecordBatch], stemming: bool) -> Iterator[pa.RecordBatch]:
    """Rows of indexed() from batches of (doc_id, words), of some documents at a time."""
    known: dict[str, str] | None = {} if stemming else None
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        for a, b in _slices(lists):
            yield _grouped(ids.slice(a, b - a), lists.slice(a, b - a), known)


def indexed(docs: DataFrame, analyzer: Analyzer = Analyzer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings and lengths in one pass, of which nothing is shuffled.

    (doc_id, len, n_distinct, tokens, positions): a row for each row of docs, in
    their order, also if it has no tokens; its different tokens, and for each of
    them its positions.  What Python holds beyond a batch of lists of words
    depends on WORDS_AT_ONCE, not on how many documents the batch has.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), kept_words(F.col(text_col), analyzer).alias("words"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType)]).add("len", LongType()).add("n_distinct", LongType())
    schema.add("tokens", ArrayType(StringType())).add("positions", ArrayType(ArrayType(IntegerType())))
    stemming = analyzer.stem
    return rows.mapInArrow(lambda batches: _analyzed(batches, stemming), schema)


def postings(indexed: DataFrame) -> DataFrame:
    """(token, doc_id, tf, n_distinct, positions), positions ascending."""
    each = indexed.select("doc_id", "n_distinct", F.explode(F.arrays_zip("tokens", "positions")).alias("x"))
    return each.select(
        F.col("x.tokens").alias("token"), "doc_id", F.size("x.positions").cast("bigint").alias("tf"), "n_distinct", F.col("x.positions").alias("positions")
    )


def doc_stats(indexed: DataFrame) -> DataFrame:
    """(doc_id, len, n_distinct, tokens) of every document, also of one without tokens."""
    return indexed.select("doc_id", "len", "n_distinct", "tokens")


def vocabulary(postings: DataFrame) -> DataFrame:
    """(token, df, n_chars, n_bytes)."""
    return with_lengths(postings.groupBy("token").agg(F.count("*").alias("df")))


def with_lengths(vocab: DataFrame) -> DataFrame:
    return vocab.select("token", "df", F.length("token").alias("n_chars"), F.octet_length("token").alias("n_bytes"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row (n_docs, avg_doc_len); the average is null without documents."""
    return doc_stats.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_doc_len"))
