"""BM25 as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K, B, FUZZ_PENALTY = 1.5, 0.75, 0.8


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def term_bm25(tf: Column, df: Column, n_docs: Column, n_distinct: Column, avg_doc_len: Column, distance: Column) -> Column:
    """A term's share of a score: the document's length is its number of distinct tokens."""
    norm = F.lit(K) * (F.lit(1.0 - B) + F.lit(B) * n_distinct / avg_doc_len)
    return idf(n_docs, df) * tf * (K + 1.0) / (tf + norm) * F.pow(F.lit(FUZZ_PENALTY), distance)
