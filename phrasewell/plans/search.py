"""The search plan: from query terms and index tables to ranked documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions.analysis import Analyzer
from ..functions.scoring import term_bm25
from ..operators.expand import expand, looked_up, terms_table
from ..operators.phrase import best_scores, candidates, intersect, promising_pairs, score_bound, small
from .query import Query, analyze, parse

#: So many expansions at most are looked up by value, so that the filter reaches the scan.
PUSHED_TOKENS = 500
#: Postings beyond which a query's rarest terms are looked at first (by their frequencies; results are the same).
MANY_POSTINGS = 1_000_000


@dataclass
class Tables:
    """What a search reads, of live documents."""

    documents: DataFrame  #: (doc_id, content)
    postings: DataFrame  #: (token, doc_id, tf, n_distinct, positions)
    vocab: DataFrame  #: (token, df, n_chars, n_bytes)
    corpus: DataFrame  #: one row (n_docs, avg_doc_len)


def from_documents(docs: DataFrame, analyzer: Analyzer = Analyzer(), id_col: str = "doc_id", text_col: str = "text") -> Tables:
    """Tables computed from documents alone, with no stored index."""
    indexed = analysis.indexed(docs, analyzer, id_col, text_col)
    postings = analysis.postings(indexed)
    documents = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"))
    return Tables(documents, postings, analysis.vocabulary(postings), analysis.corpus_stats(analysis.doc_stats(indexed)))


def parse_all(queries: dict[str, str], analyzer: Analyzer) -> dict[str, Query]:
    """Queries by id, analyzed; those of stop words alone have no terms and find nothing."""
    return {name: analyze(parse(text), analyzer) for name, text in queries.items()}


def weighted(expanded: DataFrame, tables: Tables, postings: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Postings of all expansions, or of pairs (query_id, doc_id) alone, with their share of a score."""
    found = candidates(expanded, tables.postings if postings is None else postings, pairs).crossJoin(F.broadcast(tables.corpus))
    weight = term_bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("n_distinct"), F.col("avg_doc_len"), F.col("distance"))
    return found.withColumn("weight", weight)


def scores(spark: SparkSession, tables: Tables, queries: dict[str, Query], push: bool = True, top_k: int = 0) -> DataFrame:
    """(query_id, doc_id, score) of all matches of all queries; with top_k, of one query's that can be among so many best."""
    queries = {name: q for name, q in queries.items() if q.terms}
    expanded = expand(terms_table(spark, queries), looked_up(tables.vocab, queries))
    postings = tables.postings
    rarest_first = len(queries) > 1
    if push:
        # A look at the expansions, at most so many: they prune the postings' row groups, and the vocabulary isn't read again.
        few = expanded.limit(PUSHED_TOKENS + 1).collect()
        if len(few) <= PUSHED_TOKENS:
            found: dict[str, set[int]] = {}
            for row in few:
                found.setdefault(row["query_id"], set()).add(row["term_idx"])
            whole = {name for name, terms in found.items() if len(terms) == len(queries[name].terms)}
            few = [row for row in few if row["query_id"] in whole]
            if not few:
                return spark.createDataFrame([], "query_id string, score double").join(tables.documents.select("doc_id"), F.lit(False)).select(
                    "query_id", "doc_id", "score"
                )
            postings = postings.where(F.col("token").isin(sorted({row["token"] for row in few})))
            expanded = F.broadcast(spark.createDataFrame(few, expanded.schema))
            rarest_first = len({row["term_idx"] for row in few}) > 1 and sum(row["df"] for row in few) > MANY_POSTINGS
    pairs = small(promising_pairs(expanded, postings)) if rarest_first else None
    hits = weighted(expanded, tables, postings, pairs)
    matched = intersect(hits.select("query_id", "doc_id", "term_idx", "n_terms", "slop", "positions", "weight"))
    if top_k and any(len(q.terms) > 1 for q in queries.values()):
        matched = promising(matched, top_k)
    return best_scores(matched)


def promising(matched: DataFrame, top_k: int) -> DataFrame:
    """The documents whose score can be among the top_k: positions of others needn't be looked at.

    A score is at most the sum of each term's heaviest hit.  The top_k documents
    by that bound are scored; what can't reach the least of their scores is left.
    """
    least = score_bound(F.col("groups"))
    bounded = matched.withColumn("bound", least)
    first = best_scores(bounded.orderBy(F.col("bound").desc(), "doc_id").limit(top_k).drop("bound"))
    floor = first.agg(F.when(F.count("*") >= top_k, F.min("score")).alias("floor"))
    return bounded.crossJoin(F.broadcast(floor)).where("floor is null or bound >= floor * (1 - 1e-9)").drop("bound", "floor")


def phrases(spark: SparkSession, tables: Tables, texts: DataFrame, id_col: str, text_col: str, slop: int = 0, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """(query_id, doc_id, score): each text of a table as an exact phrase of that slop, whatever its length; ids as strings.

    The queries never reach the driver, so there can be many.
    """
    terms = texts.select(F.col(id_col).cast("string").alias("query_id"), analysis.tokens(F.col(text_col), analyzer).alias("t"))
    terms = terms.select("query_id", F.size("t").alias("n_terms"), F.posexplode("t").alias("term_idx", "token"))
    expanded = small(terms.join(tables.vocab.select("token", "df"), "token").withColumns({"slop": F.lit(slop), "distance": F.lit(0)}))
    hits = weighted(expanded, tables, pairs=small(promising_pairs(expanded, tables.postings)))
    return best_scores(intersect(hits.select("query_id", "doc_id", "term_idx", "n_terms", "slop", "positions", "weight")))


def top(scored: DataFrame, top_k: int, single: bool = False) -> DataFrame:
    """The top_k best of each query, equal scores by doc_id; 0 is all."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    if top_k == 0:
        return scored
    if single:
        return scored.orderBy(F.col("score").desc(), "doc_id").limit(top_k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).drop("rank")


def hydrate(ranked: DataFrame, documents: DataFrame, top_k: int = 0) -> DataFrame:
    """ranked with the documents' content, best first; documents that are gone are dropped.

    The ids of a few best are looked up by value, so that the filter reaches the scan.
    """
    if 0 < top_k <= PUSHED_TOKENS:
        rows = ranked.collect()
        ranked = F.broadcast(ranked.sparkSession.createDataFrame(rows, ranked.schema))
        documents = documents.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    return ranked.join(documents, "doc_id").orderBy("query_id", F.col("score").desc(), "doc_id")


def search(spark: SparkSession, tables: Tables, query: str, analyzer: Analyzer = Analyzer(), top_k: int = 0, push: bool = True) -> DataFrame:
    """(query_id, doc_id, score) of one query, its text being the id."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    return top(scores(spark, tables, parse_all({query: query}, analyzer), push, top_k), top_k, single=True)


def search_many(
    spark: SparkSession, tables: Tables, queries: dict[str, str], analyzer: Analyzer = Analyzer(), top_k: int = 0, push: bool = True
) -> DataFrame:
    """(query_id, doc_id, score) of many queries in one job."""
    return top(scores(spark, tables, parse_all(queries, analyzer), push), top_k)
