"""Intersection and phrase matching.

The reference definition: a document matches if ordered positions p_0 < p_1 <
... exist, one for each term, whose gaps add up to at most the slop.  From each
start p_0 the best continuation takes, for each further term, the smallest
position beyond the last; its gaps are p_last - p_0 - (n - 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many of a query's rarest terms name the documents that can match.
RAREST = 4
#: Rows of expansions, and of documents that can match, that a broadcast may have.
BROADCAST_ROWS = 500_000


def small(side: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast if it has few rows; else Spark shuffles both."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def candidates(expanded: DataFrame, postings: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Postings of all expansions; pairs: (query_id, doc_id), of these alone.

    Documents are looked for first, then terms: otherwise a frequent term would give a row for each query that has it.
    """
    return postings.join(expanded, "token") if pairs is None else postings.join(pairs, "doc_id").join(expanded, ["query_id", "token"])


def promising_pairs(expanded: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents that have each of a query's RAREST rarest terms (by its expansions' documents); positions aren't read.

    That is no cut: all documents that match are among them, and of a query of no
    more terms they have all.  Queries with a term that nothing stands for have none.
    """
    rarity = expanded.groupBy("query_id", "term_idx").agg(F.sum("df").alias("n"), F.first("n_terms").alias("n_terms"))
    of_query = Window.partitionBy("query_id")
    ranked = rarity.withColumn("nth", F.row_number().over(of_query.orderBy("n", "term_idx"))).withColumn("n_found", F.count("*").over(of_query))
    rarest = ranked.where(f"nth <= {RAREST} and n_found = n_terms").select("query_id", "term_idx", "nth", F.least("n_terms", F.lit(RAREST)).alias("n_rare"))
    rare = small(expanded.select("query_id", "term_idx", "token").join(rarest, ["query_id", "term_idx"]))
    have = candidates(rare, postings.select("token", "doc_id")).groupBy("query_id", "doc_id")
    have = have.agg(F.bit_or(F.expr("shiftleft(1, nth - 1)")).alias("have"), F.first("n_rare").alias("n_rare"))
    return have.where("have = shiftleft(1, n_rare) - 1").select("query_id", "doc_id")


def intersect(weighted: DataFrame) -> DataFrame:
    """(query_id, doc_id, slop, groups): documents that have each of a query's terms.

    weighted: (query_id, doc_id, term_idx, n_terms, slop, positions, weight).
    groups: for each term in order, its hits (pos, weight), positions ascending.
    """
    hits = F.transform("positions", lambda p: F.struct(p.cast("int").alias("pos"), F.col("weight").alias("weight")))
    by_term = weighted.select("query_id", "doc_id", "term_idx", "n_terms", "slop", hits.alias("hits"))
    by_doc = by_term.groupBy("query_id", "doc_id").agg(
        F.first("slop").alias("slop"),
        F.first("n_terms").alias("n_terms"),
        F.countDistinct("term_idx").alias("n_found"),
        F.collect_list(F.struct("term_idx", "hits")).alias("all"),
    )
    complete = by_doc.where("n_found = n_terms")
    of_term = lambda k: F.sort_array(
        F.flatten(F.transform(F.filter("all", lambda x: x["term_idx"] == k), lambda x: x["hits"]))
    )
    groups = F.transform(F.sequence(F.lit(0), F.col("n_terms") - 1), of_term)
    return complete.select("query_id", "doc_id", "slop", "n_terms", groups.alias("groups"))


def intervals(groups: Column, n_terms: Column) -> Column:
    """The interval of each start: (first, last, weight), last null if the chain ends early."""

    def chain(start: Column) -> Column:
        begin = F.struct(start["pos"].alias("first"), start["pos"].alias("last"), start["weight"].alias("weight"))

        def further(state: Column, group: Column) -> Column:
            later = F.filter(group, lambda h: h["pos"] > state["last"])
            hit = F.get(later, F.lit(0))
            return F.struct(state["first"].alias("first"), hit["pos"].alias("last"), (state["weight"] + hit["weight"]).alias("weight"))

        return F.aggregate(F.slice(groups, F.lit(2), F.greatest(n_terms - 1, F.lit(0))), begin, further)

    return F.transform(groups[0], chain)


def score_bound(groups: Column) -> Column:
    """The most that an interval can score: each term's heaviest hit, gaps aside."""
    heaviest = lambda group: F.array_max(F.transform(group, lambda h: h["weight"]))
    return F.aggregate(groups, F.lit(0.0), lambda total, group: total + heaviest(group))


def best_scores(matched: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the best interval's score, of documents with one of a score above 0."""
    gap = lambda x: x["last"] - x["first"] - (F.col("n_terms") - 1)
    found = F.filter(intervals(F.col("groups"), F.col("n_terms")), lambda x: x["last"].isNotNull() & (gap(x) <= F.col("slop")))
    score = F.array_max(F.transform(found, lambda x: x["weight"] / (gap(x) + 1)))
    return matched.select("query_id", "doc_id", score.alias("score")).where("score > 0")
