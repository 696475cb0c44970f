"""Term expansion: query terms joined with the vocabulary within an edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Query

#: So many terms at most are joined by broadcast and looked up by value.
FEW_TERMS = 1000
TERMS_SCHEMA = "query_id string, term_idx int, text string, fuzz int, n_terms int, slop int"


def terms_table(spark: SparkSession, queries: dict[str, Query]) -> DataFrame:
    """A row for each term of each query."""
    rows = [
        (name, k, term.text, term.fuzz, len(query.terms), query.slop)
        for name, query in queries.items()
        for k, term in enumerate(query.terms)
    ]
    table = spark.createDataFrame(rows, TERMS_SCHEMA)
    return F.broadcast(table) if len(rows) <= FEW_TERMS else table


def looked_up(vocab: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """The part of a vocabulary that the queries' terms can stand for, by filters that reach the scan if the terms are few."""
    terms = {(t.text, t.fuzz) for q in queries.values() for t in q.terms}
    if len(terms) > FEW_TERMS:
        return vocab
    exact = sorted({text for text, fuzz in terms if not fuzz})
    sizes = sorted({n for text, fuzz in terms if fuzz for n in range(max(0, len(text) - fuzz), len(text) + fuzz + 1)})
    wanted = F.col("n_chars").isin(sorted({len(x) for x in exact})) & F.col("token").isin(exact)
    return vocab.where(wanted | F.col("n_chars").isin(sizes))


def expand(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """terms with the tokens they stand for: (..., token, df, distance).

    Exact terms are an equality join.  For fuzzy ones the distinct (text, fuzz)
    are joined on the token's length, which can differ by the distance at most,
    before the thresholded edit distance is computed: an equality join, too.
    """
    exact = terms.where("fuzz = 0").join(vocab.select("token", "df", F.col("n_chars").alias("n_text")), F.expr("text = token and length(text) = n_text")).drop("n_text")
    exact = exact.withColumn("distance", F.lit(0))
    wanted = terms.where("fuzz > 0").select("text", "fuzz").distinct()
    lengths = wanted.withColumn("n_chars", F.explode(F.sequence(F.greatest(F.length("text") - F.col("fuzz"), F.lit(0)), F.length("text") + F.col("fuzz"))))
    near = lengths.join(vocab, "n_chars").withColumn("distance", F.levenshtein("token", "text", 2))
    near = near.where("distance between 0 and fuzz")
    # A token or term no longer than the fuzziness could turn into anything.
    near = near.where("token = text or (n_bytes > fuzz and octet_length(text) > fuzz)")
    fuzzy = terms.join(near.select("text", "fuzz", "token", "df", "distance"), ["text", "fuzz"])
    columns = [*terms.columns, "token", "df", "distance"]
    return exact.select(*columns).unionByName(fuzzy.select(*columns))
