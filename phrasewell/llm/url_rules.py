"""Operator 5, URL filters: association rules mined from labels, matched by an inverted index.

A URL's tokens are its lower-cased parts between ``/ . ? & = # : _``, each once,
without bare numbers.  A page shows the document whose number ends its path; the
pages of labelled documents are the transactions.  A page is bad if any of its
document's labels has quality 0 or toxic 1.  FP-growth finds the token
combinations that occur together with the bad label in at least ``MIN_SUPPORT``
of the transactions (and ``MIN_COUNT`` times); those become rules if the share
of bad pages among the pages with the combination (confidence) is at least
``MIN_CONFIDENCE`` and ``MIN_LIFT`` times the overall share, and if it isn't by
chance above the overall share: the lower end of Wilson's interval, ``CERTAIN``
standard deviations down, must exceed it.  A rule goes if a more general one has
at least its confidence.  Rules are indexed under their
rarest token; a page meets the rules of its tokens there, and a rule matches if
the page has all of its tokens.  Every page gets a verdict.

Defined results: null and empty URLs have no tokens and match nothing; labels
with a null id and pages without a document's number take no part in mining; a
repeated page row is a transaction, and a result, of its own.  A very long URL
counts with all its tokens.  Of the rules that match a page the one with the
highest confidence is reported, of equal ones that with more bad pages, then the
first by its tokens.  Without labelled pages there are no rules and no page is
blocked; without pages there are no rows.  Where URLs tell nothing about labels,
no rule passes, and that is the result.  Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.35
MIN_LIFT = 1.2
CERTAIN = 4.0
#: Holds a space, so it can't be a token.
BAD = "label bad"


def tokens(url):
    """The tokens of a URL column, sorted, each once."""
    lower = F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.filter(F.split(lower, r"[/.?&=#:_\s]+"), lambda x: ~x.rlike("^[0-9]*$"))
    return F.array_sort(F.array_distinct(F.coalesce(parts, F.array().cast("array<string>"))))


def document_of(url):
    """The number that ends a URL's path, the id of the document that the page shows; else null."""
    return F.try_to_number(F.regexp_extract(url, r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)", 1), F.lit("9" * 18)).cast("bigint")


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of each labelled page."""
    verdict = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    by = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(verdict.alias("bad"))
    shown = pages.select(tokens(F.col("url")).alias("tokens"), document_of(F.col("url")).alias("shown_id"))
    return shown.join(by, F.expr("shown_id = label_id")).select("tokens", "bad")


def surely(confidence: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of a share of n."""
    z2 = CERTAIN * CERTAIN
    spread = CERTAIN * F.sqrt(confidence * (1.0 - confidence) / n + z2 / (4.0 * n * n))
    return (confidence + z2 / (2.0 * n) - spread) / (1.0 + z2 / n)


def rules(labelled: DataFrame) -> DataFrame:
    """(rule, confidence, n_bad, size, rarest) from transactions."""
    spark = labelled.sparkSession
    known = materialize(labelled, "transactions")
    n, n_bad = known.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    schema = "rule array<string>, confidence double, n_bad bigint"
    if not n_bad:
        found = spark.createDataFrame([], schema)
    else:
        items = known.select(F.when(F.col("bad") == 1, F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
        least = max(MIN_SUPPORT, MIN_COUNT / n)
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=MIN_CONFIDENCE).fit(items)
        found = (
            model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
            .where(F.col("confidence") >= MIN_LIFT * n_bad / n)
            .select(F.array_sort("antecedent").alias("rule"), "confidence", F.round(F.col("support") * n).cast("bigint").alias("n_bad"))
            .where(surely(F.col("confidence"), F.round(F.col("n_bad") / F.col("confidence"))) > n_bad / n)
        )
    found = materialize(found, "rules")
    general = found.select(F.col("rule").alias("g"), F.col("confidence").alias("gc"))
    # A more general rule shares its own first token with the rule: an equality join, not all pairs.
    part = found.withColumn("token", F.explode("rule"))
    beaten = (
        part.join(general.withColumn("token", F.col("g")[0]), "token")
        .where((F.size("g") < F.size("rule")) & (F.size(F.array_except("g", "rule")) == 0) & (F.col("gc") >= F.col("confidence")))
        .select("rule")
        .distinct()
    )
    kept = found.join(beaten, "rule", "left_anti")
    counts = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    first = Window.partitionBy("rule").orderBy("n", "token")
    indexed = kept.withColumn("token", F.explode("rule")).join(counts, "token").withColumn("nth", F.row_number().over(first))
    out = materialize(indexed.where("nth = 1").select("rule", "confidence", "n_bad", F.col("token").alias("rarest")), "index")
    release(known, found)
    return out


def match(pages: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, url, blocked, rule, confidence, n_bad, n_rules) of each page, with the best rule that matches it."""
    every = pages.select("page_id", "url")
    known = every.where("page_id is not null and url is not null").distinct()
    each = known.withColumn("tokens", tokens(F.col("url"))).withColumn("rarest", F.explode("tokens"))
    met = each.join(index, "rarest").where(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n_bad")).alias("n"), F.concat_ws(" ", "rule").alias("rule")))
    matched = met.groupBy("page_id", "url").agg(best.alias("best"), F.count("*").alias("n_rules"))
    out = every.join(matched, ["page_id", "url"], "left")
    return out.select(
        "page_id", "url", F.col("best").isNotNull().alias("blocked"), F.col("best.rule").alias("rule"), F.round(-F.col("best.c"), 6).alias("confidence"),
        (-F.col("best.n")).alias("n_bad"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
    )


def url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return match(pages, rules(transactions(pages, labels)))
