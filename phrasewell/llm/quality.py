"""Operator 3, quality rules: a hashed n-gram log-likelihood ratio and a learned threshold.

Words (separated by white space) and pairs of neighbouring words are hashed to
``BUCKETS`` buckets.  One multinomial over the buckets is counted on trusted
documents (those that the labels call good), another on all documents of the raw
corpus, both with ``SMOOTHING`` added to each bucket.  A document's score is the
mean, over all of its n-grams, of ``ln(trusted / raw)``: normalised by length.

How high such means are depends on the size of the corpus, and a document whose
own n-grams count as trusted would score higher than others of its kind.  So
ids fall into ``FOLDS`` folds, and every document, labelled or not, is scored
with the trusted counts of the other folds.  The threshold is chosen on these
held-out scores of all labelled documents: it keeps at least ``KEEP`` of the
trusted ones, and among such thresholds (multiples of 1 / ``STEPS``) has the
greatest share of junk (quality 0) below it less ``COST`` times the share of
trusted ones; of equally good ones the middle one.  There is no sampling and no
randomness, and every document is scored and decided.

A few toxic words hardly move that mean, so they are looked for apart, learned
from the labels as well: a word (letters and digits) is toxic if at least
``TOXIC_SHARE`` of the documents labelled good but toxic have it, ``TOXIC_LEAST``
at least, and that share is ``TOXIC_RATIO`` times the share of trusted ones, one
more counted.  A document with a toxic word isn't kept.

Ratios are rounded to multiples of 2**-20 before they are added, so a score is
one exact integer division, whatever the order of its terms.

Defined results: a null, empty or blank text has no n-grams, a null score and is
not kept; a very long text is scored whole.  A repeated row is scored (and
counted) each time.  A score equal to the threshold is kept.  A document is
trusted if any of its label rows says so, else junk if any says that; labels
with null ids or values are ignored.  Without trusted text nothing can be told:
every ratio and the threshold are 0, and each document with n-grams is kept.
Without junk labels the threshold is the highest that keeps ``KEEP`` of the
trusted.  An empty table of documents gives no rows.  Extra columns stay,
whatever their names; the operator's own columns give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .common import checked, free

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
PAIR = 0xD6E8FEB86659FD93
SMOOTHING = 1
SCALE = 1 << 20
FOLDS = 5
#: Of the trusted documents, held out, at least this share is kept.
KEEP = 0.98
#: A trusted document lost weighs as much as so many junk documents kept.
COST = 4
STEPS = 1024
TOXIC_SHARE = 0.05
TOXIC_LEAST = 3
TOXIC_RATIO = 20


def features(w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the words; buckets of the pairs, -1 where a text's last word has none)."""
    shift = np.uint64(64 - BUCKET_BITS)
    single = (w.hash >> shift).astype(np.int32)
    pair = np.full(len(single), -1, np.int32)
    if len(single) > 1:
        pair[:-1] = ((w.hash[:-1] * np.uint64(PAIR) + w.hash[1:]) >> shift).astype(np.int32)
        pair[w.bounds[1:][w.counts() > 0] - 1] = -1
    return single, pair


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the trusted documents, each once."""
    return labels.where("doc_id is not null and quality = 1 and toxic = 0").select("doc_id").distinct()


def junk(labels: DataFrame) -> DataFrame:
    """Ids of the junk documents, each once."""
    ids = labels.where("doc_id is not null and quality = 0").select("doc_id").distinct()
    return ids.join(trusted(labels), "doc_id", "left_anti")


def fold(id: Column) -> Column:
    """The fold of an id; that of a null id is 0."""
    small = F.pmod(F.coalesce(id.cast("bigint"), F.lit(0)), F.lit(1_000_003))
    return F.pmod(F.floor(small * 2_654_435_761 / 65_536), F.lit(FOLDS)).cast("int")


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, n_raw, n_0, n_1, ...) over all n-grams of all documents: raw ones, and trusted ones by fold."""
    good = trusted(labels).select(F.col("doc_id").alias("trusted_id"))
    marked = docs.select("doc_id", "text").where("text is not null")
    # The labels grow with the corpus: texts stay where they are while the ids are few enough.
    marked = marked.join(checked(good), F.expr("doc_id = trusted_id"), "left")
    marked = marked.select("text", F.when(F.col("trusted_id").isNotNull(), fold(F.col("doc_id"))).otherwise(-1).alias("part"))
    names = ["n_raw", *(f"n_{k}" for k in range(FOLDS))]

    def count(batches):
        all_ = np.zeros((1 + FOLDS, BUCKETS), np.int64)
        for batch in batches:
            part_of = np.asarray(batch.column(1))
            for w in V.slices(batch.column(0), V.SPACE):
                single, pair = features(w)
                mine = np.repeat(part_of[w.first : w.first + len(w.bounds) - 1], w.counts())
                for part, of in ((single, mine), (pair[pair >= 0], mine[pair >= 0])):
                    all_[0] += np.bincount(part, minlength=BUCKETS)
                    some = of >= 0
                    if some.any():
                        both = of[some].astype(np.int64) * BUCKETS + part[some]
                        all_[1:] += np.bincount(both, minlength=FOLDS * BUCKETS).reshape(FOLDS, BUCKETS)
        some = np.flatnonzero(all_[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in all_)], names=["bucket", *names])

    parts = marked.mapInArrow(count, "bucket int, " + ", ".join(f"{n} bigint" for n in names))
    return parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The rounded log ratio of each bucket, a row for each fold left out (FOLDS * BUCKETS integers, whatever the corpus)."""
    all_ = np.zeros((1 + FOLDS, BUCKETS), np.float64)
    for bucket, *n in counts(docs, labels).toLocalIterator():
        all_[:, bucket] = n
    raw, target = all_[0], all_[1:].sum(axis=0) - all_[1:]
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    p = (target + SMOOTHING) / (target.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    known = np.rint(np.log(p / q) * SCALE).astype(np.int32)
    return known if all_[1:].any() else np.zeros_like(known)


def _holders(docs: DataFrame, ids: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(h, n): in how many of the documents with these ids (column labelled_id) each word is, or each of only."""
    some = docs.select("doc_id", "text").where("text is not null").join(checked(ids), F.expr("doc_id = labelled_id"), "left_semi")

    def count(batches):
        hashes, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for w in V.slices(batch.column(0), V.ALNUM):
                h, of = w.hash, w.text_of()
                if only is not None:
                    among = np.isin(h, only)
                    h, of = h[among], of[among]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                found, n = np.unique(h[new], return_counts=True)
                hashes.append(found)
                numbers.append(n)
        h, at = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(at, np.concatenate(numbers), len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return some.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def toxic_words(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Hashes of the toxic words."""
    good = trusted(labels).select(F.col("doc_id").alias("labelled_id"))
    bad = labels.where("doc_id is not null and quality = 1 and toxic = 1").select(F.col("doc_id").alias("labelled_id")).distinct()
    bad = bad.join(good, "labelled_id", "left_anti")
    have = docs.select("doc_id").where("text is not null")
    n_bad, n_good = (have.join(checked(ids), F.expr("doc_id = labelled_id"), "left_semi").count() for ids in (bad, good))
    if n_bad < TOXIC_LEAST or not n_good:
        return np.zeros(0, np.uint64)
    often = _holders(docs, bad).where(F.col("n") >= max(TOXIC_LEAST, TOXIC_SHARE * n_bad)).collect()
    n = {r["h"]: r["n"] for r in often}  # at most 1 / TOXIC_SHARE times the words of a document
    if not n:
        return np.zeros(0, np.uint64)
    clean = {r["h"]: r["n"] for r in _holders(docs, good, np.array(sorted(n), np.int64).view(np.uint64)).collect()}
    out = [h for h, k in n.items() if k / n_bad >= TOXIC_RATIO * (clean.get(h, 0) + 1) / n_good]
    return np.array(sorted(out), np.int64).view(np.uint64)


def has_toxic(array, toxic: np.ndarray) -> np.ndarray:
    """Whether each text of a column has a toxic word."""
    out = np.zeros(len(array), bool)
    if len(toxic):
        for w in V.slices(array, V.ALNUM):
            out[w.first + w.text_of()[np.isin(w.hash, toxic)]] = True
    return out


def sums(array, ratio: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of rounded ratios, number of n-grams) of each text of a column, by the ratios that leave out its fold."""
    total, size = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
    flat = ratio.ravel()
    for w in V.slices(array, V.SPACE):
        single, pair = features(w)
        n = w.counts()
        at = slice(w.first, w.first + len(n))
        row = np.repeat(part[at].astype(np.int32) * BUCKETS, n)
        each = flat[row + single].astype(np.int64) + np.where(pair >= 0, flat[row + pair], 0)
        upto = np.concatenate(([0], np.cumsum(each)))
        total[at] = upto[w.bounds[1:]] - upto[w.bounds[:-1]]
        size[at] = n + np.maximum(n - 1, 0)
    return total, size


def scored(docs: DataFrame, ratio: np.ndarray, n_name: str = "n_grams", score_name: str = "score", toxic: np.ndarray | None = None) -> DataFrame:
    """docs with two more columns: the number of n-grams, and the score (null without n-grams, or with a toxic word)."""
    shared = docs.sparkSession.sparkContext.broadcast((ratio, np.zeros(0, np.uint64) if toxic is None else toxic))
    cell = free(docs, "quality_cell")

    @F.arrow_udf("struct<n: bigint, score: double>")
    def score(text: pa.Array, part: pa.Array) -> pa.Array:
        ratio, toxic = shared.value
        total, size = sums(text, ratio, part.to_numpy(zero_copy_only=False))
        value = total / np.maximum(size, 1) / SCALE
        return pa.StructArray.from_arrays([pa.array(size), pa.array(value, mask=(size == 0) | has_toxic(text, toxic))], names=["n", "score"])

    out = docs.withColumn(cell, score(F.col("text"), fold(F.col("doc_id"))))
    return out.withColumns({n_name: F.col(f"{cell}.n"), score_name: F.col(f"{cell}.score")}).drop(cell)


def best_threshold(clean: dict[int, int], bad: dict[int, int]) -> int:
    """The threshold in steps, from numbers of trusted and of junk documents by step."""
    if not clean:
        return 0
    steps = np.arange(min([*clean, *bad]), max([*clean, *bad]) + 2)
    lost, dropped = (np.concatenate(([0], np.cumsum([of.get(k, 0) for k in steps.tolist()[:-1]]))) for of in (clean, bad))
    n_clean, n_bad = sum(clean.values()), sum(bad.values())
    allowed = lost <= (1 - KEEP) * n_clean + 1e-9
    steps, gain = steps[allowed], (n_clean * dropped - COST * n_bad * lost)[allowed]
    if not n_bad:
        return int(steps[-1])
    best = steps[gain == gain.max()]
    return int(best[(len(best) - 1) // 2])


def threshold_of(docs: DataFrame, labels: DataFrame, ratio: np.ndarray) -> float:
    """The threshold that the labels give, from the scores of all labelled documents."""
    ids = trusted(labels).withColumn("clean", F.lit(True)).unionByName(junk(labels).withColumn("clean", F.lit(False)))
    ids = ids.select(F.col("doc_id").alias("labelled_id"), "clean")
    of = docs.select("doc_id", "text").where("text is not null").join(checked(ids), F.expr("doc_id = labelled_id"))
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    by = scored(of, ratio).where("score is not null").groupBy("clean", step).count()
    # A score lies between the logs of the least and greatest ratio: the steps are few, whatever the corpus.
    found: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in by.collect():
        found[r["clean"]][r["step"]] = r["count"]
    return best_threshold(found[True], found[False]) / STEPS


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The kept rows of docs, with docs's columns; a threshold that isn't given is learned."""
    n, s = free(docs, "quality_n"), free(docs, "quality_score")
    ratio = ratios(docs, labels)
    least = threshold_of(docs, labels, ratio) if threshold is None else threshold
    out = scored(docs, ratio, n, s, toxic_words(docs, labels))
    return out.where(F.col(s) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, n_grams, score) of each kept document."""
    ratio = ratios(docs, labels)
    least = threshold_of(docs, labels, ratio) if threshold is None else threshold
    out = scored(docs.select("doc_id", "text"), ratio, toxic=toxic_words(docs, labels))
    return out.where(F.col("score") >= least).select("doc_id", "n_grams", F.round("score", 6).alias("score"))
