"""Operator 10, mixing sources to target weights: balanced sampling by the cube method.

Each source has a target share of the words.  All documents of a source get the
same inclusion probability, its target over its words, so that the largest
total is drawn which no source has to exceed, those aside whose targets hardly
count: the sources that run out first, as long as their shares add up to at
most ``SLACK``, are taken whole and don't bound the others.  The cube method then rounds the
probabilities to 0 or 1.  Its flight phase takes a point of three undecided
documents at a time, finds the direction that leaves the source's expected
words and expected documents as they are (the null space of the 2 x 3 constraint
matrix), and moves along it, one way or the other with the chances that keep
each probability's expectation, until a document is decided.  At most two of a
group stay undecided; these go to the next level, where fewer groups hold them,
until a source has one group.  The landing phase decides its last two: with the
documents' total alone, then by a draw.

Only ids, sources and word counts are shuffled, never texts.  The draws depend
on ids, sources and ``SEED``, not on partitions.

Defined results: rows with the same id and source are one unit, taken or left
together.  A null id or source is a value of its own.  Null texts have no words;
a source without words is taken whole (it can't shift the mix).  A source that
the weights don't name, or give no weight, is left out.  A very long text is a
unit like others, with all its words.  Units alike in documents and words are
exchanged by the draw alone.  An empty table gives no rows; the filter keeps
extra columns, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checked, free, materialize, release

ALPHA = 0.7
#: Of the targets, so much in all may be missed by sources that have too few words.
SLACK = 0.05
SEED = 20240229
GROUP = 4096
_NEAR = 1e-9


def _step(p: list[float], u: tuple[float, ...], draw: float) -> None:
    """Move p along +u or -u until a coordinate is 0 or 1, keeping its expectation."""
    ahead = min((((1.0 - x) / v if v > 0 else -x / v) for x, v in zip(p, u) if v), default=0.0)
    back = min(((x / v if v > 0 else (x - 1.0) / v) for x, v in zip(p, u) if v), default=0.0)
    way = ahead if draw * (ahead + back) < back else -back
    for k, v in enumerate(u):
        if v:
            x = p[k] + way * v
            p[k] = 0.0 if x < _NEAR else 1.0 if x > 1.0 - _NEAR else x


def flight(p: np.ndarray, docs: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round p until at most two of its values are neither 0 nor 1; sums of docs and words stay."""
    out = p.astype(float).tolist()
    c, t = docs.astype(float).tolist(), words.astype(float).tolist()
    active: list[int] = []
    draws = rng.random(2 * len(out) + 4).tolist()
    for k, x in enumerate(out):
        if _NEAR < x < 1.0 - _NEAR:
            active.append(k)
        else:
            out[k] = float(round(x))
        while len(active) == 3:
            i, j, m = active
            u = (c[j] * t[m] - c[m] * t[j], c[m] * t[i] - c[i] * t[m], c[i] * t[j] - c[j] * t[i])
            if not any(u):  # the three are alike: two of them can be exchanged
                u = (c[j], -c[i], 0.0)
            scale = max(map(abs, u))
            u = tuple(v / scale for v in u)
            point = [out[i], out[j], out[m]]
            _step(point, u, draws.pop())
            for a, x in zip(active, point):
                out[a] = x
            active = [a for a in active if 0.0 < out[a] < 1.0]
    return np.array(out)


def landing(p: np.ndarray, docs: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last undecided values: the documents' total is kept as long as two are undecided."""
    out = p.astype(float).tolist()
    c = docs.astype(float).tolist()
    active = [k for k, x in enumerate(out) if 0.0 < x < 1.0]
    while len(active) > 1:
        i, j = active[:2]
        point = [out[i], out[j]]
        _step(point, (c[j] / max(c[i], c[j]), -c[i] / max(c[i], c[j])), float(rng.random()))
        out[i], out[j] = point
        active = [k for k in active if 0.0 < out[k] < 1.0]
    for k in active:
        out[k] = 1.0 if rng.random() < out[k] else 0.0
    return np.array(out)


def word_count(text):
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _units(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("unit_id"), F.col(source_col).cast("string").alias("unit_source"), word_count(F.col("text")).alias("words"))
    units = rows.groupBy("unit_id", "unit_source").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))
    return materialize(units, "units")


def targets(units: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(s, n_units, probability) of each source; weights: relative shares of the words, else words ** ALPHA."""
    by = units.groupBy(F.col("unit_source").alias("s")).agg(F.count("*").alias("n_units"), F.sum("words").cast("double").alias("total"))
    if weights is None:
        weight = F.pow("total", F.lit(ALPHA))
    else:
        given = units.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, given double")
        by = by.join(given, F.col("s").eqNullSafe(F.col("name")), "left").drop("name")
        weight = F.greatest(F.coalesce("given", F.lit(0.0)), F.lit(0.0))
    by = by.withColumn("weight", F.when(F.col("total") > 0, weight))
    # The largest total t with t * weight <= words of each source but those of SLACK, which run out first.
    fill = by.where("weight > 0").select("weight", (F.col("total") / F.col("weight")).alias("fill"))
    share = F.sum("weight").over(Window.orderBy("fill")) / F.sum("weight").over(Window.partitionBy())
    most = fill.withColumn("share", share).where(F.col("share") > SLACK).agg(F.min("fill").alias("most"))
    p = F.when(F.col("total") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("most"), F.lit(0.0)) * F.col("weight") / F.col("total")))
    return by.crossJoin(most).select("s", "n_units", p.alias("probability"))


def _decider(seed: int, level: int):
    """The flight (and, in a source's last group, the landing) of one group of undecided units."""

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw", "unit_id"], na_position="last", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(frame["draw"].iloc[0]) & 0xFFFFFFFF, len(frame)])
        p, c, t = (frame[k].to_numpy(float) for k in ("p", "docs", "words"))
        last = bool(frame["left"].iloc[0] <= GROUP)
        p = flight(p, c, t, rng)
        frame["p"], frame["landed"] = landing(p, c, t, rng) if last else p, last
        frame["left"] = 2 * -(-frame["left"] // GROUP)
        return frame.drop(columns="bucket")

    return decide


def balanced_sample(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """(unit_id, unit_source, docs, words) of the units that are taken."""
    units = _units(docs, id_col, source_col)
    target = materialize(targets(units, weights), "targets")
    largest = target.agg(F.max("n_units")).first()[0] or 0
    marked = units.join(target, F.col("unit_source").eqNullSafe(F.col("s"))).where("probability > 0").drop("s")
    columns = ["unit_id", "unit_source", "docs", "words"]
    taken = [marked.where("probability >= 1").select(*columns)]
    order = F.xxhash64(F.lit(seed), "unit_id", "unit_source").alias("draw")
    rest = marked.where("probability < 1").select(*columns, F.col("probability").alias("p"), F.col("n_units").alias("left"), order)
    schema = rest.drop("bucket").withColumn("landed", F.lit(False)).schema
    tables, level = [], 0
    while True:
        groups = F.ceil(F.col("left") / F.lit(GROUP)).cast("bigint")
        rest = rest.withColumn("bucket", F.pmod("draw", F.greatest(groups, F.lit(1))))

        done = materialize(rest.groupBy("unit_source", "bucket").applyInPandas(_decider(seed, level), schema), "flight")
        tables.append(done)
        taken.append(done.where("p = 1").select(*columns))
        if largest <= GROUP:
            break
        largest = 2 * math.ceil(largest / GROUP)
        rest = done.where("p > 0 and p < 1").drop("landed")
        level += 1
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    out = materialize(out, "mixture")
    release(units, target, *tables)
    return out


def mixture(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, n_words) of the documents that the mixture takes."""
    taken = balanced_sample(docs, weights)
    return taken.select(F.col("unit_id").alias("doc_id"), F.col("unit_source").alias("source"), F.col("words").alias("n_words"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs that the mixture takes, with docs's columns."""
    a, b = free(docs, "taken_id"), free(docs, "taken_source")
    taken = balanced_sample(docs, weights).select(F.col("unit_id").alias(a), F.col("unit_source").alias(b))
    same = docs["doc_id"].eqNullSafe(taken[a]) & docs["source"].cast("string").eqNullSafe(taken[b])
    return docs.join(checked(taken, BROADCAST_ROWS // 8), same, "left_semi")  # wider keys: fewer rows
