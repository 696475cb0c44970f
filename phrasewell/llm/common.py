"""What the operators of this subpackage share: tables, lineage, components."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR_CONF = "spark.checkpoint.dir"
_own: list[str] = []
#: Rows of integer keys that a broadcast may have (some 150 MB as a hashed relation).
BROADCAST_ROWS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: that of the cluster, else (local master only) a temporary one."""
    configured = spark.conf.get(_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"{_DIR_CONF} must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="phrasewell-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: nothing that can be deleted through it
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: no lineage, and no lost work if an executor goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._phrasewell_path = path
    atexit.register(_delete, spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing will read again."""
    for df in tables:
        path = getattr(df, "_phrasewell_path", None)
        if path:
            _delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that nothing refers to any more, rather than whenever the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, to be broadcast if it has at most that many rows; else Spark shuffles both."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def free(df: DataFrame, wanted: str) -> str:
    """A column name that df lacks, so that extra columns of the input can't clash."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; PHRASEWELL_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("PHRASEWELL_TOKENIZERS", "/opt/tokenizers"), name)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps: every round is two shuffles on
    edges that already exist, the number of rounds is logarithmic in the longest
    path, and no node's neighbours are ever gathered on one row.  Loops, repeated
    edges and edges with a null end are ignored.  Groups that aren't finished
    after max_rounds are an error, never a result.
    """
    spark = edges.sparkSession
    current = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct(),
        "edges",
    )
    signature = None
    for _ in range(max_rounds):
        # Large star: every neighbour above v is linked to the smallest of v and its neighbours.
        both = current.select("v", "u").unionAll(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # Small star: v and its lower neighbours are linked to the lowest of them.
        large = large.where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        following = materialize(
            small.unionAll(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct(), "edges"
        )
        # Equal edges: as many, and two independent 64-bit hashes of them agree.
        total = F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))
        row = tuple(following.agg(F.count("*"), total, F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())
        release(current)
        current = following
        if row == signature:
            break
        signature = row
    else:
        raise RuntimeError(f"components: edges still change after {max_rounds} rounds")
    roots = current.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
