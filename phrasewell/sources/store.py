"""A stored index: batches of Parquet tables and manifests that name the live ones.

    <dir>/manifest-<version>.json           the live batches; the highest version counts
    <dir>/<batch>/documents  doc_id, content; ranges of doc_id, sorted
    <dir>/<batch>/doc_stats  doc_id, len, n_distinct, tokens; in the order of files of documents, or sorted.
                             One that comes of documents has the tokens' positions, too, which only postings are made of
    <dir>/<batch>/postings   token, doc_id, tf, n_distinct, positions; ranges of token, sorted
    <dir>/<batch>/vocab      n_chars, token, df: what the batch adds to (or takes from) a token's df; sorted
    <dir>/<batch>/stats      n_docs, total_len: likewise, of the corpus
    <dir>/<batch>/tombstones doc_id, batch: documents deleted, and the batch that holds them

A batch is written first and becomes visible with the manifest that names it, so
readers see all of a change or nothing.  A manifest is created only if its
version doesn't exist yet: of two writers one comes later, reads what the other
wrote and adds to it.  Deletions and merges count documents and places that
another deletion or merge may have changed: they are done anew if one came
between (``epoch``).  Frequencies and averages are sums over batches, never
recomputed from all postings.  Batches that a merge replaces are removed by the
next one, so that readers can finish.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions.analysis import Analyzer
from ..plans.search import Tables

SCHEMAS = {
    "documents": "doc_id string, content string",
    "doc_stats": "doc_id string, len bigint, n_distinct bigint, tokens array<string>",
    "postings": "token string, doc_id string, tf bigint, n_distinct bigint, positions array<int>",
    "vocab": "n_chars int, token string, df bigint",
    "stats": "n_docs bigint, total_len bigint",
    "tombstones": "doc_id string, batch string",
}
#: Ids that a filter names at most, so that it reaches the scan.
PUSHED_IDS = 500
#: So many small batches are joined by the append that makes them so many.
SMALL_BATCHES = 16
#: Rows of (doc_id, batch) that a broadcast may have.
BROADCAST_IDS = 1_000_000
#: Bytes of a file at least, if there is more than one.
LEAST_BYTES = 1 << 20
#: Bytes of postings that a task sorts at most: some 12 times as much in memory, so that it needn't spill.
SORTED_BYTES = 12 << 20
#: Manifests that stay.
KEPT = 10
_locks: dict[str, threading.RLock] = {}


class Stale(Exception):
    """Another deletion or merge was committed since this one began to read."""


class Store:
    """The tables under one directory."""

    def __init__(self, spark: SparkSession, dir: str, bytes_per_file: int = 52_428_800) -> None:
        self.spark, self.dir, self.bytes_per_file = spark, dir.rstrip("/"), bytes_per_file
        self._lock = _locks.setdefault(self.dir, threading.RLock())
        self.manifest = self._load()

    # Files go through Hadoop's file systems, so a directory can be on any of them.
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}" if name else self.dir)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, root = self._fs(), self._path("")
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _load(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "epoch": 0, "batches": [], "expired": [], "own_ids": False, "streams": {}}
        stream = self._fs().open(self._path(f"manifest-{versions[-1]:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def refresh(self) -> None:
        """See what other writers have committed."""
        self.manifest = self._load()

    def _create(self, manifest: dict) -> bool:
        """Write a manifest if its version doesn't exist yet."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        path, fresh = self._path(f"manifest-{manifest['version']:010d}.json"), self._path(f"fresh-{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(fresh), context.makeQualified(path), options)
        except Exception as error:
            fs.delete(fresh, False)
            if "FileAlreadyExists" in str(error) or fs.exists(path):
                return False
            raise
        return True

    def _commit(self, change: Callable[[dict], dict], epoch: int | None = None) -> None:
        """Commit what change makes of the latest manifest; Stale if that isn't of the epoch any more."""
        with self._lock:
            while True:
                latest = self._load()
                if epoch is not None and latest["epoch"] != epoch:
                    raise Stale
                manifest = latest | change(latest) | {"version": latest["version"] + 1}
                if epoch is not None:
                    manifest["epoch"] = epoch + 1
                if self._create(manifest):
                    break
            self.manifest = manifest
            for version in self._versions()[:-KEPT]:
                self._fs().delete(self._path(f"manifest-{version:010d}.json"), False)

    def _again(self, work: Callable[[], int]) -> int:
        """Do a deletion or merge, anew if another came between."""
        while True:
            with self._lock:  # within a process they take turns
                self.refresh()
                try:
                    return work()
                except Stale:
                    continue

    def batches(self) -> list[str]:
        return [b["name"] for b in self.manifest["batches"]]

    def table(self, kind: str, batches: list[str] | None = None, located: bool = False) -> DataFrame:
        """A kind of tables of all batches or of some; located: with the name of the batch."""
        named = [b for b in self.manifest["batches"] if kind in b["tables"] and (batches is None or b["name"] in batches)]
        if not named:
            return self.spark.createDataFrame([], SCHEMAS[kind] + (", batch string" if located else ""))
        rows = self.spark.read.schema(SCHEMAS[kind]).parquet(*[f"{self.dir}/{b['name']}/{kind}" for b in named])
        return rows.withColumn("batch", F.element_at(F.split("_metadata.file_path", "/"), -3)) if located else rows

    def _write(self, batch: str, kind: str, df: DataFrame) -> str:
        df.write.parquet(f"{self.dir}/{batch}/{kind}")
        return kind

    def _read(self, batch: str, kind: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.dir}/{batch}/{kind}")

    def _name(self) -> str:
        return f"batch-{self.manifest['version']:06d}-{uuid.uuid4().hex[:8]}"

    def _ranges(self, rows: DataFrame, size: int, *keys: str, most: int = 1 << 62) -> DataFrame:
        """rows sorted, in ranges of about bytes_per_file, or most if that is less; fewer bytes are spread over the session's cores."""
        files = max(1, -(-size // min(self.bytes_per_file, most)), min(self.spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
        return (rows.repartitionByRange(files, *keys) if files > 1 else rows.coalesce(1)).sortWithinPartitions(*keys)

    def _bytes(self, batch: str, kind: str) -> int:
        return int(self._fs().getContentSummary(self._path(f"{batch}/{kind}")).getLength())

    def _write_documents(self, batch: str, docs: DataFrame) -> int:
        """Documents in ranges of about bytes_per_file; the size is that of their contents."""
        size = int(docs.agg(F.sum(F.octet_length("content"))).first()[0] or 0)
        self._write(batch, "documents", self._ranges(docs, size, "doc_id"))
        return size

    def _write_postings(self, batch: str, rows: DataFrame, size: int) -> None:
        """Postings in sorted ranges.  What is shuffled and sorted has a column less: a document's length stands before the positions."""
        rows = rows.select("token", "doc_id", F.concat(F.array(F.col("n_distinct").cast("int")), "positions").alias("x"))
        rows = self._ranges(rows, size, "token", "doc_id", most=SORTED_BYTES)
        tf = F.size("x") - 1
        self._write(
            batch,
            "postings",
            rows.select("token", "doc_id", tf.cast("bigint").alias("tf"), F.col("x")[0].cast("bigint").alias("n_distinct"), F.slice("x", F.lit(2), tf).alias("positions")),
        )

    def _write_counts(self, batch: str, vocab: DataFrame, stats: DataFrame) -> list[str]:
        vocab = vocab.select(F.length("token").alias("n_chars"), "token", "df")
        self._write(batch, "vocab", vocab.sort("n_chars", "token"))
        self._write(batch, "stats", stats)
        return ["vocab", "stats"]

    def _write_index(self, batch: str, analyzer: Analyzer) -> list[str]:
        """The batch's tables that follow from its documents: they are analyzed once, what that gives is sorted then."""
        indexed = analysis.indexed(self._read(batch, "documents"), analyzer, "doc_id", "content")
        self._write(batch, "doc_stats", indexed)
        indexed = self.spark.read.schema(indexed.schema).parquet(f"{self.dir}/{batch}/doc_stats")
        self._write_postings(batch, analysis.postings(indexed), self._bytes(batch, "doc_stats"))
        vocab = self._read(batch, "postings").groupBy("token").agg(F.count("*").alias("df"))
        sums = self._read(batch, "doc_stats").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))
        return ["doc_stats", "postings", *self._write_counts(batch, vocab, sums)]

    def append(self, docs: DataFrame, analyzer: Analyzer, own_ids: bool = False, stream: tuple[str, int] | None = None) -> str:
        """Add documents (doc_id, content) as a batch; stream: a checkpoint and the number of its micro-batch."""
        batch = self._name()
        # Written first: ids and contents are fixed before anything is derived from them.
        size = self._write_documents(batch, docs.select(F.col("doc_id").cast("string"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")))
        kinds = ["documents", *self._write_index(batch, analyzer)]
        n = self._read(batch, "stats").first()["n_docs"]
        entry = {"name": batch, "tables": kinds, "docs": n, "deleted": 0, "bytes": size}

        def change(latest: dict) -> dict:
            out = {"batches": [*latest["batches"], entry], "own_ids": latest["own_ids"] or own_ids}
            return out | ({"streams": latest["streams"] | {stream[0]: stream[1]}} if stream else {})

        self._commit(change)
        if len(self._small()) >= SMALL_BATCHES:
            self.compact()
        return batch

    def _small(self) -> list[dict]:
        return [b for b in self.manifest["batches"] if "documents" in b["tables"] and b["bytes"] < self.bytes_per_file // 2]

    def gone(self) -> DataFrame:
        """(doc_id, batch) of deleted documents, broadcast if they are few."""
        rows = self.table("tombstones")
        return F.broadcast(rows) if sum(b["deleted"] for b in self.manifest["batches"]) <= BROADCAST_IDS else rows

    def live(self, kind: str, batches: list[str] | None = None) -> DataFrame:
        """The rows of a table that belong to live documents, with their batch if there are deleted ones."""
        if not any(b["deleted"] for b in self.manifest["batches"]):
            return self.table(kind, batches)
        return self.table(kind, batches, located=True).join(self.gone(), ["doc_id", "batch"], "left_anti")

    def live_documents(self) -> DataFrame:
        return self.live("documents").select("doc_id", "content")

    def get(self, id: str) -> str | None:
        """The content of a live document: the filter prunes files and row groups."""
        row = self.live("documents").where(F.col("doc_id") == id).select("content").first()
        return row["content"] if row else None

    def delete(self, ids: DataFrame) -> int:
        """Mark documents (doc_id) as deleted and take their counts back; ids without a live document don't matter."""
        wanted = ids.select(F.col("doc_id").cast("string")).where("doc_id is not null").distinct()
        few = [r["doc_id"] for r in wanted.limit(PUSHED_IDS + 1).collect()]
        return self._again(lambda: self._delete(wanted, few))

    def _delete(self, wanted: DataFrame, few: list[str]) -> int:
        epoch = self.manifest["epoch"]
        if not few or not any("documents" in b["tables"] for b in self.manifest["batches"]):
            return 0
        located = self.live("doc_stats") if any(b["deleted"] for b in self.manifest["batches"]) else self.table("doc_stats", located=True)
        if len(few) <= PUSHED_IDS:
            located = located.where(F.col("doc_id").isin(few))
        else:
            located = located.join(wanted, "doc_id", "left_semi")
        batch = self._name()
        # What the documents take from the counts stands with them: postings aren't read.
        found = located.select("doc_id", "batch", "len", "tokens")
        self._write(batch, "found", found)
        found = self.spark.read.schema(found.schema).parquet(f"{self.dir}/{batch}/found")
        per_batch = {r["batch"]: r["n"] for r in found.groupBy("batch").agg(F.count("*").alias("n")).collect()}
        if not per_batch:
            self._remove(batch)
            return 0
        self._write(batch, "tombstones", found.select("doc_id", "batch"))
        vocab = found.select(F.explode("tokens").alias("token")).groupBy("token").agg((-F.count("*")).alias("df"))
        kinds = self._write_counts(batch, vocab, found.agg((-F.count("*")).alias("n_docs"), (-F.sum("len")).alias("total_len")))
        self._fs().delete(self._path(f"{batch}/found"), True)
        entry = {"name": batch, "tables": ["tombstones", *kinds], "docs": 0, "deleted": 0, "bytes": 0}

        def change(latest: dict) -> dict:
            return {"batches": [*[b | {"deleted": b["deleted"] + per_batch.get(b["name"], 0)} for b in latest["batches"]], entry]}

        try:
            self._commit(change, epoch)
        except Stale:
            self._remove(batch)
            raise
        return sum(per_batch.values())

    def merge(self, ratio: float, analyzer: Analyzer | None = None) -> int:
        """Rewrite all batches of which at least that share is deleted; returns how many there were.

        Small batches are joined with them.  The rewritten batch takes over the
        live rows, sorted anew; nothing is analyzed again.  The counts of the old
        batches and of the deletions in them go together: what remains of the
        sums is what the new batch has.
        """
        return self._again(lambda: self._merge(ratio))

    def compact(self) -> int:
        """Join the small batches."""
        return self._again(lambda: self._merge(2.0))

    def _merge(self, ratio: float) -> int:
        epoch = self.manifest["epoch"]
        old = [b for b in self.manifest["batches"] if "documents" in b["tables"] and b["deleted"] and b["deleted"] >= ratio * b["docs"]]
        small = self._small()
        rewritten = len(old)
        if len(small) > 1:
            old += [b for b in small if b not in old]
        if not old:
            return 0
        names = [b["name"] for b in old]
        batch = self._name()
        size = self._write_documents(batch, self.live("documents", names).select("doc_id", "content"))
        self._write_postings(batch, self.live("postings", names), sum(self._bytes(n, "postings") for n in names))
        rows = self.live("doc_stats", names).select("doc_id", "len", "n_distinct", "tokens")
        self._write(batch, "doc_stats", self._ranges(rows, sum(self._bytes(n, "doc_stats") for n in names), "doc_id"))
        # All deltas are folded into this batch; batches that stay keep their tables but not their deltas.
        read = self.manifest["batches"]
        self._write_counts(batch, self.vocab_counts().select("token", "df"), self.table("stats").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")))
        self._write(batch, "tombstones", self.table("tombstones").where(~F.col("batch").isin(names)).coalesce(1))
        n = self._read(batch, "documents").count()
        entry = {"name": batch, "tables": ["documents", "postings", "doc_stats", "vocab", "stats", "tombstones"], "docs": n, "deleted": 0, "bytes": size}
        folded = {b["name"] for b in read}
        gone: list[str] = []

        def change(latest: dict) -> dict:
            keep = []
            for b in latest["batches"]:
                if b["name"] in names:
                    continue
                if b["name"] in folded:  # others were appended meanwhile
                    b = b | {"tables": [t for t in b["tables"] if t not in ("vocab", "stats", "tombstones")]}
                if b["tables"]:
                    keep.append(b)
            gone[:] = [b["name"] for b in latest["batches"] if b["name"] not in {k["name"] for k in keep}]
            return {"batches": [*keep, entry], "expired": gone}

        expired = self.manifest["expired"]
        try:
            self._commit(change, epoch)
        except Stale:
            self._remove(batch)
            raise
        for name in expired:
            self._remove(name)
        return rewritten

    def _remove(self, batch: str) -> None:
        self._fs().delete(self._path(batch), True)

    def vocab_counts(self) -> DataFrame:
        """(n_chars, token, df) of live documents; filters on n_chars and token reach the scan."""
        return self.table("vocab").groupBy("n_chars", "token").agg(F.sum("df").alias("df")).where("df > 0")

    def corpus(self) -> DataFrame:
        """One row (n_docs, avg_doc_len); the average is null without live documents."""
        summed = self.table("stats").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.sum("total_len").alias("total_len"))
        return summed.select("n_docs", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).alias("avg_doc_len"))

    def tables(self, hidden: list[str] | None = None) -> Tables:
        """What a search reads; hidden: ids whose deletion isn't written yet."""
        self.refresh()
        vocab = self.vocab_counts().select("token", "df", "n_chars", F.octet_length("token").alias("n_bytes"))
        documents, postings = self.live("documents"), self.live("postings")
        if hidden:
            rows = self.spark.createDataFrame([(h,) for h in hidden], "doc_id string")
            documents, postings = (t.join(F.broadcast(rows), "doc_id", "left_anti") for t in (documents, postings))
        return Tables(documents.select("doc_id", "content"), postings.drop("batch"), vocab, self.corpus())
