"""The user's interface: an index in a directory, and a registry of indexes."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DocumentIdError, MissingDocumentError, MissingIndexError
from .plans import search as plans
from .sources import ulid
from .sources.config import Config
from .sources.store import Store


@dataclass(frozen=True)
class Document:
    id: str
    content: str


@dataclass(frozen=True)
class Result:
    score: float
    document: Document


class Index:
    """A full-text index in a directory, opened or created.

    add() and delete() are buffered; they are written by flush() and when a
    session ends.  Added documents are also written when the buffer is large or
    old enough, and before anything is read.  Deleted ones are hidden at once;
    that they leave the counts (which scores depend on) waits until flush(), or
    until they are more than ``PURGE_LEAST`` and ``PURGE_SHARE`` of all.
    """

    PURGE_LEAST, PURGE_SHARE = 1000, 0.05

    def __init__(self, spark: SparkSession, dir: str, conf: str | None = None) -> None:
        self.spark = spark
        self.config = Config.load(conf)
        self.analyzer = self.config.analyzer()
        self.store = Store(spark, dir, self.config.segment_size)
        self._ids = ulid.Generator()
        self._added: list[tuple[str, str]] = []
        self._deleted: list[str] = []
        self._chars, self._since = 0, time.monotonic()

    @contextmanager
    def session(self) -> Iterator[Index]:
        """What is added and deleted within is written at the end, also after an error."""
        try:
            yield self
        finally:
            self.flush()

    def add(self, document: str) -> str:
        """Add a document; returns its id."""
        if not self._added:
            self._since = time.monotonic()
        id = self._ids.next()
        self._added.append((id, document))
        self._chars += len(document)
        if self._chars > self.config.documents_buffer_size or time.monotonic() - self._since > self.config.documents_save_after_seconds:
            self._write_added()
        return id

    def _id(self, id: str) -> str:
        """An id in its usual form; an index that holds its callers' own ids takes any."""
        try:
            return ulid.check(id)
        except DocumentIdError:
            if self.store.manifest["own_ids"]:
                return id
            self.store.refresh()
            if self.store.manifest["own_ids"]:
                return id
            raise

    def add_documents(self, docs: DataFrame, content: str = "content", id_col: str | None = None) -> DataFrame:
        """Add a table of documents as one batch; returns their (doc_id, content).

        Ids are the caller's (which must be unique), or ULIDs that follow from
        the rows' places in the table.
        """
        self.flush()
        own = id_col is not None
        if not own:
            number = F.monotonically_increasing_id()
            id = ulid.column(number, int.from_bytes(os.urandom(2)), int(time.time() * 1000))
        else:
            id = F.col(id_col).cast("string")
        batch = self.store.append(docs.select(id.alias("doc_id"), F.col(content).alias("content")), self.analyzer, own)
        if batch not in self.store.batches():  # joined with others by now
            return self.store.live_documents().join(docs.select(id.alias("doc_id")), "doc_id", "left_semi")
        return self.store.table("documents", [batch])

    def delete(self, id: str) -> bool:
        """Delete a document; true, whether or not it exists."""
        self._deleted.append(self._id(id))
        docs = sum(b["docs"] - b["deleted"] for b in self.store.manifest["batches"]) + len(self._added)
        if len(self._deleted) > max(self.PURGE_LEAST, self.PURGE_SHARE * docs):
            self.flush()
        return True

    def delete_documents(self, ids: DataFrame) -> int:
        """Delete the documents of a table (doc_id); returns how many there were."""
        self.flush()
        return self.store.delete(ids)

    def get(self, id: str) -> Document:
        """A document by its id."""
        key = self._id(id)
        self._write_added()
        self.store.refresh()
        content = None if key in self._deleted else self.store.get(key)
        if content is None:
            raise MissingDocumentError(id)
        return Document(key, content)

    def _write_added(self) -> None:
        added, self._added, self._chars = self._added, [], 0
        if added:
            self.store.append(self.spark.createDataFrame(added, "doc_id string, content string"), self.analyzer)

    def flush(self) -> None:
        """Write what is buffered."""
        self._write_added()
        deleted, self._deleted = self._deleted, []
        if deleted:
            self.store.delete(self.spark.createDataFrame([(d,) for d in deleted], "doc_id string"))

    def merge(self) -> int:
        """Rewrite the batches with many deleted documents, and join small ones; returns how many had so many."""
        self.flush()
        return self.store.merge(self.config.merge_deleted_ratio, self.analyzer)

    def tables(self) -> plans.Tables:
        self._write_added()
        return self.store.tables(self._deleted)

    def search_df(self, query: str, top_k: int = 0) -> DataFrame:
        """(doc_id, score) of a query's matches; of equal scores the smaller id comes first."""
        return plans.search(self.spark, self.tables(), query, self.analyzer, top_k).select("doc_id", "score")

    def search(self, query: str, top_k: int = 0) -> list[Result]:
        """A query's matches with their documents, best first; top_k 0 gives all."""
        tables = self.tables()
        ranked = plans.search(self.spark, tables, query, self.analyzer, top_k)
        rows = plans.hydrate(ranked, tables.documents, top_k).collect()
        return [Result(r["score"], Document(r["doc_id"], r["content"])) for r in rows]

    def search_many(self, queries: dict[str, str] | list[str], top_k: int = 0) -> DataFrame:
        """(query_id, doc_id, score) of many queries in one job; a list's queries are their own ids."""
        if not isinstance(queries, dict):
            queries = {q: q for q in queries}
        return plans.search_many(self.spark, self.tables(), queries, self.analyzer, top_k)

    def search_texts(self, texts: DataFrame, id_col: str = "id", text_col: str = "text", slop: int = 0) -> DataFrame:
        """(query_id, doc_id, score): each text of a table as an exact phrase; the texts never reach the driver."""
        return plans.phrases(self.spark, self.tables(), texts, id_col, text_col, slop, self.analyzer)

    def fuzzy(self, word: str, fuzz: int) -> DataFrame:
        """(token, df, distance): the vocabulary within an edit distance of a word."""
        from .operators.expand import expand, looked_up, terms_table
        from .plans.query import Query, Term

        query = {word: Query((Term(word, fuzz),))}
        return expand(terms_table(self.spark, query), looked_up(self.tables().vocab, query)).select("token", "df", "distance")


class PhraseSearch:
    """Indexes by name."""

    def __init__(self, spark: SparkSession, conf: str | None = None) -> None:
        self.spark, self.conf = spark, conf
        self._indexes: dict[str, Index] = {}

    def add(self, name: str, dir: str, conf: str | None = None) -> tuple[bool, Index]:
        """(whether it is new here, the index)."""
        if name in self._indexes:
            return False, self._indexes[name]
        self._indexes[name] = Index(self.spark, dir, conf or self.conf)
        return True, self._indexes[name]

    def delete(self, name: str) -> None:
        """Forget an index; its files stay."""
        if name not in self._indexes:
            raise MissingIndexError(name)
        self._indexes.pop(name).flush()

    def has_index(self, name: str) -> bool:
        return name in self._indexes

    def index(self, name: str) -> Index:
        if name not in self._indexes:
            raise MissingIndexError(name)
        return self._indexes[name]
