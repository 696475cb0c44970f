"""The index's life: add, delete, flush, merge, reopen, registry, streams."""

import random
import re

import pyarrow.parquet as pq
import pytest

from phrasewell import Index, PhraseSearch
from phrasewell.errors import ConfigError, DocumentIdError, MissingDocumentError, MissingIndexError
from phrasewell.operators import phrase
from phrasewell.functions.analysis import Analyzer
from phrasewell.sources import store, ulid
from phrasewell.sources.config import Config
from phrasewell.sources.store import Store
from phrasewell.streaming.ingest import delete_stream, ingest


def contents(index, query, top_k=0):
    return [r.document.content for r in index.search(query, top_k)]


def test_life(spark, tmp_path):
    path = str(tmp_path / "index")
    index = Index(spark, path)
    assert contents(index, "fox") == []
    with index.session():
        ids = [index.add(t) for t in ("the quick brown fox", "quick foxes", "a brown bear", "", "fox")]
    assert sorted(ids) == ids and index.get(ids[3]).content == ""
    assert set(contents(index, "fox")) == {"the quick brown fox", "quick foxes", "fox"}
    assert contents(index, '"quick fox"') == ["quick foxes"]
    assert set(contents(index, '"quick fox"~1')) == {"quick foxes", "the quick brown fox"}
    assert len(contents(index, "fox", 2)) == 2
    assert sorted(r["token"] for r in index.fuzzy("brow", 1).collect()) == ["brown"]
    before = {r.document.id: r.score for r in index.search("fox")}
    again = Index(spark, path)
    assert {r.document.id: r.score for r in again.search("fox")} == pytest.approx(before)
    assert again.delete(ids[0]) and again.delete(ulid.encode(5))
    assert set(contents(again, "fox")) == {"quick foxes", "fox"}
    with pytest.raises(MissingDocumentError):
        again.get(ids[0])
    # Hidden at once; the counts are taken back when it is written.
    assert {r.document.id: r.score for r in again.search("fox")} == pytest.approx({k: v for k, v in before.items() if k != ids[0]})
    again.flush()
    left = {r.document.id: r.score for r in again.search("fox")}
    assert again.merge() == 0 and again.store.merge(0.1, again.analyzer) == 1
    assert {r.document.id: r.score for r in Index(spark, path).search("fox")} == pytest.approx(left)
    # Scores are those of an index that never held the document.
    fresh = Index(spark, str(tmp_path / "fresh"))
    with fresh.session():
        for t in ("quick foxes", "a brown bear", "", "fox"):
            fresh.add(t)
    assert sorted(r.score for r in fresh.search("fox")) == pytest.approx(sorted(left.values()))


def test_deleting_everything(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    id = index.add("fox")
    index.delete(id)
    assert contents(index, "fox") == []
    index.merge()
    index.add("fox den")
    assert contents(index, "fox") == ["fox den"] and index.search("fox")[0].score > 0


def test_deleting_twice_counts_once(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    ids = [index.add(t) for t in ("a1 b1", "b1", "c1")]
    index.flush()
    index.delete(ids[0])
    index.flush()
    index.delete(ids[0])
    index.flush()
    assert index.store.corpus().first()["n_docs"] == 2
    assert {r["token"]: r["df"] for r in index.tables().vocab.collect()} == {"b1": 1, "c1": 1}


def test_bulk_and_batch_search(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    docs = spark.createDataFrame([(f"text {k} fox",) for k in range(20)], "content string")
    added = index.add_documents(docs)
    assert len({r["doc_id"] for r in added.collect()}) == 20 and all(ulid.check(r["doc_id"]) for r in added.collect())
    index.add_documents(spark.createDataFrame([(7, "own fox")], "k int, content string"), id_col="k")
    got = index.search_many(["fox", '"own fox"'], 3).collect()
    assert sorted(r["query_id"] for r in got) == ['"own fox"', "fox", "fox", "fox"]
    assert index.delete_documents(added.limit(5).select("doc_id")) == 5
    assert index.search_df("fox").count() == 16


def test_added_deleted_added(spark, tmp_path):
    """An id that was deleted can be added again, with other words; only these count."""
    index = Index(spark, str(tmp_path))
    add = lambda *rows: index.add_documents(spark.createDataFrame(rows, "k string, content string"), id_col="k")
    add(("x", "red fox"), ("y", "red hen"))
    assert index.delete("x") and contents(index, "fox") == []
    index.flush()
    add(("x", "blue fox fox"))
    assert contents(index, "fox") == ["blue fox fox"] and contents(index, "red") == ["red hen"] and index.get("x").content == "blue fox fox"
    assert index.store.corpus().first()["n_docs"] == 2
    assert {r["token"]: r["df"] for r in index.tables().vocab.collect()} == {"red": 1, "hen": 1, "blue": 1, "fox": 1}
    before = index.search("fox")
    index.store.merge(0.0)
    assert index.search("fox") == before and contents(index, "hen") == ["red hen"]
    index.delete("x")
    with pytest.raises(MissingDocumentError):
        index.get("x")
    index.flush()
    with pytest.raises(MissingDocumentError):
        index.get("x")
    with pytest.raises(DocumentIdError):
        Index(spark, str(tmp_path / "other")).get("x")


def test_deletions_are_purged_when_many(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.PURGE_LEAST = 2
    ids = [index.add(f"fox {k}x") for k in range(9)]
    index.tables()
    for n, id in enumerate(ids[:3]):
        assert index.store.corpus().first()["n_docs"] == 9 and len(index._deleted) == n
        index.delete(id)
    assert index.store.corpus().first()["n_docs"] == 6 and not index._deleted and len(contents(index, "fox")) == 6


def test_two_writers(spark, tmp_path):
    """Neither loses what the other wrote, whatever each of them had read."""
    from concurrent.futures import ThreadPoolExecutor

    docs = lambda *rows: spark.createDataFrame(rows, "doc_id string, content string")
    ids = lambda *rows: spark.createDataFrame([(r,) for r in rows], "doc_id string")
    a, b, plain = Store(spark, str(tmp_path)), Store(spark, str(tmp_path)), Config().analyzer()
    a.append(docs(("1", "red fox")), plain)
    b.append(docs(("2", "fox")), plain)
    assert len(Store(spark, str(tmp_path)).batches()) == 2 and a.delete(ids("2")) == 1 and b.delete(ids("2")) == 0
    with ThreadPoolExecutor(4) as pool:
        work = [pool.submit(s.append, docs((str(k), "fox den")), plain) for k, s in ((3, a), (4, b), (5, Store(spark, str(tmp_path))))]
        work += [pool.submit(b.delete, ids("1")), pool.submit(a.delete, ids("1"))]
        assert [w.result() for w in work][3:].count(1) == 1
    last = Store(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in last.live_documents().collect()) == ["3", "4", "5"]
    assert last.corpus().first()["n_docs"] == 3 and {r["token"]: r["df"] for r in last.tables().vocab.collect()} == {"fox": 3, "den": 3}
    # A commit that another one came before, in another process: the version exists already.
    a.manifest = {**last.manifest, "version": 0}
    assert not a._create({"version": last.manifest["version"]})
    merged = last.manifest["epoch"]
    assert last.merge(0.0) >= 0 and last.manifest["epoch"] in (merged, merged + 1)


def test_small_batches_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("phrasewell.sources.store.SMALL_BATCHES", 4)
    index = Index(spark, str(tmp_path))
    for k in range(6):
        index.add(f"fox {k}k")
        index.flush()
    assert len(index.store.batches()) == 3 and len(contents(index, "fox")) == 6
    assert index.store.corpus().first()["n_docs"] == 6


def test_policy_is_size_or_age(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.config = Config(documents_buffer_size=10, documents_save_after_seconds=1000)
    index.add("a fox")
    assert index._added
    index.add("another fox")
    assert not index._added
    index.config = Config(documents_save_after_seconds=-1)
    index.add("a third fox")
    assert not index._added and len(contents(index, "fox")) == 3


def test_texts_as_phrases(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    with index.session():
        for t in ("one two three four five six", "two three", "six five", ""):
            index.add(t)
    texts = spark.createDataFrame([(1, "two three four"), (2, "one three"), (3, None), (4, "the"), (5, "one two three four five six")], "id int, text string")
    got = {r["query_id"]: r["score"] for r in index.search_texts(texts, slop=1).collect()}
    assert set(got) == {"1", "2", "5"}
    assert got["1"] == pytest.approx(index.search('"two three four"~1')[0].score) and got["2"] == pytest.approx(index.search('"one three"~1')[0].score)


def test_texts_shuffle_no_postings(spark, tmp_path, capsys, monkeypatch):
    """The rarest terms name the documents; postings are looked up where they are, unless too many documents are named."""
    index = Index(spark, str(tmp_path))
    common = "one two three four five six seven eight"
    texts = [f"{common} rare{k}" for k in range(4)] + [common, common, f"rare0 {common}", "eight seven six five", "rare1 rare2 rare3"]
    with index.session():
        for t in texts:
            index.add(t)
    wanted = {"a": f"{common} rare0", "b": "three four five six seven", "c": "one seven", "d": "rare1 unheard", "e": "rare2 rare3", "f": f"two one {common}"}
    queries = spark.createDataFrame(list(wanted.items()), "id string, text string")
    want = sorted((q, t) for q, text in wanted.items() for t in texts if f" {text} " in f" {t} ")

    def found():
        got = index.search_texts(queries).join(index.tables().documents, "doc_id")
        return sorted((r["query_id"], r["content"]) for r in got.collect())

    assert len(want) == 9 and found() == want
    monkeypatch.setattr(phrase, "BROADCAST_ROWS", 0, raising=False)
    assert found() == want
    monkeypatch.undo()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.search_texts(queries).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    assert shuffled and not any("positions" in x for x in shuffled)


def test_postings_are_sorted_some_at_a_time(spark, tmp_path, monkeypatch):
    """A task sorts SORTED_BYTES of postings, whatever size files may have; files are sorted ranges, also after a merge."""
    monkeypatch.setattr(store, "SORTED_BYTES", 12_000, raising=False)
    rng = random.Random(7)
    texts = {f"{k:05d}": [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(120))] for k in range(400)}
    made = Store(spark, str(tmp_path))
    for part in (0, 1):
        some = [(k, " ".join(w)) for k, w in texts.items() if int(k) % 2 == part]
        made.append(spark.createDataFrame(some, "doc_id string, content string"), Analyzer(stem=False))
    made.delete(spark.createDataFrame([("00003",), ("00004",)], "doc_id string"))
    left = {k: w for k, w in texts.items() if k not in ("00003", "00004")}
    for live in (texts, left):
        files = [pq.read_table(p).to_pylist() for b in made.batches() for p in sorted((tmp_path / b).glob("postings/part-*"))]
        assert len(files) > 4
        for rows in files:
            keys = [(r["token"], r["doc_id"]) for r in rows]
            assert keys == sorted(keys)
        got = {(r["token"], r["doc_id"]): (r["tf"], r["n_distinct"], r["positions"]) for rows in files for r in rows}
        at = {(t, k): [i for i, x in enumerate(w) if x == t] for k, w in live.items() for t in set(w)}
        assert got == {(t, k): (len(p), len(set(live[k])), p) for (t, k), p in at.items()}
        stats = {r["doc_id"]: (r["len"], r["n_distinct"], set(r["tokens"])) for r in made.live("doc_stats").collect()}
        assert stats == {k: (len(w), len(set(w)), set(w)) for k, w in left.items()}
        made.merge(0.0)


def test_registry(spark, tmp_path):
    engine = PhraseSearch(spark)
    fresh, index = engine.add("a", str(tmp_path))
    assert fresh and engine.add("a", str(tmp_path)) == (False, index)
    assert engine.has_index("a") and engine.index("a") is index
    index.add("fox")
    engine.delete("a")
    assert not engine.has_index("a")
    for call in (engine.index, engine.delete):
        with pytest.raises(MissingIndexError):
            call("a")
    assert contents(engine.add("a", str(tmp_path))[1], "fox") == ["fox"]


def test_a_failed_session_still_writes(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    with pytest.raises(RuntimeError), index.session():
        index.add("fox")
        raise RuntimeError
    assert contents(Index(spark, str(tmp_path)), "fox") == ["fox"]


def test_ids():
    made = ulid.Generator()
    ids = [made.next() for _ in range(2000)]
    assert sorted(set(ids)) == ids and all(ulid.check(i.lower()) == i for i in ids)
    for bad in ("", "x" * 26, "8" + "0" * 25, "U" * 26):
        with pytest.raises(DocumentIdError):
            ulid.check(bad)


def test_config(tmp_path):
    assert Config.load() == Config()
    path = tmp_path / "c.toml"
    path.write_text('segment_size = 1024\nstop_words = ["fox"]\nunknown = 1\n')
    config = Config.load(str(path))
    assert config.segment_size == 1024 and config.stop_words == {"fox"} and config.merge_deleted_ratio == 0.3
    for bad in ('segment_size = "x"', "stem = 1", "x ="):
        path.write_text(bad)
        with pytest.raises(ConfigError):
            Config.load(str(path))
    with pytest.raises(ConfigError):
        Config.load(str(tmp_path / "none"))


def test_small_segments(spark, tmp_path):
    store = Store(spark, str(tmp_path), 1024)
    docs = spark.createDataFrame([(str(k), "fox " * 100) for k in range(20)], "doc_id string, content string")
    store.append(docs, Config().analyzer())
    assert len(store.table("documents").inputFiles()) > 4 and store.tables().vocab.first()["df"] == 20


def test_streams(spark, tmp_path):
    source, gone = tmp_path / "source", tmp_path / "gone"
    spark.createDataFrame([("1", "red fox"), ("2", "fox"), ("2", "fox"), ("3", None)], "doc_id string, content string").write.parquet(str(source))
    spark.createDataFrame([("2",)], "doc_id string").write.parquet(str(gone))
    index = Index(spark, str(tmp_path / "index"))
    stream = lambda path, schema: spark.readStream.schema(schema).parquet(str(path))
    for _ in range(2):  # the second run finds nothing new
        ingest(stream(source, "doc_id string, content string"), index, str(tmp_path / "c1"), once=True).awaitTermination()
    assert index.store.corpus().first()["n_docs"] == 3
    ingest(stream(source, "doc_id string, content string"), index, str(tmp_path / "c2"), once=True).awaitTermination()  # ids are known
    assert index.store.corpus().first()["n_docs"] == 3
    delete_stream(stream(gone, "doc_id string"), index, str(tmp_path / "c3"), once=True).awaitTermination()
    assert [r["doc_id"] for r in index.search_df("fox").collect()] == ["1"]


def test_both_streams_at_once(spark, tmp_path):
    source, gone = tmp_path / "source", tmp_path / "gone"
    index = Index(spark, str(tmp_path / "index"))
    index.add_documents(spark.createDataFrame([(str(k), "old fox") for k in range(10)], "k string, content string"), id_col="k")
    for k in range(3):
        spark.createDataFrame([(f"n{k}", "new fox")], "doc_id string, content string").coalesce(1).write.mode("append").parquet(str(source))
        spark.createDataFrame([(str(k),)], "doc_id string").coalesce(1).write.mode("append").parquet(str(gone))
    stream = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    runs = [ingest(stream(source, "doc_id string, content string"), index, str(tmp_path / "c1"), once=True)]
    runs.append(delete_stream(stream(gone, "doc_id string"), index, str(tmp_path / "c2"), once=True))
    for run in runs:
        run.awaitTermination()
    assert sorted(r["doc_id"] for r in index.search_df("fox").collect()) == [*map(str, range(3, 10)), "n0", "n1", "n2"]
    assert Index(spark, str(tmp_path / "index")).store.corpus().first()["n_docs"] == 10
