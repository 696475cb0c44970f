"""Word boundaries of many scripts, and tokens of odd texts."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasewell.functions import analysis
from phrasewell.functions.analysis import Analyzer

WORDS = {
    "Hello, world! It's 3.14 or 944,735.": ["hello", "world", "it's", "3.14", "or", "944,735"],
    "F.C. U.S.A. a:b a.1 1.a 1,a a,b x_y __ _z_ can\u2019t": ["f.c", "u.s.a", "a:b", "a", "1", "1", "a", "1", "a", "a", "b", "x_y", "_z_", "can\u2019t"],
    "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35": ["\u0e2a", "\u0e27\u0e31", "\u0e2a", "\u0e14\u0e35"],
    "abc\u30ab\u30ca\u30fc \u30ab_a": ["abc", "\u30ab\u30ca\u30fc", "\u30ab_a"],
    "\u65e5\u672c\u8a9e\u3072\u3089 \ud55c\uad6d\uc5b4": ["\u65e5", "\u672c", "\u8a9e", "\u3072", "\u3089", "\ud55c\uad6d\uc5b4"],
    "e\u0301t\u00e9 na\u00ad\u00efve x\u00b2 \u2167 \u00c9A": ["e\u0301t\u00e9", "na\u00ad\u00efve", "x", "\u00b2", "\u2167", "\u00c9a"],
    "\u05d0\u05d1 \u0627\u0644\u0639\u0631\u0628\u064a\u0629 \u0e81\u0e82 \u1780\u1781 \u1000": ["\u05d0\u05d1", "\u0627\u0644\u0639\u0631\u0628\u064a\u0629", "\u0e81", "\u0e82", "\u1780", "\u1781", "\u1000"],
    "": [],
    None: [],
    " \n\t...!? --- ___": [],
}


@pytest.mark.parametrize("text", WORDS, ids=range(len(WORDS)))
def test_words(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(analysis.words(F.col("text")).alias("w")).first()["w"] == WORDS[text]


def test_long_words_and_lines(spark):
    n = 300_000
    texts = ["a" * n, "a1" * n, "1." * n, "a." * n, "_" * n, "\u0e2a" * n, "a " * n, "e\u0301" * n, "\u30ab" * n, "a_" * n]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.size(analysis.words(F.col("text"))).alias("n"))
    assert [r["n"] for r in df.collect()] == [1, 1, 1, 1, 0, n, n, 1, 1, 1]


def test_indexed(spark):
    docs = spark.createDataFrame([(1, "the foxes fox runs, foxes"), (2, ""), (3, None), (None, "fox"), (1, "hen")], "doc_id int, text string")
    table = analysis.indexed(docs, Analyzer()).cache()
    rows = sorted((str(r["doc_id"]), r["token"], r["tf"], r["n_distinct"], r["positions"]) for r in analysis.postings(table).collect())
    assert rows == [("1", "fox", 3, 2, [0, 1, 3]), ("1", "hen", 1, 1, [0]), ("1", "run", 1, 2, [2]), ("None", "fox", 1, 1, [0])]
    stats = sorted(((str(r["doc_id"]), r["len"], r["n_distinct"], sorted(r["tokens"])) for r in analysis.doc_stats(table).collect()), key=str)
    assert stats == [("1", 1, 1, ["hen"]), ("1", 4, 2, ["fox", "run"]), ("2", 0, 0, []), ("3", 0, 0, []), ("None", 1, 1, ["fox"])]
    tokens = sorted((r["pos"], r["token"]) for r in analysis.occurrences(docs.limit(1)).collect())
    assert tokens == [(0, "fox"), (1, "fox"), (2, "run"), (3, "fox")]


def test_nothing_is_shuffled(spark, capsys):
    docs = spark.createDataFrame([(1, "fox")], "doc_id int, text string")
    for table in (analysis.occurrences(docs), analysis.postings(analysis.indexed(docs)), analysis.doc_stats(analysis.indexed(docs))):
        table.explain()
        assert "Exchange" not in capsys.readouterr().out


@pytest.mark.parametrize("stemming", [False, True])
def test_memory_does_not_grow_with_batches(stemming):
    """Of a batch of many documents some are analyzed at a time; a long one, between empty ones, is whole."""
    words = [f"word{k % 5003}s" for k in range(1_000_000)]
    lists = [words[k : k + 200] for k in range(0, 600_000, 200)] + [[], words[: analysis.WORDS_AT_ONCE + 7], [], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "words"]).slice(5)
    tracemalloc.start()
    out, rows = [], 0
    for x in analysis._analyzed(iter([batch]), stemming):
        out.append([x.slice(0, 1).to_pylist()[0], x.num_rows])
        assert x.num_rows == 1 or sum(x.column(1).to_pylist()) <= analysis.WORDS_AT_ONCE
        rows += x.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == batch.num_rows and len(out) > 6 and peak < 40e6
    first = out[0][0]
    assert (first["doc_id"], first["len"], first["n_distinct"]) == (5, 200, 200)
    want = [(w.removesuffix("s") if stemming else w, [k]) for k, w in enumerate(lists[5])]
    assert list(zip(first["tokens"], first["positions"])) == want
    long = next(x for x, n in out if x["len"] > analysis.WORDS_AT_ONCE)
    assert long["n_distinct"] == 5003 and sorted(p for at in long["positions"] for p in at) == list(range(analysis.WORDS_AT_ONCE + 7))


def test_stem_lists_in_parts(spark):
    """Lists are stemmed some at a time, with their bounds kept."""
    texts = [("foxes jumping " * k,) for k in range(300)] + [("hens " * (analysis.WORDS_AT_ONCE + 1),), ("",), (None,)]
    df = spark.createDataFrame(texts, "text string").coalesce(1).select("text", analysis.tokens(F.col("text")).alias("t"))
    for r in df.collect():
        assert r["t"] == [{"foxes": "fox", "jumping": "jump", "hens": "hen"}[w] for w in (r["text"] or "").split()]
