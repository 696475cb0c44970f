"""Search against a brute-force matcher that tries all position tuples."""

import itertools
import math
import random

import pytest

from phrasewell.functions.analysis import STOP_WORDS, Analyzer
from phrasewell.functions.stemmer import stem
from phrasewell.plans import search as plans
from phrasewell.plans.query import analyze, parse

PLAIN = Analyzer(stem=False)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute(docs, text, analyzer=PLAIN):
    """{doc_id: score}, docs being {doc_id: [words]}."""
    query = analyze(parse(text), analyzer)
    docs = {k: [stem(w) if analyzer.stem else w for w in words if w not in analyzer.stop_words] for k, words in docs.items()}
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    n, avg = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    out = {}
    for k, words in docs.items():
        sets = []
        for term in query.terms:
            found = {}
            for p, w in enumerate(words):
                d = distance(w, term.text)
                if d <= term.fuzz and (d == 0 or len(w) > term.fuzz and len(term.text) > term.fuzz):
                    tf, dl = words.count(w), len(set(words))
                    idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                    found[p] = idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) * 0.8**d
            sets.append(found)
        if not sets:
            continue
        # Of all ascending tuples from one start, the chain of nearest positions is what counts.
        best = 0.0
        for start in sets[0]:
            tuples = [t for t in itertools.product([start], *[sorted(s) for s in sets[1:]]) if all(a < b for a, b in zip(t, t[1:]))]
            if tuples:
                t = min(tuples)
                gaps = t[-1] - t[0] - (len(t) - 1)
                assert gaps == min(u[-1] - u[0] - (len(u) - 1) for u in tuples)
                if gaps <= query.slop:
                    best = max(best, sum(s[p] for s, p in zip(sets, t)) / (gaps + 1))
        if best > 0:
            out[k] = best
    return out


@pytest.fixture(scope="module")
def words():
    rng = random.Random(7)
    vocabulary = ["er", "era", "eras", "tion", "tions", "nation", "ing", "the", "of", "x", "xy", "ring", "rings"]
    docs = {k: rng.choices(vocabulary, k=rng.randint(0, 14)) for k in range(40)}
    return docs | {90: [], 91: docs[3], 92: ["the", "of"]}


@pytest.fixture(scope="module")
def tables(spark, words):
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in words.items()], "doc_id bigint, text string")
    return {stems: plans.from_documents(docs, Analyzer(stem=stems)) for stems in (False, True)}


def found(spark, tables, query, analyzer=PLAIN, top_k=0):
    return {r["doc_id"]: r["score"] for r in plans.search(spark, tables[analyzer.stem], query, analyzer, top_k).collect()}


MATRIX = [f'"{a}~{f} {b}~{f}{c}"~{s}' for a, b, c in (("er", "tion", ""), ("ring", "era", " xy"), ("tion", "tion", "")) for f in (0, 1, 2) for s in (0, 2)]


def test_phrases_equal_brute_force_in_one_batch(spark, tables, words):
    got = plans.search_many(spark, tables[False], {q: q for q in MATRIX}, PLAIN).collect()
    by = {q: {} for q in MATRIX}
    for r in got:
        by[r["query_id"]][r["doc_id"]] = r["score"]
    hits = 0
    for q in MATRIX:
        assert by[q] == pytest.approx(brute(words, q)), q
        hits += len(by[q])
    assert hits > 50


@pytest.mark.parametrize("query", ["er", "x~2", '"rings nations"~3', "the of", "zzz", "er zzz"])
def test_single_queries(spark, tables, words, query):
    for analyzer in (PLAIN, Analyzer()):
        assert found(spark, tables, query, analyzer) == pytest.approx(brute(words, query, analyzer))


def test_top_k_takes_the_best_and_breaks_ties_by_id(spark, tables, words):
    want = sorted(brute(words, "er").items(), key=lambda x: (-round(x[1], 9), x[0]))
    for k in (1, 5, 10):
        assert list(found(spark, tables, "er", top_k=k)) == [d for d, _ in want[:k]]
    many = plans.search_many(spark, tables[False], {"q": "er", "p": "x"}, PLAIN, 2).collect()
    assert {(r["query_id"], r["doc_id"]) for r in many} >= {("q", d) for d, _ in want[:2]} and len(many) == 4
    with pytest.raises(ValueError):
        plans.top(tables[False].vocab, -1)


def test_skipping_by_bounds_changes_nothing(spark, tables, words):
    for query in MATRIX[1::5]:
        want = sorted(brute(words, query).items(), key=lambda x: (-round(x[1], 9), x[0]))
        for k in (1, 3, 100):
            assert list(found(spark, tables, query, top_k=k)) == [d for d, _ in want[:k]], query
    with pytest.raises(ValueError):
        plans.search(spark, tables[False], "er", PLAIN, -1)


def test_pushing_tokens_down_changes_nothing(spark, tables):
    for query in ('"er~1 tion~2"~2', "zzz"):
        with_, without = (sorted(map(tuple, plans.search(spark, tables[False], query, PLAIN, 0, push).collect())) for push in (True, False))
        assert with_ == without


def test_empty_corpus(spark):
    none = plans.from_documents(spark.createDataFrame([], "doc_id bigint, text string"), PLAIN)
    assert plans.search(spark, none, "er", PLAIN).collect() == []
    assert none.corpus.first()["avg_doc_len"] is None


def test_clashing_and_null_columns(spark):
    docs = spark.createDataFrame([(1, "er tion", 5), (2, None, 6)], "doc_id bigint, text string, token bigint")
    t = plans.from_documents(docs, PLAIN)
    assert [r["doc_id"] for r in plans.search(spark, t, "er tion", PLAIN).collect()] == [1]
    assert t.corpus.first()["n_docs"] == 2


def test_words(spark):
    from pyspark.sql import functions as F

    from phrasewell.functions.analysis import words as split

    def of(text):
        return spark.createDataFrame([(text,)], "t string").select(split(F.col("t"))).first()[0]

    assert of("It's 944,735 F.C. O’Neil x_y _ ÀB a.b, c") == ["it's", "944,735", "f.c", "o’neil", "x_y", "Àb", "a.b", "c"]
    assert of("漢字 ひら ½") == ["漢", "字", "ひ", "ら", "½"]
    assert of(None) == [] and of("") == [] and of(" .,; ") == []
    assert len(STOP_WORDS) == 35
