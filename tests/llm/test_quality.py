import math
from pathlib import Path

import pytest
from helpers import MASK, space, word_hash

from phrasewell.llm import quality as Q


def features(text):
    h = [word_hash(w) for w in space(text)]
    pairs = [(a * Q.PAIR + b) & MASK for a, b in zip(h, h[1:])]
    return [x >> (64 - Q.BUCKET_BITS) for x in h + pairs]


def fold(d):
    return (d or 0) % 1_000_003 * 2_654_435_761 // 65_536 % Q.FOLDS


def kinds(labels):
    good = {d for d, q, t in labels if d is not None and q == 1 and t == 0}
    return good, {d for d, q, t in labels if d is not None and q == 0} - good


def scores(rows, labels):
    """(id, n-grams, score) of each row with n-grams, trusted n-grams of its id's fold left out."""
    good, _ = kinds(labels)
    raw, target = [0] * Q.BUCKETS, [[0] * Q.BUCKETS for _ in range(Q.FOLDS)]
    for d, text in rows:
        for b in features(text or ""):
            raw[b] += 1
            for f in range(Q.FOLDS):
                target[f][b] += d in good and fold(d) != f
    n, m = sum(raw) + Q.BUCKETS, [sum(t) + Q.BUCKETS for t in target]
    told = any(map(any, target))
    out = []
    for d, text in rows:
        f, t = features(text or ""), fold(d)
        if f:
            each = [round(math.log((target[t][b] + 1) / m[t] / ((raw[b] + 1) / n)) * Q.SCALE) if told else 0 for b in f]
            out.append((d, len(f), sum(each) / len(f) / Q.SCALE))
    return out


def threshold(found, labels):
    """By trying every step."""
    clean, bad = ([math.floor(s * Q.STEPS) for d, _, s in found if d in of] for of in kinds(labels))
    best = []
    for t in range(min(clean + bad), max(clean + bad) + 2):
        lost, dropped = sum(x < t for x in clean), sum(x < t for x in bad)
        if lost <= (1 - Q.KEEP) * len(clean) + 1e-9:
            best.append((len(clean) * dropped - Q.COST * len(bad) * lost, t))
    best = [t for gain, t in best if gain == max(best)[0]] if bad else [max(best, key=lambda x: x[1])[1]]
    return best[(len(best) - 1) // 2] / Q.STEPS


def brute(rows, labels):
    """The kept rows, toxic words aside."""
    found = scores(rows, labels)
    least = threshold(found, labels)
    return [x for x in found if x[2] >= least]


@pytest.fixture
def corpus(prose, odd):
    rows = odd + [(100 + k, prose.text(80)) for k in range(30)] + [(200 + k, "junk spam " * 30) for k in range(5)]
    labels = [(100 + k, 1, 0) for k in range(20)] + [(200, 0, 0), (201, 1, 1), (100, 0, 0), (None, 1, 0), (7, None, 0), (8, 1, None)]
    return rows, labels


def test_scores_equal_brute_force(spark, documents, corpus):
    rows, labels = corpus
    docs, table = documents(rows, clashing=True), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = sorted(((d, n, round(s, 6)) for d, n, s in brute(rows, labels)), key=str)
    got = sorted(map(tuple, Q.quality_scores(docs.select("doc_id", "text", "score"), table).collect()), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)
    assert not any(d and 200 <= d < 205 for d, _, _ in got) and {100 + k for k in range(30)} <= {d for d, _, _ in got}


def test_filter_keeps_columns_and_clean_rows(spark, full, corpus):
    rows, labels = corpus
    docs, table = full(rows, clashing=True), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kept = Q.quality_filter(docs, table)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {100 + k for k in range(30)} <= set(ids) and not {200, 201, 202, 1, 2, 3} & set(ids)


def test_empty_tables(spark, full):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert Q.quality_filter(full([]), none).collect() == []
    assert list(map(tuple, Q.quality_scores(full([(1, "a b"), (2, "")]), none).collect())) == [(1, 3, 0.0)]


def test_held_out_labels(spark):
    """Documents whose labels weren't counted are told apart, too."""
    path = Path("/root/testdata/sf0.01")
    if not path.exists():
        pytest.skip("the test tables aren't here")
    docs, labels = (spark.read.parquet(str(path / f"{t}.parquet")) for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in Q.quality_scores(docs, labels.where("doc_id % 3 <> 0")).collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    clean = [r["doc_id"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["doc_id"] for r in held if r["quality"] == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d not in kept for d in junk) >= 0.85 * len(junk)


def test_toxic_words_are_learned(documents, full, spark, prose):
    """Clean prose with one rude word is told apart, labelled or not."""
    rude = ["Grumbold!", "snarkle", "(zorply)"]
    text = lambda k: " ".join([prose.text(60), rude[k % 3], prose.text(60)])
    rows = [(k, prose.text(120)) for k in range(300)] + [(1000 + k, text(k)) for k in range(40)]
    labels = [(k, 1, 0) for k in range(150)] + [(1000 + k, 1, 1) for k in range(20)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for kept in (Q.quality_filter(full(rows), table, -9.0), Q.quality_scores(documents(rows), table, -9.0)):
        assert {r["doc_id"] for r in kept.collect()} == set(range(300))
