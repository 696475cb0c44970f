import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import alnum, mix, space, word_hash

from phrasewell.llm import common
from phrasewell.llm import textvec as V


def test_components_equal_a_search(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (40, 30), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 3), (3, None), (5, 5)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        want = {x: find(x) for x in list(root)}
        got = common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_unfinished_components_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(50)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        common.components(path, 1)


def test_tables_are_shared_and_released(spark, tmp_path):
    df = common.materialize(spark.range(5), "x")
    assert df.count() == 5 and df._phrasewell_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.release(df)
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_checked_broadcast(spark, capsys):
    big, small = spark.range(1000), spark.range(10).withColumnRenamed("id", "k")
    big.join(common.checked(small), big["id"] == small["k"]).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
    assert common.checked(small, 9) is small


@pytest.mark.parametrize(("kind", "split"), [(V.ALNUM, alnum), (V.SPACE, space)])
def test_words(kind, split):
    texts = ["It's A-b\tc", "", None, "é漢 x", " ", "a" * 300, "x"]
    for size in (8, 1 << 20):
        V.SLICE_BYTES, before = size, V.SLICE_BYTES
        try:
            got = {}
            for w in V.slices(pa.array(texts), kind):
                for k in range(len(w.bounds) - 1):
                    got[w.first + k] = w.hash[w.bounds[k] : w.bounds[k + 1]].tolist()
        finally:
            V.SLICE_BYTES = before
        assert got == {k: [word_hash(x) for x in split(t or "")] for k, t in enumerate(texts)}


def test_simhash_equals_counting():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 700).astype(np.uint64)
    bounds = np.array([0, 0, 3, 600, 700, 700])
    got = V.simhash(h, bounds, 2)
    for k in range(5):
        for lane in range(2):
            feats = [mix((int(x) + 0xA0761D6478BD642F * (lane + 1)) & (2**64 - 1)) for x in h[bounds[k] : bounds[k + 1]]]
            want = sum(1 << b for b in range(64) if 2 * sum(f >> b & 1 for f in feats) > len(feats))
            assert int(got[k, lane]) == want
