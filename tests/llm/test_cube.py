import numpy as np
import pytest

from phrasewell.llm import cube as C


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 2000])
def test_flight_keeps_both_totals(n):
    rng = np.random.default_rng(n)
    words, p = rng.integers(0, 5000, n).astype(float), rng.uniform(0, 1, n)
    docs = np.ones(n)
    out = C.flight(p, docs, words, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ words == pytest.approx(p @ words, rel=1e-6, abs=1e-6)
    landed = C.landing(out, docs, words, np.random.default_rng(1))
    assert set(landed.tolist()) <= {0.0, 1.0} and abs(landed.sum() - p.sum()) < 1 + 1e-6


def test_inclusion_probabilities_are_kept():
    rng = np.random.default_rng(5)
    words, p = rng.integers(1, 50, 12).astype(float), rng.uniform(0.1, 0.9, 12)
    total = np.zeros(12)
    for k in range(3000):
        r = np.random.default_rng(k)
        total += C.landing(C.flight(p, np.ones(12), words, r), np.ones(12), words, r)
    assert np.abs(total / 3000 - p).max() < 0.04


def rows_of(prose, sizes):
    return [(1000 * s + k, prose.text(prose.rng.randint(1, 60)), f"src{s}") for s, n in enumerate(sizes) for k in range(n)]


@pytest.mark.parametrize("group", [4096, 50])
def test_mixture_meets_its_targets(full, prose, monkeypatch, group):
    monkeypatch.setattr(C, "GROUP", group)
    rows = rows_of(prose, (400, 300, 200))
    weights = {"src0": 1.0, "src1": 2.0, "src2": 1.0}
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in weights}
    most = min(words[s] / w for s, w in weights.items())
    got = C.mixture(full(rows, clashing=True), weights).collect()
    for s, w in weights.items():
        mine = [r for r in got if r["source"] == s]
        p = most * w / words[s]
        n = sum(x == s for *_, x in rows)
        assert sum(r["n_words"] for r in mine) == pytest.approx(most * w, abs=130)
        assert len(mine) == pytest.approx(p * n, abs=2)
    assert len({r["doc_id"] for r in got}) == len(got)


def test_draws_do_not_depend_on_partitions(full, prose):
    docs = full(rows_of(prose, (300, 100)))
    one, two = (sorted(map(tuple, C.mixture(d).collect())) for d in (docs.repartition(1), docs.repartition(5)))
    assert one == two and len(one) < 400


def test_smallest_source_stays_whole_by_default(full, prose):
    rows = rows_of(prose, (300, 30))
    got = [r["doc_id"] for r in C.mixture(full(rows)).collect()]
    assert {i for i, _, s in rows if s == "src1"} <= set(got) and len(got) < len(rows)


def test_filter_and_odd_rows(full, documents, odd, prose):
    docs = full(odd + rows_of(prose, (60,)), clashing=True)
    out = C.mix(docs)
    assert out.columns == docs.columns and out.count() == docs.count()  # a single source is taken whole
    null = documents([(1, "a b", None), (2, "c", None), (None, "d", "x"), (3, None, "y")], "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in C.mix(null, None).collect()} >= {3}
    assert C.mix(full(rows_of(prose, (20, 20))), {"src0": 1.0}).where("source <> 'src0'").count() == 0
    assert C.mix(full([])).collect() == [] and C.mixture(full([])).collect() == []


def test_repeated_rows_go_together(full, prose):
    rows = rows_of(prose, (200, 20))
    kept = [r["doc_id"] for r in C.mix(full(rows + rows)).collect()]
    assert all(kept.count(i) == 2 for i in set(kept))


@pytest.mark.parametrize("weights", [None, {"src0": 100.0, "src1": 100.0, "tiny": 1.0}])
def test_tiny_source_does_not_bound_the_draw(full, prose, weights):
    rows = rows_of(prose, (300, 300)) + [(9000, "a b", "tiny")]
    got = [r["doc_id"] for r in C.mixture(full(rows), weights).collect()]
    assert 9000 in got and len(got) > 0.9 * len(rows)


def outcomes(p, words):
    """{decided values: chance} of the flight and landing, both ways of every step followed; directions from a singular value decomposition."""
    out = {}

    def both(p, u, chance, then):
        ahead = min(((1 - x) / v if v > 0 else -x / v) for x, v in zip(p, u) if abs(v) > 1e-12)
        back = min((x / v if v > 0 else (x - 1) / v) for x, v in zip(p, u) if abs(v) > 1e-12)
        for way, share in ((ahead, back / (ahead + back)), (-back, ahead / (ahead + back))):
            moved = [x + way * v for x, v in zip(p, u)]
            then([0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in moved], chance * share)

    def flight(p, chance):
        active = [k for k, x in enumerate(p) if 0 < x < 1][:3]
        if len(active) < 3:
            return landing(p, chance)
        a = np.array([[1.0] * 3, [words[k] for k in active]])
        u = np.zeros(len(p))
        u[active] = np.linalg.svd(a)[2][-1]
        both(p, u, chance, flight)

    def landing(p, chance):
        active = [k for k, x in enumerate(p) if 0 < x < 1]
        if len(active) == 2:
            u = np.zeros(len(p))
            u[active] = 1, -1
            return both(p, u, chance, landing)
        for k in active:
            landing([*p[:k], 1.0, *p[k + 1 :]], chance * p[k])
            return landing([*p[:k], 0.0, *p[k + 1 :]], chance * (1 - p[k]))
        key = tuple(map(int, p))
        out[key] = out.get(key, 0) + chance

    flight(list(p), 1.0)
    return out


def test_draws_equal_all_ways_of_the_steps():
    words, p, n = [3.0, 10.0, 4.0, 7.0, 1.0, 6.0], [0.3, 0.5, 0.8, 0.4, 0.25, 0.6], 6000
    want = outcomes(p, words)
    assert sum(want.values()) == pytest.approx(1) and len(want) > 5
    assert [sum(c for key, c in want.items() if key[k]) for k in range(6)] == pytest.approx(p)
    found = {}
    for k in range(n):
        rng = np.random.default_rng(k)
        key = tuple(C.landing(C.flight(np.array(p), np.ones(6), np.array(words), rng), np.ones(6), np.array(words), rng).astype(int).tolist())
        found[key] = found.get(key, 0) + 1
    assert set(found) <= set(want)
    assert all(found.get(key, 0) / n == pytest.approx(c, abs=5 * (c * (1 - c) / n) ** 0.5 + 1e-9) for key, c in want.items())
