from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import alnum

from phrasewell.llm import suffix_dedup as S
from phrasewell.llm import textvec as V


def brute(rows):
    """Spans, from a table of all MIN_WORDS-word passages."""
    n = S.MIN_WORDS
    docs = dict.fromkeys((i, tuple(alnum(t))) for i, t in rows if i is not None and t is not None)
    seen = defaultdict(list)
    for i, w in docs:
        for k in range(len(w) - n + 1):
            seen[w[k : k + n]].append((i, w, k))
    covered, later = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            first = min(places, key=lambda x: (x[0], x[2]))
            for p in places:
                covered[p[:2]] |= set(range(p[2], p[2] + n))
                if p != first:
                    later[p[:2]] |= set(range(p[2], p[2] + n))
    out = []
    for doc, words in covered.items():
        for k in sorted(words):
            if k - 1 not in words:
                end = k
                while end in words:
                    end += 1
                out.append((doc[0], k, end - k, len(later[doc] & set(range(k, end)))))
    return sorted(out)


def planted(prose):
    passages = [prose.text(n) for n in (49, 50, 51, 60, 200, 90)]
    rows = []
    for k in range(120):
        words = prose.text(prose.rng.randint(0, 150)).split()
        for _ in range(prose.rng.randint(0, 3)):
            at = prose.rng.randint(0, len(words))
            words[at:at] = prose.rng.choice(passages).split()
        if prose.rng.random() < 0.1:
            words = ["spam"] * prose.rng.randint(1, 180)
        rows.append((100 + k, " ".join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (103, rows[3][1]), (504, " ".join([passages[4]] * 3))]
    return rows


@pytest.mark.parametrize("size", [3000, 1 << 18])
def test_spans_equal_brute_force(documents, prose, odd, monkeypatch, size):
    for name in ("CHUNK", "RANGE", "BUCKET"):
        monkeypatch.setattr(S, name, size)
    rows = planted(prose) + odd
    got = sorted(map(tuple, S.repeated_passages(documents(rows, clashing=True).repartition(3)).collect()))
    assert got == brute(rows) and len(got) > 80


def test_clean_and_empty_tables(documents, prose):
    clean = [(k, prose.text(200)) for k in range(20)]
    assert S.repeated_passages(documents(clean)).collect() == []
    assert S.repeated_passages(documents([])).collect() == []


def test_selection_is_the_same_in_equal_passages():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h = rng.integers(0, 50, 200).astype(np.uint64)
        k = int(rng.integers(0, 150))
        inside = {p + k for p in S.selected(h[k : k + S.WINDOW]).tolist()}
        assert inside and inside <= set(S.selected(h).tolist())


def test_merge_order_sorts_suffixes():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 300):
        codes = np.concatenate((rng.integers(1, 4, n), np.zeros(3, np.int64))).astype(np.int32)
        order = sorted(range(len(codes)), key=lambda k: codes[k:].tolist())
        rank = np.zeros(len(codes) + 2, np.uint64)
        rank[order] = np.arange(1, len(codes) + 1)
        at = np.arange(len(codes))
        a = np.where(at % 3 == 2, rank[at + 2], rank[at + 1])
        b = np.where(at % 3 == 0, rank[at + 2], rank[at])
        x = np.append(codes, 0)
        assert S.merge_order(np.stack((x[at], x[at + 1]), axis=1).astype(np.uint64), at.astype(np.int32), a, b).tolist() == order


def test_passages_that_differ_in_words_of_one_code_are_told_apart():
    n = 6
    u = lambda x, kind=np.uint64: [S._cell(np.array(x, kind))]
    t = pa.table(
        {
            "bucket": [0], "chunk": [5], "offs": u(range(1, 3 * n, 3), np.int32), "keys": [S._cell(np.ones((n, 2), np.int32))],
            "a": u(range(n)), "b": u(range(n)), "prints": u([7, 8, 7, 8, 7, 9]), "ids": u(range(n), np.int64), "coarse": u([3] * n, np.uint16),
        }
    )
    out = S._merge(0)((pa.scalar(0),), t).to_pylist()
    got = dict(zip(S._values(out[0]["offs"], np.int32).tolist(), S._values(out[0]["ranks"], np.uint64).tolist()))
    assert got == {1: 1, 7: 0, 13: 0, 4: 1, 10: 0}  # 1 marks the first of its passage


def test_cells_round_trip():
    rng = np.random.default_rng(1)
    for kind, width in ((np.int32, 1), (np.uint64, 1), (np.uint16, 1), (np.int64, 1), (np.int32, 2), (np.uint64, 3)):
        for n in (0, 1, 5, 300):
            x = rng.integers(0, 60_000, (n, width)).astype(kind) if width > 1 else rng.integers(0, 60_000, n).astype(kind)
            assert (S._values(S._cell(x), kind, width) == x).all() and S._values(S._cell(x), kind, width).shape == x.shape
            both, sizes = S._read(pa.array([S._cell(x), S._cell(x[:1])], pa.binary()), kind, width)
            assert (both == np.concatenate((x, x[:1]))).all() and sizes.tolist() == [n, min(n, 1)]


def test_sequence_hash_doesn_t_depend_on_the_place():
    (w,) = V.slices(pa.array(["x a b c y a b c"]), V.ALNUM)
    sums = V.prefix_sums(w)
    h = V.sequence_hash(sums, np.array([1, 5, 0]), np.array([4, 8, 3]))
    assert h[0] == h[1] != h[2]
