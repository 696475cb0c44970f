import numpy as np
import pyarrow as pa
import pytest

from phrasewell.llm import simhash_dedup as S


def brute(rows):
    """Root of each document in a group, all pairs compared."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    sig, size = S.signatures(pa.array([t for _, t in rows], pa.string()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if size[a] and size[b] and S.differing(sig[a], sig[b]) <= S.MAX_BITS:
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return {i: find(i) for i in root if find(i) != i}


def test_groups_equal_all_pairs(documents, prose, odd):
    rows = list(odd)
    for k in range(60):
        text = prose.text(prose.rng.randint(40, 300))
        rows += [(1000 + 10 * k + j, prose.edited(text, 0.02 * j)) for j in range(prose.rng.randint(1, 5))]
    rows += [(5000 + k, prose.edited(rows[30][1], 0.01)) for k in range(40)]
    want = brute(rows)
    got = dict(map(tuple, S.near_duplicates(documents(rows, clashing=True)).collect()))
    assert len(want) > 100
    assert all(want[k] == v or v in want for k, v in got.items()) and set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)


def test_guaranteed_distance_always_meets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 2**63, 2).astype(np.uint64)
        b = a.copy()
        for bit in rng.choice(126, 13, replace=False):
            b[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        v = S.variants(np.stack([a, b]))
        assert (v[0] == v[1]).any()


def test_recall_over_distances():
    rng = np.random.default_rng(4)
    for d, least in ((14, 0.95), (16, 0.9), (18, 0.8)):
        met = 0
        for _ in range(300):
            a = rng.integers(0, 2**63, 2).astype(np.uint64)
            b = a.copy()
            for bit in rng.choice(128, d, replace=False):
                b[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            v = S.variants(np.stack([a, b]))
            met += (v[0] == v[1]).any()
        assert met >= least * 300


def test_one_of_each_group_stays(full, prose, odd):
    text = prose.text(100)
    docs = full([*odd, (9, text), (8, text), (10, prose.edited(text, 0.02)), (11, prose.text(100))], clashing=True)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # 6 and 7 have the same text; repeated rows of 5 and 6 leave one each; null ids and wordless texts stay.
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 8, 11]


def test_empty(full):
    assert S.drop_near_duplicates(full([])).collect() == [] and S.near_duplicates(full([])).collect() == []


def test_large_bucket_is_searched_whole():
    base = np.array([5, 9], np.uint64)
    sig = np.tile(base, (3000, 1))
    sig[:, 1] ^= np.arange(3000, dtype=np.uint64)
    pairs = S.bucket_edges(np.zeros(3000, np.int64), np.arange(3000), sig)
    reached = {0}
    for _ in range(3):
        reached |= {b for a, b in pairs.tolist() if a in reached} | {a for a, b in pairs.tolist() if b in reached}
    assert len(reached) == 3000


@pytest.mark.parametrize("small", [2, 8, 64])
def test_bucket_edges_connect_the_same(small):
    rng = np.random.default_rng(5)
    sig = np.repeat(rng.integers(0, 2**63, (12, 2)).astype(np.uint64), 4, axis=0)
    pairs = S.bucket_edges(np.repeat([0, 1], 24), np.arange(48), sig, small=small)
    assert {a // 4 for a, b in pairs.tolist()} == set(range(12)) and all(a // 4 == b // 4 for a, b in pairs.tolist())


def test_every_pair_up_to_the_threshold_is_linked(documents, prose):
    rows = []
    for k in range(400):
        text = prose.text(60)
        rows += [(2 * k, text), (2 * k + 1, prose.edited(text, 0.12))]
    want = brute(rows)
    far = [S.differing(*S.signatures(pa.array([rows[i - 1][1], rows[i][1]]))[0]) for i in range(1, 800, 2)]
    assert sum(18 <= d <= S.MAX_BITS for d in far) > 50
    assert dict(map(tuple, S.near_duplicates(documents(rows)).collect())) == want


@pytest.mark.parametrize("most", [8, 22])
def test_bands_connect_what_all_pairs_connect(most, monkeypatch):
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 2**63, (150, 2)).astype(np.uint64)
    sig = np.concatenate((sig, sig, sig, sig[:20]))
    for k in range(150, len(sig)):
        for bit in rng.choice(128, int(rng.integers(most - 3, most + 4)), replace=False):
            sig[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    for split in (len(sig), 200, len(sig) - 3):
        label = np.arange(len(sig))
        for a in range(split):
            b = np.flatnonzero(S.differing(sig, sig[a]) <= most)
            b = b if split == len(sig) else b[b >= split]
            S.join_labels(label, np.full(len(b), a), b)
        assert split < len(sig) or 150 < len(set(label.tolist())) < len(sig) - 40
        for searched in (1 << 20, 0):
            monkeypatch.setattr(S, "PAIRS_SEARCHED", searched)
            got = S.band_links(sig, split, most)
            if searched or split == len(sig):
                assert got.tolist() == label.tolist()
            else:  # a search links pairs of the same band as well
                assert all(got[k] == got[x] for k, x in enumerate(label.tolist()))


def test_bands_and_links_across_them(documents, prose, monkeypatch):
    monkeypatch.setattr(S, "FEW_ROWS", 20)
    text = prose.text(80)
    rows = [(k, prose.edited(text, 0.06 * (k % 3))) for k in range(60)] + [(100 + k, prose.text(50)) for k in range(80)]
    assert dict(map(tuple, S.near_duplicates(documents(rows).repartition(3)).collect())) == brute(rows)
