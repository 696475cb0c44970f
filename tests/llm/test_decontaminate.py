import pytest
from helpers import alnum

from phrasewell.llm import decontaminate as D

ITEM = "item_id bigint, text string"


def brute(docs, items):
    """{(doc_id, item_id): score}: every alignment of each item along each text that a seed hits."""
    out = {}
    for d, text in docs:
        words = alnum(text or "")
        for i, body in items:
            item = alnum(body or "")
            if len(item) < D.SPAN:
                if len(item) >= D.SHORTEST and any(words[k : k + len(item)] == item for k in range(len(words))):
                    out[d, i] = len(item)
                continue
            for shift in range(1 - len(item), len(words)):
                pairs = [(item[k], words[k + shift]) for k in range(max(0, -shift), min(len(item), len(words) - shift))]
                same = [a == b for a, b in pairs]
                if sum(same) < min(m.count("1") for m in D.MASKS) or not any(all(same[k + j] for j, m in enumerate(mask) if m == "1") for mask in D.MASKS for k in range(len(same) - len(mask) + 1)):
                    continue
                best = run = 0
                for s in same:
                    run = max(0, run + (1 if s else D.MISMATCH))
                    best = max(best, run)
                if best >= min(D.MIN_SCORE, -int(-D.MIN_SHARE * len(item) // 1)):
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


@pytest.fixture
def tables(prose):
    items = [(k, prose.text(prose.rng.randint(12, 45))) for k in range(12)]
    docs = []
    for k in range(60):
        text = prose.text(prose.rng.randint(0, 80))
        if k % 3 == 0:
            text += " " + prose.edited(prose.rng.choice(items)[1], prose.rng.choice([0, 0.05, 0.1])).upper() + ", " + prose.text(9)
        docs.append((100 + k, text))
    short = [prose.text(n) for n in (4, 7, 11)]
    docs += [(200 + k, f"{prose.text(20)} {s.upper()}; {prose.text(5)}") for k, s in enumerate(short)] + [(210, short[1] + " " + short[1]), (211, short[1][:-1])]
    items += [(80 + k, s) for k, s in enumerate(short)] + [(80, short[0])]
    return docs, [*items, (90, "too short"), (91, None), (None, items[0][1]), (92, "")]


def test_overlaps_equal_brute_force(documents, odd, tables):
    docs, items = [*tables[0], *odd], tables[1]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminations(documents(docs, clashing=True), documents(items, ITEM, True)).collect()}
    assert got == brute(docs, items) and len(got) > 15 and {(200, 80), (201, 81), (202, 82), (210, 81)} <= set(got)


def test_places(documents, prose):
    item, before = prose.text(20), prose.text(30)
    rows = D.contaminations(documents([(1, f"{before} {item} end"), (1, f"{before} {item} end")]), documents([(7, item)], ITEM)).collect()
    assert [tuple(r) for r in rows] == [(1, 7, 30, 20, 20)] * 2


def test_substitutions_are_tolerated(documents, prose):
    words = prose.text(40).split()
    for k in range(7, 40, 8):
        words[k] = "other"
    found = D.contaminations(documents([(1, " ".join(words))]), documents([(1, prose.text(5)), (2, " ".join(words).replace("other", "own"))], ITEM)).collect()
    assert [r["item_id"] for r in found] == [2]


def test_filter_keeps_clean_rows(full, odd, tables):
    docs = full([*tables[0], *odd], clashing=True)
    items = tables[1]
    out = D.decontaminate(docs, docs.sparkSession.createDataFrame(items, ITEM))
    gone = {d for d, _ in brute(tables[0], items)}
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(d) for d, _ in [*tables[0], *odd] if d not in gone)


def test_empty_tables_and_several_passes(documents, full, tables, monkeypatch):
    assert D.contaminations(documents([]), documents(tables[1], ITEM)).collect() == []
    assert D.contaminations(documents(tables[0]), documents([], ITEM)).collect() == []
    assert D.decontaminate(full(tables[0]), documents([], ITEM)).count() == len(tables[0])
    once = sorted(map(str, D.contaminations(documents(tables[0]), documents(tables[1], ITEM)).collect()))
    monkeypatch.setattr(D, "SEEDS_AT_ONCE", 100)
    assert sorted(map(str, D.contaminations(documents(tables[0]), documents(tables[1], ITEM)).collect())) == once
