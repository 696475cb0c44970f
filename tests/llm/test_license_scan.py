import numpy as np
import pyarrow as pa
from helpers import alnum

from phrasewell.llm import license_scan as L
from phrasewell.llm.license_templates import TEMPLATES


def brute(text):
    """{(template, matched, first, end)}: the best alignment of each template, all diagonals searched, then again before and after it."""
    ix, words = L.index(), alnum(text)
    codes, out = {w: k for k, w in enumerate(words)}, set()
    mine = np.array([codes[w] for w in words], np.int64)
    for t, (_, body) in enumerate(TEMPLATES):
        theirs = np.array([codes.get(w, -1) for w in alnum(body)], np.int64)
        work = [(0, len(mine))]
        while work:
            a, b = work.pop()
            # A stretch without any of the template's words can't be part of an alignment.
            if np.isin(mine[a:b], theirs).sum() < L.MIN_COVERAGE * len(theirs):
                continue
            _, matched, start, end = L.align(theirs, mine[a:b])
            if matched >= L.MIN_COVERAGE * len(theirs):
                out.add((t, matched, a + start, a + end))
                work += [(a, a + start), (a + end, b)]
    return {x for x in out if not any(L.within(x, y, ix) for y in out)}


def texts(prose):
    out = []
    for k, (_, body) in enumerate(TEMPLATES):
        words = body.split()
        if len(words) > 20:
            words[10] = "replaced"
            del words[15]
            words.insert(5, "added")
        out.append((400 + k, f"{prose.text(30)} {' '.join(words)} {prose.text(20)}"))
        out.append((500 + k, prose.text(40) + " " + body.upper().replace(" ", "\n  ")))
    return out


def test_matches_equal_full_alignment(documents, prose, odd):
    rows = texts(prose) + odd + [(300 + k, prose.text(200)) for k in range(20)]
    got = L.license_spans(documents(rows, clashing=True)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["template"], r["matched_words"], r["first_word"], r["end_word"]))
        assert r["coverage"] == round(r["matched_words"] / r["template_words"], 6) and r["license"] == TEMPLATES[r["template"]][0]
    want = {i: brute(t) for i, t in rows if i is not None and t}
    assert by == {i: x for i, x in want.items() if x} and len(by) == 2 * len(TEMPLATES)
    assert all(any(t == i % 100 for t, *_ in by[i]) for i in by)


def test_every_notice_of_a_long_text_is_found(documents, prose):
    body = TEMPLATES[0][1]
    text = " ".join(f"{prose.text(5000)} {body}" for _ in range(4))
    got = L.license_spans(documents([(1, text), (1, text), (None, body)])).where("template = 0")
    assert got.groupBy("doc_id").count().orderBy("doc_id").collect() == [(None, 1), (1, 8)]


def test_notices_one_after_another(documents):
    a, b, c = "All rights reserved. ", "Copyright X. All rights reserved. ", "Released under the MIT License.\n"
    rows = [(1, a * 3), (2, a + b), (3, c * 2), (4, a * 5000), (5, f"{c}Licensed under CC BY 4.0. {c}"), (6, "All rights All rights reserved. rights reserved.")]
    got = L.license_spans(documents(rows)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 3, 2: 2, 3: 2, 4: 5000, 5: 3, 6: len(brute(rows[5][1]))}
    for _, text in rows[:3] + rows[4:]:
        found = {tuple(x[1:]) for x in L.scan(pa.array([text]), L.index())}
        assert found == brute(text)


def test_empty(documents):
    assert L.license_spans(documents([])).collect() == []


def test_alignment_and_winnowing():
    a = np.array([1, 2, 3, 4, 5])
    assert L.align(a, np.array([9, 1, 2, 7, 3, 4, 5]))[1:] == (5, 1, 7)
    assert L.align(a, np.array([1, 2, 4, 5]))[1:] == (4, 0, 4)
    assert L.align(a, np.array([7, 8]))[0] == 0
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1000, 300).astype(np.uint64)
    at = L.winnow(h, 4)
    assert all(((at >= k) & (at < k + 4)).any() for k in range(297))
    assert L.winnow(h[:0], 4).tolist() == [] and len(L.winnow(h[:3], 4)) == 1
    assert len(L.index().names) == len(TEMPLATES) and pa.array(L.index().hash).null_count == 0
