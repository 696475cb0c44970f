from itertools import combinations

import pytest

from phrasewell.llm import url_rules as U

PAGE = "page_id bigint, url string, html string"
LABEL = "doc_id bigint, quality int, toxic int"


def tokens(url):
    import re

    parts = re.split(r"[/.?&=#:_\s]+", url.lower())
    return sorted({p for p in parts if p and not p.isdigit()})


def brute(pages, labels):
    bad = {}
    for d, q, t in labels:
        if d is not None:
            bad[d] = bad.get(d, 0) or int(q == 0 or t == 1)
    import re

    rows = []
    for _, url, _ in pages:
        m = re.match(r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)", url or "")
        if m and int(m[1]) in bad:
            rows.append((frozenset(tokens(url)), bad[int(m[1])]))
    n, n_bad = len(rows), sum(b for _, b in rows)
    every = {c for items, b in rows if b for k in range(1, len(items) + 1) for c in combinations(sorted(items), k)}
    found = {}
    for c in every:
        hit = [b for items, b in rows if items >= set(c)]
        share, z = sum(hit) / len(hit), U.CERTAIN
        low = (share + z * z / (2 * len(hit)) - z * (share * (1 - share) / len(hit) + z * z / (4 * len(hit) ** 2)) ** 0.5) / (1 + z * z / len(hit))
        if low > n_bad / n and sum(hit) >= max(U.MIN_COUNT, U.MIN_SUPPORT * n) and sum(hit) / len(hit) >= max(U.MIN_CONFIDENCE, U.MIN_LIFT * n_bad / n):
            found[c] = (sum(hit) / len(hit), sum(hit))
    kept = {c: v for c, v in found.items() if not any(set(g) < set(c) and w[0] >= v[0] for g, w in found.items())}
    out = []
    for id, url, _ in pages:
        match = sorted((-v[0], -v[1], " ".join(c)) for c, v in kept.items() if id is not None and set(c) <= set(tokens(url or "")))
        best = match[0] if match else (None, None, None)
        out.append((id, url, bool(match), best[2], None if not match else round(-best[0], 6), None if not match else -best[1], len(match)))
    return sorted(out, key=str)


@pytest.fixture
def tables(prose):
    pages, labels = [], []
    for k in range(150):
        host = prose.rng.choice(["casino.example.com", "shop.example.org", "news.example.net", "m.example.com"])
        path = prose.rng.choice(["en", "de", "win", "win/free"])
        pages.append((1000 + k, f"http://{host}/{path}/{k}" + prose.rng.choice(["", ".html", "/", "?ref=x", "#top"]), ""))
        wrong = "casino" in host and "win" in path or prose.rng.random() < 0.1
        labels.append((k, 0 if wrong else 1, 0))
    pages += [(None, "http://casino.example.com/win/1", ""), (5, None, None), (6, "", ""), (8, "http://casino.example.com/win/" + "x" * 100_000 + "/y" * 50_000, ""), (7, "not a url", ""), pages[0], pages[0]]
    labels += [(None, 0, 0), (3, None, None), (5, 1, 1), (5, 1, 0)]
    return pages, labels


def test_verdicts_equal_brute_force(spark, documents, tables):
    pages, labels = tables
    df = documents(pages, PAGE, True)
    got = sorted(map(tuple, U.url_filter(df, spark.createDataFrame(labels, LABEL)).collect()), key=str)
    assert got == brute(pages, labels) and sum(r[2] for r in got) > 10


def test_planted_rules_at_scale(spark):
    """Among 40,000 pages of 100 hosts the planted combinations are found; of other pages, whose single tokens are a little suspicious, few are blocked."""
    from pyspark.sql import functions as F

    n = 40_000
    pages = spark.range(n).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("http://h"), F.abs(F.xxhash64("id")) % 100, F.lit(".example.com/"), F.element_at(F.array(*map(F.lit, ["en", *["win"] * 4, *["free"] * 4, "win/free"])), (F.abs(F.xxhash64("id", F.lit(1))) % 10 + 1).cast("int")), F.lit("/"), F.col("id")).alias("url"),
    )
    planted = F.col("url").rlike("/win/free/") | F.col("url").rlike("//h(7|70)[.]")
    wrong = (F.abs(F.xxhash64("id", F.lit(2))) % 100) < F.when(planted, 80).otherwise(20)
    labels = pages.select(F.col("page_id").alias("id"), "url").select(F.col("id").alias("doc_id"), F.when(wrong, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    got = U.url_filter(pages, labels).select(planted.alias("planted"), "blocked", "rule").groupBy("planted", "blocked").count().collect()
    count = {(r["planted"], r["blocked"]): r["count"] for r in got}
    assert count[True, True] > 3_500 and not count.get((True, False)) and count.get((False, True), 0) <= 0.01 * n


def test_ties_are_decided(spark, documents):
    """Two rules of equal confidence and count: the first by its tokens is reported."""
    pages = [(k, f"http://b.a/{'q/z' if k < 20 else 'x'}/{k}", "") for k in range(60)]
    labels = [(k, 0 if k < 20 else 1, 0) for k in range(60)]
    got = U.url_filter(documents(pages, PAGE), spark.createDataFrame(labels, LABEL)).where("blocked").collect()
    assert {(r["rule"], r["n_rules"], r["confidence"]) for r in got} == {("q", 2, 1.0)} and len(got) == 20


def test_without_labels_or_pages(spark, documents, tables):
    none = spark.createDataFrame([], LABEL)
    got = U.url_filter(documents(tables[0], PAGE), none).collect()
    assert len(got) == len(tables[0]) and not any(r["blocked"] for r in got)
    assert U.url_filter(documents([], PAGE), none).collect() == []


def test_document_of(spark):
    urls = ["http://a.b/en/12", "https://a.b/en/12/", "http://a.b/12.html?x=3", "http://a.b/x?id=12", "http://a.b/en/12a", "http://12/", None, ""]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.document_of(F.col("u"))).collect()]
    assert got == [12, 12, 12, None, None, None, None, None]
