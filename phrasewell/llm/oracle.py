"""SQL (DuckDB's) for the operators that SQL can express, written independently of their code.

Words come from regular expressions over whole texts; hashes, sums, alignments
and rules are joins, windows and arithmetic over them.
"""

from __future__ import annotations

from . import decontaminate, quality, suffix_dedup, textvec, url_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\t\n\x0B\x0C\r ]+"
_ALNUM = r"[^\x00-/:-`{-\x7F]+"
_MODULUS = 1 << 64


def _split(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{pattern}')"


def quality_rules() -> str:
    q = quality
    fold = f"CAST(floor((((coalesce(doc_id, 0) % 1000003) + 1000003) % 1000003) * 2654435761 / 65536) AS BIGINT) % {q.FOLDS}"
    return f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, text, {fold} AS f FROM documents WHERE text IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality = 1 AND toxic = 0),
junk AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality = 0 AND doc_id NOT IN (FROM good)),
rude AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality = 1 AND toxic = 1 AND doc_id NOT IN (FROM good)),
split AS (SELECT r, {_split("text", _SPACED)} AS w FROM docs),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM split),
vocab AS (SELECT DISTINCT w, hex(w) AS x FROM words),
powers(k, p) AS (SELECT 1, 1::UHUGEINT UNION ALL
  SELECT k + 1, (p * {textvec.BASE}::UHUGEINT) % {_MODULUS}::UHUGEINT FROM powers WHERE k < (SELECT max(strlen(w)) FROM vocab)),
bytes AS (SELECT w, unnest(generate_series(1, strlen(w))) AS k, x FROM vocab),
hashes AS (SELECT w, CAST(sum((1 + 16 * (instr('0123456789ABCDEF', substr(x, 2 * bytes.k - 1, 1)) - 1)
  + instr('0123456789ABCDEF', substr(x, 2 * bytes.k, 1)) - 1)::HUGEINT * p::HUGEINT) % {_MODULUS}::HUGEINT AS UHUGEINT) AS h
  FROM bytes JOIN powers ON bytes.k = powers.k GROUP BY w),
hashed AS (SELECT r, k, h, lead(h) OVER (PARTITION BY r ORDER BY k) AS h2 FROM words JOIN hashes ON words.w = hashes.w),
grams AS (SELECT r, CAST(h // {1 << (64 - q.BUCKET_BITS)}::UHUGEINT AS INT) AS b FROM hashed UNION ALL
  SELECT r, CAST(((h * {q.PAIR}::UHUGEINT + h2) % {_MODULUS}::UHUGEINT) // {1 << (64 - q.BUCKET_BITS)}::UHUGEINT AS INT) FROM hashed WHERE h2 IS NOT NULL),
raw AS (SELECT b, count(*) AS n FROM grams GROUP BY b),
target AS (SELECT b, f, count(*) AS n FROM grams JOIN docs USING (r) WHERE doc_id IN (FROM good) GROUP BY ALL),
folds AS (SELECT unnest(range({q.FOLDS})) AS f),
others AS (SELECT folds.f, b, sum(n) AS n FROM folds JOIN target ON folds.f <> target.f GROUP BY ALL),
sizes AS (SELECT folds.f, coalesce(sum(n), 0) + {q.BUCKETS * q.SMOOTHING} AS m FROM folds LEFT JOIN others ON folds.f = others.f GROUP BY ALL),
whole AS (SELECT sum(n) + {q.BUCKETS * q.SMOOTHING} AS n, (SELECT count(*) FROM target) AS told FROM raw),
ratio AS (SELECT sizes.f, raw.b, CASE WHEN told = 0 THEN 0 ELSE CAST(round(ln(((coalesce(others.n, 0) + {q.SMOOTHING}.0::DOUBLE) / m)
  / ((raw.n + {q.SMOOTHING}.0::DOUBLE) / whole.n)) * {q.SCALE}) AS BIGINT) END AS v
  FROM sizes CROSS JOIN raw CROSS JOIN whole LEFT JOIN others ON others.f = sizes.f AND others.b = raw.b),
scores AS (SELECT r, count(*) AS n, sum(v)::DOUBLE / count(*) / {q.SCALE} AS s FROM grams JOIN docs USING (r) JOIN ratio ON ratio.b = grams.b AND ratio.f = docs.f GROUP BY r),
steps AS (SELECT CAST(floor(s * {q.STEPS}) AS INT) AS k, doc_id IN (FROM good) AS clean FROM scores JOIN docs USING (r) WHERE doc_id IN (FROM good) OR doc_id IN (FROM junk)),
tries AS (SELECT unnest(generate_series((SELECT min(k) FROM steps), (SELECT max(k) + 1 FROM steps))) AS t),
kinds AS (SELECT count(*) FILTER (clean) AS c, count(*) FILTER (NOT clean) AS j FROM steps),
told AS (SELECT t, count(*) FILTER (clean AND k < t) AS lost, count(*) FILTER (NOT clean AND k < t) AS dropped FROM tries, steps GROUP BY t),
gains AS (SELECT t, c * dropped - {q.COST} * j * lost AS gain, j FROM told, kinds WHERE lost <= {1 - q.KEEP:.6f} * c + 1e-9),
best AS (SELECT t, row_number() OVER (ORDER BY t) AS nth, count(*) OVER () AS n FROM gains WHERE j > 0 AND gain = (SELECT max(gain) FROM gains)),
least AS (SELECT CASE WHEN c = 0 THEN 0 WHEN j = 0 THEN (SELECT max(t) FROM gains)
  ELSE (SELECT t FROM best WHERE nth = (n - 1) // 2 + 1) END / {q.STEPS}::DOUBLE AS t FROM kinds),
parts AS (SELECT r, doc_id, unnest(list_distinct({_split("text", _ALNUM)})) AS w FROM docs),
among AS (SELECT count(*) FILTER (doc_id IN (FROM rude)) AS bad, count(*) FILTER (doc_id IN (FROM good)) AS fine FROM docs),
held AS (SELECT w, count(*) FILTER (doc_id IN (FROM rude)) AS bad, count(*) FILTER (doc_id IN (FROM good)) AS fine FROM parts GROUP BY w),
toxic AS (SELECT w FROM held, among WHERE among.bad >= {q.TOXIC_LEAST} AND among.fine > 0 AND held.bad >= greatest({q.TOXIC_LEAST}, {q.TOXIC_SHARE} * among.bad)
  AND held.bad::DOUBLE / among.bad >= {q.TOXIC_RATIO} * (held.fine + 1) / among.fine::DOUBLE)
SELECT doc_id, n AS n_grams, round(s, 6) AS score FROM scores JOIN docs USING (r)
WHERE s >= (SELECT t FROM least) AND r NOT IN (SELECT r FROM parts JOIN toxic USING (w))"""


def url_rules_sql() -> str:
    u = url_rules
    tokens = f"""list_sort(list_distinct(list_filter(regexp_split_to_array(translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}'), '[/.?&=#:_\\s]+'),
  lambda x: NOT regexp_matches(x, '^[0-9]*$'))))"""
    z = u.CERTAIN
    return f"""WITH RECURSIVE shown AS (SELECT row_number() OVER () AS r, page_id, url, {tokens} AS tokens,
  TRY_CAST(regexp_extract(url, '^[a-z]+://[^/?#]+/(?:[^?#]*/)?([0-9]{{1,18}})(?:\\.[a-z]+)?/?(?:[?#]|$)', 1) AS BIGINT) AS id FROM pages),
marked AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
known AS (SELECT r, tokens, bad FROM shown JOIN marked ON id = doc_id),
whole AS (SELECT count(*) AS n, sum(bad) AS b FROM known),
places AS (SELECT unnest(range(1, (SELECT max(len(tokens)) + 1 FROM known))) AS i),
sets(r, bad, tokens, items, k) AS (SELECT r, bad, tokens, []::VARCHAR[], 0 FROM known UNION ALL
  SELECT r, bad, tokens, list_append(items, tokens[i]), i FROM sets JOIN places ON i > k AND i <= len(tokens)),
counted AS (SELECT items, count(*) AS n, sum(bad) AS n_bad, sum(bad)::DOUBLE / count(*) AS c FROM sets WHERE k > 0 GROUP BY items),
found AS (SELECT items, c, n_bad FROM counted, whole WHERE n_bad >= {u.MIN_COUNT} AND n_bad >= {u.MIN_SUPPORT} * whole.n AND c >= {u.MIN_CONFIDENCE}
  AND c >= {u.MIN_LIFT} * b / whole.n
  AND (c + {z * z / 2} / counted.n - {z} * sqrt(c * (1 - c) / counted.n + {z * z / 4} / (counted.n * counted.n))) / (1 + {z * z} / counted.n) > b::DOUBLE / whole.n),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE len(g.items) < len(f.items) AND list_has_all(f.items, g.items) AND g.c >= f.c)),
hits AS (SELECT r, array_to_string(items, ' ') AS rule, c, n_bad FROM shown JOIN kept ON list_has_all(tokens, items) WHERE page_id IS NOT NULL AND url IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c DESC, n_bad DESC, rule) AS nth, count(*) OVER (PARTITION BY r) AS n_rules FROM hits)
SELECT page_id, url, best.r IS NOT NULL AS blocked, rule, round(c, 6) AS confidence, CAST(n_bad AS BIGINT) AS n_bad, coalesce(n_rules, 0) AS n_rules
FROM shown LEFT JOIN best ON shown.r = best.r AND nth = 1"""


def decontamination() -> str:
    d = decontaminate

    def seeds(table: str, where: str = "TRUE") -> str:
        parts = []
        for m, mask in enumerate(d.MASKS):
            key = ", ".join(f"w[k + {j + 1}]" for j, c in enumerate(mask) if c == "1")
            parts.append(f"SELECT r, k, {m} AS m, concat_ws(' ', {key}) AS key FROM (SELECT r, w, unnest(range(len(w) - {len(mask) - 1})) AS k FROM {table} WHERE {where})")
        return " UNION ALL ".join(parts)

    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_split("text", _ALNUM)} AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT row_number() OVER () AS r, item_id, {_split("text", _ALNUM)} AS w FROM benchmark WHERE text IS NOT NULL),
seeds AS ({seeds("items", f"len(w) >= {d.SPAN}")}),
placed AS ({seeds("docs")}),
met AS (SELECT DISTINCT p.r, s.r AS i, p.k - s.k AS shift FROM placed p JOIN seeds s ON p.m = s.m AND p.key = s.key),
lines AS (SELECT met.*, docs.w AS dw, items.w AS iw, greatest(0, -shift) AS a, least(len(items.w), len(docs.w) - shift) AS b
  FROM met JOIN docs ON docs.r = met.r JOIN items ON items.r = met.i),
steps AS (SELECT r, i, shift, a, len(iw) AS n, e, CASE WHEN e = 0 THEN 0 WHEN iw[a + e] = dw[a + e + shift] THEN 1 ELSE {d.MISMATCH} END AS v
  FROM (SELECT *, unnest(range(b - a + 1)) AS e FROM lines)),
sums AS (SELECT *, sum(v) OVER (PARTITION BY r, i, shift ORDER BY e) AS u FROM steps),
lows AS (SELECT *, min(u) OVER (PARTITION BY r, i, shift ORDER BY e) AS low,
  min(u) OVER (PARTITION BY r, i, shift ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower FROM sums),
ends AS (SELECT *, max(CASE WHEN lower IS NULL OR u < lower THEN e END) OVER (PARTITION BY r, i, shift ORDER BY e) AS s FROM lows),
long AS (SELECT r, i, n, a + shift + s AS first_word, e - s AS n_words, u - low AS score FROM ends WHERE u - low >= least({d.MIN_SCORE}, ceil({d.MIN_SHARE}::DOUBLE * n))),
few AS (SELECT r AS i, len(w) AS n, array_to_string(w, ' ') AS key FROM items WHERE len(w) BETWEEN {d.SHORTEST} AND {d.SPAN - 1}),
sizes AS (SELECT DISTINCT n FROM few),
short AS (SELECT p.r, few.i, few.n, p.k AS first_word, few.n AS n_words, few.n AS score FROM
  (SELECT r, n, k, array_to_string(w[k + 1 : k + n], ' ') AS key FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS k FROM docs, sizes)) p JOIN few ON p.n = few.n AND p.key = few.key),
best AS (SELECT *, row_number() OVER (PARTITION BY r, i ORDER BY score DESC, first_word, n_words) AS nth FROM (FROM long UNION ALL FROM short))
SELECT doc_id, item_id, CAST(first_word AS BIGINT) AS first_word, CAST(n_words AS BIGINT) AS n_words, CAST(score AS BIGINT) AS score
FROM best JOIN docs ON docs.r = best.r JOIN items ON items.r = best.i WHERE nth = 1"""


def repeated_passages() -> str:
    n = suffix_dedup.MIN_WORDS
    return f"""WITH texts AS (SELECT DISTINCT CAST(doc_id AS BIGINT) AS id, {_split("text", _ALNUM)} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT id, w, len(w) AS size, min(id) OVER (PARTITION BY w) AS least, count(*) OVER (PARTITION BY w) AS copies FROM texts WHERE len(w) >= {n}),
uniq AS (SELECT row_number() OVER (ORDER BY id, w) AS r, id, w, size FROM docs WHERE id = least),
passages AS (SELECT r, k, hash(array_to_string(w[k + 1 : k + {n}], ' ')) AS a, md5(array_to_string(w[k + 1 : k + {n}], ' ')) AS b
  FROM (SELECT r, w, unnest(range(size - {n - 1})) AS k FROM uniq)),
again AS (SELECT r, k, count(*) OVER (PARTITION BY a, b) AS n, row_number() OVER (PARTITION BY a, b ORDER BY r, k) > 1 AS later FROM passages),
covered AS (SELECT r, k + j AS k, bool_or(later) AS later FROM (SELECT r, k, later, unnest(range({n})) AS j FROM again WHERE n > 1) GROUP BY ALL),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM covered),
spans AS (SELECT r, min(k) AS first_word, count(*) AS n_words, count(*) FILTER (later) AS removable_words FROM runs GROUP BY r, run),
own AS (SELECT r, sum(removable_words) AS removable FROM spans GROUP BY r)
SELECT id AS doc_id, first_word, n_words, removable_words FROM spans JOIN uniq USING (r) JOIN docs USING (id, w) WHERE copies = 1
UNION ALL SELECT docs.id, 0, docs.size, CAST(CASE WHEN docs.id = least THEN coalesce(removable, 0) ELSE docs.size END AS BIGINT)
FROM docs LEFT JOIN uniq ON uniq.id = docs.id AND uniq.w = docs.w LEFT JOIN own USING (r) WHERE copies > 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules(),
        "op4_suffix_array_dedup": repeated_passages(),
        "op5_url_rules": url_rules_sql(),
        "op9_decontamination": decontamination(),
    }
