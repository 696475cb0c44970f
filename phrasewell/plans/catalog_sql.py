"""The registered queries in DuckDB's SQL, written independently of the engine.

Words come from the same pattern; postings are grouped occurrences; phrases are
chains of as-of joins; BM25 is arithmetic; the stemmer is a chain of CASEs.
DuckDB's levenshtein counts bytes, so each non-ASCII character is made one byte
first (query terms are ASCII, such a character equals none of theirs).
"""

from __future__ import annotations

from ..functions.analysis import LOWER, STOP_WORDS, UPPER
from . import catalog as q

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_LETTER = r"[\p{L}\p{N}]"
#: Words of alphabets whose letters join up, in rules of its own: no lookaround, no scripts.
_A, _N = r"\p{L}\p{M}*", r"\p{Nd}"
PLAIN_PATTERN = rf"(?:{_A}(?:['’.·:]{_A})+|{_N}(?:['’.,;]{_N})+|{_A}|{_N}|_)+"
_TOXIC = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"


def _words(table: str, id: str, stop: bool = True, where: str = "TRUE", id_sql: str | None = None) -> str:
    """CTEs docs (id) and occ (id, token, pos)."""
    pattern = PLAIN_PATTERN.replace("'", "''")
    keep = f" AND x NOT IN ({_STOP})" if stop else ""
    return f"""docs AS (SELECT {id_sql or id} AS {id}, text FROM {table} WHERE {where}),
words AS (SELECT {id}, list_filter(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}'),
  lambda x: regexp_matches(x, '{_LETTER}'){keep}) AS w FROM docs),
occ AS (SELECT {id}, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM words)"""


_OCC = _words("documents", "doc_id")


def _tables(where: str = "TRUE", stemming: bool = False) -> str:
    """CTEs posts (token, doc_id, tf), vocab (token, df), stats (doc_id, len, nd), corpus (n, avg)."""
    occ = _words("documents", "doc_id", where=where)
    if stemming:
        occ = occ.replace("occ AS (", "raw_occ AS (") + f""", {_stem_ctes("SELECT DISTINCT token AS word FROM raw_occ")},
occ AS (SELECT doc_id, stems.token, pos FROM raw_occ JOIN stems ON raw_occ.token = stems.word)"""
    return f"""{occ},
posts AS (SELECT token, doc_id, count(*) AS tf FROM occ GROUP BY ALL),
vocab AS (SELECT token, count(*) AS df FROM posts GROUP BY ALL),
stats AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len, count(token) AS nd FROM docs d LEFT JOIN posts p ON d.doc_id = p.doc_id GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len) AS avg FROM stats)"""


_WEIGHT = "ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * nd / avg)) * pow(0.8, dist)"


def _expanded(terms: list[tuple[str, int]]) -> str:
    """CTE exp (term, token, df, dist)."""
    rows = ", ".join(f"({k}, '{text}', {fuzz})" for k, (text, fuzz) in enumerate(terms))
    return f"""terms(term, text, fuzz) AS (VALUES {rows}),
exp AS (SELECT term, token, df, dist FROM (SELECT term, token, df, text, fuzz,
    CASE WHEN fuzz = 0 THEN CASE WHEN token = text THEN 0 ELSE 9 END
         ELSE levenshtein(regexp_replace(token, '[^\\x00-\\x7F]', chr(1), 'g'), text) END AS dist FROM vocab, terms)
  WHERE dist <= fuzz AND (token = text OR fuzz = 0 OR (strlen(token) > fuzz AND strlen(text) > fuzz)))"""


def _hits(terms: list[tuple[str, int]]) -> str:
    return f"""{_expanded(terms)},
weights AS (SELECT term, posts.token, posts.doc_id, {_WEIGHT} AS w FROM exp JOIN posts ON exp.token = posts.token JOIN stats ON posts.doc_id = stats.doc_id, corpus),
hits AS (SELECT weights.term, occ.doc_id, occ.pos, w FROM weights JOIN occ ON weights.token = occ.token AND weights.doc_id = occ.doc_id)"""


def _chain(n: int) -> str:
    """CTE chain (doc_id, first, last, w): the interval of each start."""
    parts = ["c0 AS (SELECT doc_id, pos AS first, pos AS last, w FROM hits WHERE term = 0)"]
    for k in range(1, n):
        parts.append(
            f"c{k} AS (SELECT c.doc_id, c.first, h.pos AS last, c.w + h.w AS w FROM c{k - 1} c "
            f"ASOF JOIN (SELECT doc_id, pos, w FROM hits WHERE term = {k}) h ON c.doc_id = h.doc_id AND c.last < h.pos)"
        )
    parts.append(f"chain AS (SELECT * FROM c{n - 1})")
    return ",\n".join(parts)


def _phrase(terms: list[tuple[str, int]], slop: int, top_k: int = 0, where: str = "TRUE", stemming: bool = False) -> str:
    n = len(terms)
    limit = f"ORDER BY s DESC, doc_id LIMIT {top_k}" if top_k else ""
    return f"""WITH {_tables(where, stemming)}, {_hits(terms)}, {_chain(n)},
best AS (SELECT doc_id, max(w / (last - first - {n - 1} + 1)) AS s FROM chain WHERE last - first - {n - 1} <= {slop} GROUP BY doc_id)
SELECT doc_id, round(s, 6) AS score FROM best WHERE s > 0 {limit}"""


def _stem_ctes(words: str) -> str:
    """CTE stems (word, token), from a query for distinct words."""
    vowel, other = "[aeiouy]", "[^aeiouy]"

    def case(x: str, rules: list[tuple[str, str]]) -> str:
        return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + f" ELSE {x} END"

    def ends(*suffixes: str) -> str:
        return "(" + " OR ".join(f"suffix(w, '{s.replace(chr(39), chr(39) * 2)}')" for s in suffixes) + ")"

    def cut(k: int, add: str = "") -> str:
        return f"left(w, length(w) - {k})" + (f" || '{add}'" if add else "")

    short = (
        "(CASE WHEN {0} = 'past' THEN TRUE WHEN length({0}) > 2 THEN regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouwxY]$') "
        "ELSE regexp_matches({0}, '^[aeiouy][^aeiouy]$') END)"
    )
    fixed = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    fixed |= {w: w for w in ("sky", "news", "howe")}
    special = ["gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ"]
    to2 = {
        "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
        "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "ogist": "og",
        "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
    }
    in1 = lambda s: f"length(w) - {len(s)} >= r1"
    step2 = [(ends(s), f"CASE WHEN {in1(s)} THEN {cut(len(s), t)} ELSE w END") for s, t in to2.items()]
    step2 += [
        (ends("ogi"), f"CASE WHEN {in1('ogi')} AND suffix(w, 'logi') THEN {cut(3, 'og')} ELSE w END"),
        (ends("li"), f"CASE WHEN {in1('li')} AND regexp_matches(w, '[cdeghkmnrt]li$') THEN {cut(2)} ELSE w END"),
    ]
    to3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
    step3 = [(ends(s), f"CASE WHEN {in1(s)} THEN {cut(len(s), t)} ELSE w END") for s, t in to3.items()]
    step3.insert(5, (ends("ative"), f"CASE WHEN length(w) - 5 >= greatest(r1, r2) THEN {cut(5)} ELSE w END"))
    step4 = []
    for s in "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split():
        also = " AND regexp_matches(w, '[st]ion$')" if s == "ion" else ""
        step4.append((ends(s), f"CASE WHEN length(w) - {len(s)} >= r2{also} THEN {cut(len(s))} ELSE w END"))
    double = "regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') AND NOT (length(b) = 3 AND regexp_matches(b, '^[aeo]'))"
    repaired = case(
        "b",
        [
            ("regexp_matches(b, '(at|bl|iz)$')", "b || 'e'"),
            (double, "left(b, length(b) - 1)"),
            (f"r1 >= length(b) AND {short.format('b')}", "b || 'e'"),
        ],
    )
    one_b = case(
        "w",
        [
            (ends("eedly"), f"CASE WHEN {in1('eedly')} AND NOT regexp_matches(w, '^(proc|exc|succ)') THEN {cut(5, 'ee')} ELSE w END"),
            (ends("eed"), f"CASE WHEN {in1('eed')} AND NOT regexp_matches(w, '^(proc|exc|succ)') THEN {cut(3, 'ee')} ELSE w END"),
            (f"suffix(w, 'ing') AND length(w) = 5 AND regexp_matches(w, '^{other}y')", "left(w, 1) || 'ie'"),
            ("w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'evening')", "w"),
            (f"b <> w AND regexp_matches(b, '{vowel}')", repaired),
        ],
    )
    steps = [
        ("w0", f"SELECT word, {case('w', [(ends(chr(39) + 's' + chr(39)), cut(3)), (ends(chr(39) + 's'), cut(2)), (ends(chr(39)), cut(1))])} AS w, r1, r2 FROM rr"),
        (
            "w1",
            "SELECT word, r1, r2, "
            + case(
                "w",
                [
                    (ends("sses"), cut(2)),
                    (ends("ied", "ies"), f"CASE WHEN length(w) > 4 THEN {cut(3, 'i')} ELSE {cut(3, 'ie')} END"),
                    (ends("us", "ss"), "w"),
                    (f"suffix(w, 's') AND length(w) > 2 AND regexp_matches(left(w, length(w) - 2), '{vowel}')", cut(1)),
                ],
            )
            + " AS w FROM w0",
        ),
        ("w1b", "SELECT *, regexp_replace(w, '(ingly|edly|ing|ed)$', '') AS b FROM w1"),
        ("w2", f"SELECT word, r1, r2, {one_b} AS w FROM w1b"),
        ("w3", f"SELECT word, r1, r2, {case('w', [(f'length(w) > 2 AND regexp_matches(w, {chr(39)}{other}[yY]${chr(39)})', cut(1, 'i'))])} AS w FROM w2"),
        ("w4", f"SELECT word, r1, r2, {case('w', step2)} AS w FROM w3"),
        ("w5", f"SELECT word, r1, r2, {case('w', step3)} AS w FROM w4"),
        ("w6", f"SELECT word, r1, r2, {case('w', step4)} AS w FROM w5"),
        (
            "w7",
            "SELECT word, "
            + case(
                "w",
                [
                    ("suffix(w, 'e')", f"CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {short.format('left(w, length(w) - 1)')}) THEN {cut(1)} ELSE w END"),
                    ("suffix(w, 'll') AND length(w) - 1 >= r2", cut(1)),
                ],
            )
            + " AS w FROM w6",
        ),
    ]
    prefixes = " ".join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in special)
    first = f"^{other}*{vowel}+{other}"
    table = ", ".join(f"('{a}', '{b}')" for a, b in fixed.items())
    untouched = "'sky', 'news', 'howe', 'atlas', 'cosmos', 'bias', 'andes'"
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in steps)
    return f"""all_words AS ({words}),
fixed(a, b) AS (VALUES {table}),
easy AS (SELECT word FROM all_words WHERE strlen(word) > 2 AND strlen(word) = length(word) AND word NOT IN ({untouched})),
bare AS (SELECT word, CASE WHEN starts_with(word, '''') THEN substr(word, 2) ELSE word END AS w FROM easy),
ys AS (SELECT word, replace(regexp_replace(replace(replace(regexp_replace(w, '^y', 'Y'), 'yy', 'y#'), '#y', '##'), '([aeiou])y', '\\1#', 'g'), '#', 'Y') AS w
  FROM bare WHERE w NOT IN (SELECT a FROM fixed)),
r AS (SELECT word, w, CASE {prefixes} WHEN regexp_matches(w, '{first}') THEN length(regexp_extract(w, '{first}')) ELSE length(w) END AS r1 FROM ys),
rr AS (SELECT word, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{first}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{first}'))
  ELSE length(w) END AS r2 FROM r),
{body},
stems AS (SELECT a.word, coalesce(replace(w7.w, 'Y', 'y'), fixed.b, a.word) AS token
  FROM all_words a LEFT JOIN w7 ON a.word = w7.word LEFT JOIN bare ON a.word = bare.word LEFT JOIN fixed ON bare.w = fixed.a)"""


def _postings(ctes: str) -> str:
    return f"""WITH {ctes} SELECT token, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM occ GROUP BY ALL"""


_SLOP = [("er", 0), ("ntre", 0), ("anon", 0)]
_FUZZY = [("er", 1), ("ntre", 1), ("onbleea", 2)]
_BATCH = f"""WITH RECURSIVE {_tables()},
bwords AS (SELECT item_id, list_filter(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PLAIN_PATTERN.replace("'", "''")}'),
  lambda x: regexp_matches(x, '{_LETTER}') AND x NOT IN ({_STOP})) AS w FROM benchmark),
sides AS (SELECT item_id, len(w) AS n_terms, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS term FROM bwords),
able AS (SELECT item_id, n_terms, doc_id FROM sides JOIN posts ON sides.token = posts.token GROUP BY ALL HAVING count(DISTINCT term) = n_terms),
h AS MATERIALIZED (SELECT able.item_id, able.n_terms, term, occ.doc_id, pos, {_WEIGHT.replace("dist", "0")} AS w FROM able JOIN sides ON able.item_id = sides.item_id
  JOIN occ ON sides.token = occ.token AND able.doc_id = occ.doc_id
  JOIN posts ON posts.token = occ.token AND posts.doc_id = occ.doc_id JOIN vocab ON vocab.token = occ.token JOIN stats ON stats.doc_id = occ.doc_id, corpus),
following AS MATERIALIZED (SELECT x.item_id, x.doc_id, x.term, x.pos, y.pos AS pos2, y.w AS w2 FROM h x ASOF JOIN (SELECT item_id, doc_id, term - 1 AS term, pos, w FROM h) y
  ON x.item_id = y.item_id AND x.doc_id = y.doc_id AND x.term = y.term AND x.pos < y.pos),
steps(item_id, n_terms, doc_id, term, first, last, w) AS (SELECT item_id, n_terms, doc_id, term, pos, pos, w FROM h WHERE term = 0 UNION ALL
  SELECT s.item_id, s.n_terms, s.doc_id, s.term + 1, s.first, f.pos2, s.w + f.w2 FROM steps s
  JOIN following f ON s.item_id = f.item_id AND s.doc_id = f.doc_id AND s.term = f.term AND s.last = f.pos),
chain AS (SELECT item_id, doc_id, last - first - n_terms + 1 AS gaps, w FROM steps WHERE term = n_terms - 1),
found AS (SELECT item_id, doc_id, round(max(w / (gaps + 1)), 6) AS score FROM chain WHERE gaps <= {q.BATCH_SLOP} GROUP BY ALL)"""
_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_BEST = f"WITH {_tables()}, {_hits(_FUZZY)}, best AS (SELECT term, doc_id, max(w) AS w FROM weights GROUP BY ALL)"


def oracle_sql() -> dict[str, str]:
    out = {
        "analyze_documents": f"WITH {_OCC} SELECT doc_id, pos, token FROM occ",
        "analyze_all_words": f"WITH {_words('documents', 'doc_id', stop=False)} SELECT doc_id, pos, token FROM occ",
        "analyze_conversations": f"WITH {_words('conversations', 'turn_id', id_sql='concat_ws(chr(58), conv_id, turn)')} SELECT turn_id, pos, token FROM occ",
        "stem_vocabulary": f"WITH {_OCC}, {_stem_ctes('SELECT DISTINCT token AS word FROM occ')} SELECT word, token FROM stems",
        "postings": _postings(_OCC),
        "stemmed_postings": _postings(_tables(stemming=True)),
        "document_statistics": f"WITH {_tables()} SELECT doc_id, len, nd AS n_distinct FROM stats",
        "vocabulary": f"WITH {_tables()} SELECT token, df, length(token) AS n_chars, strlen(token) AS n_bytes FROM vocab",
        "corpus_statistics": f"WITH {_tables()} SELECT n AS n_docs, round(avg, 6) AS avg_doc_len FROM corpus",
        "inverse_document_frequency": f"WITH {_tables()} SELECT token, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM vocab, corpus",
        "term_search": _phrase([(q.TERM, 0)], 0),
        "term_top_10": _phrase([(q.TERM, 0)], 0, 10),
        "exact_phrase": _phrase([("er", 0), ("ntre", 0)], 0),
        "bare_terms": _phrase([("attion", 0), ("thanedble", 0), ("anea", 0)], 0, 5),
        "repeated_term_phrase": _phrase([("de", 0), ("de", 0)], 3),
        "stop_words_leave_no_gap": _phrase([("er", 0), ("ntre", 0)], 0),
        "stop_words_only": "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE FALSE",
        "query_keeps_punctuation": _phrase([("attion,", 0), ("thanedble", 0)], 0),
        "fuzzy_expansion": f"WITH {_tables()}, {_expanded([q.FUZZY_WORD])} SELECT token, df, dist AS distance FROM exp",
        "short_token_guard": f"WITH {_tables()}, {_expanded([('er', 2)])} SELECT token, df, dist AS distance FROM exp",
        "fuzzy_phrase": _phrase(_FUZZY, 2),
        "fuzzy_top_5": _phrase(_FUZZY, 2, 5),
        "auto_fuzzy": _phrase([("attion", 2), ("thanedble", 2), ("anea", 1)], 0),
        "non_ascii_phrase": _phrase([("de", 0), ("la", 0)], 1),
        "title_phrase": _phrase([("attion,", 1), ("thanedble", 1)], 1),
        "phrase_candidates": f"WITH {_tables()}, {_hits(_SLOP)} SELECT doc_id, "
        + ", ".join(f"count(*) FILTER (term = {k}) AS n_{k}" for k in range(3))
        + " FROM hits GROUP BY doc_id HAVING count(DISTINCT term) = 3",
        "phrase_intervals": f"WITH {_tables()}, {_hits(_SLOP)}, {_chain(3)} SELECT doc_id, first, last, last - first - 2 AS gaps FROM chain WHERE last - first - 2 <= 3",
        "score_bounds": f"{_BEST} SELECT doc_id, round(sum(w), 6) AS bound FROM best GROUP BY doc_id HAVING count(*) = 3",
        "hydrated_results": f"SELECT b.doc_id, score, text AS content FROM ({_phrase([('er', 0), ('ntre', 0)], 0, 5)}) b JOIN documents d ON b.doc_id = d.doc_id",
        "get_document": "SELECT doc_id, text AS content FROM documents WHERE doc_id = 7",
        "parsed_queries": """SELECT * FROM (VALUES ('a', 0, 'hello', 0, 0), ('a', 1, 'world', 0, 0), ('b', 0, 'quick', 1, 12), ('b', 1, 'brown', 1, 12),
  ('b', 2, 'fox', 0, 12), ('c', 0, 'x', 0, 0), ('c', 1, 'abc', 1, 0), ('c', 2, 'abcdef', 2, 0), ('d', 0, 'café', 1, 0), ('d', 1, 'faq?', 0, 0))
  AS t(query_id, term_idx, text, fuzz, slop)""",
        "batch_search": f"{_BATCH} SELECT item_id, doc_id, score FROM found",
        "batch_top_3": f"{_BATCH} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM found) WHERE rank <= 3",
        "search_after_deletes": _phrase(_SLOP, 2, where=_TOXIC),
        "search_after_merge": _phrase(_SLOP, 2, where=_TOXIC),
        "vocabulary_after_deletes": f"WITH {_tables(_TOXIC)} SELECT token, df FROM vocab",
        "session_of_ulids": "SELECT text AS content, TRUE AS is_ulid FROM documents",
        "streamed_search": _phrase(_SLOP, 2, where=_TOXIC),
        "stemmed_search": _phrase([("ere", 0), ("thli", 0)], 4, stemming=True),
        "ulid_column": f"""SELECT doc_id, '01HF7YAT00' || list_aggregate(list_transform(range(15, -1, -1), lambda k:
  substr('{_ALPHABET}', CAST(((513::HUGEINT * 18446744073709551616 + doc_id) >> (5 * k::INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS ulid FROM documents""",
    }
    return out | {f"phrase_slop_{k}": _phrase(_SLOP, k) for k in range(4)}
