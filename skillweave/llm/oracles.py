"""DuckDB SQL with the rows of those queries that SQL can express: op1, op5, op9, op11, op12 and op13, over whole tables and whole texts."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS w FROM {table}"


NOT_SPACE = r"[^\x09-\x0D\x20]+"
LETTERS_AND_DIGITS = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _set_join(words: int, percent: int, more: str = "") -> str:
    return f"""
WITH RECURSIVE d AS ({_words("documents", "doc_id", NOT_SPACE)}),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[k : k + least(len(w), {words}) - 1], ' ') AS g
    FROM d, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS t(k) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach AS r JOIN ways AS e ON r.b = e.a),
least_one AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id{more}
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_one USING (doc_id)
"""


JACCARD = _set_join(5, 80)
MINHASH = _set_join(3, 85, ", doc_id <= coalesce(m, doc_id) AS kept")

TRICKY = r"\### Assistant: </turn> ok"
CONTROL = r"(</turn>|### |:\n|\\)"

CHAT = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')
),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM t)
SELECT
    conv_id,
    count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(4 + length(role) + len(regexp_extract_all(role, '{CONTROL}')) + 2 + length(text) + len(regexp_extract_all(text, '{CONTROL}')) + 8)::BIGINT AS formatted_chars,
    bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM o GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM ({_words("documents", "doc_id", LETTERS_AND_DIGITS)})),
b AS ({_words("benchmark", "item_id", LETTERS_AND_DIGITS)}),
item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
    FROM (SELECT rid, w, n FROM d JOIN sizes ON len(w) >= n), unnest(range(1, len(w) - n + 2)) AS t(k)
),
hits AS (SELECT rid, k, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, k, n FROM hits), unnest(range(k, k + n)) AS u(p) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
SELECT
    doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN items USING (rid)
"""

NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT
    anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

COLLOCATIONS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\t]+') AS w FROM p),
totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
grams AS (
    SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase, count(*) AS f
    FROM w, unnest(range(1, 6)) AS a(m), unnest(range(1, len(w) - m + 2)) AS b(k) GROUP BY ALL HAVING count(*) >= 100
),
cuts AS (
    SELECT g.lang, g.m, g.phrase, g.f AS a, g.k, l.f AS l, r.f AS r, n, (1000::HUGEINT * g.f * n) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, m)) AS k FROM grams WHERE m > 1) AS g
    JOIN grams AS l ON l.lang = g.lang AND l.phrase = array_to_string(g.s[1 : g.k], ' ')
    JOIN grams AS r ON r.lang = g.lang AND r.phrase = array_to_string(g.s[g.k + 1 : g.m], ' ') JOIN totals AS t ON t.lang = g.lang
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
alone AS (
    SELECT * FROM best AS c WHERE NOT EXISTS (
        SELECT 1 FROM best AS o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')
    )
)
SELECT
    lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM alone QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

SQL: dict[str, str] = {
    "op1_ngram_jaccard": JACCARD,
    "op5_chat": CHAT,
    "op9_decontamination": DECONTAMINATION,
    "op11_hard_negatives": NEGATIVES,
    "op12_collocations": COLLOCATIONS,
    "op13_minhash": MINHASH,
}
