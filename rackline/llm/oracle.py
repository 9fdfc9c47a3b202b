"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rackline.llm.chat import Template
from rackline.llm.linededup import MIN_WORDS
from rackline.llm.quality import RULES, STOP_WORDS, SYMBOLS

_GAP = r"[\x20\x09-\x0D]+"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    ratios = {
        "n_words": "n_words",
        "repeat_word_ratio": "n_repeat_words / n_words",
        "mean_word_chars": "word_chars / n_words",
        "symbol_word_ratio": "n_symbols / n_words",
        "stop_word_ratio": "n_stop / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
        "shouted_word_ratio": "n_shouted / n_words",
    }
    rules = []
    for rule in RULES:
        if rule.low is not None:
            rules.append(f"coalesce({ratios[rule.metric]}, 0) >= {rule.low}")
        if rule.high is not None:
            rules.append(f"coalesce({ratios[rule.metric]}, 0) <= {rule.high}")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_GAP}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
  len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop,
  len(regexp_extract_all(t, '(^|[\x20\x09-\x0D])[A-ZÀ-Þ]{{3}}')) AS n_shouted
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(rules)} AS kept FROM b"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM pos) p JOIN win w USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _chat() -> str:
    t = Template()

    def escaped(column: str) -> str:
        return rf"regexp_replace({column}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g')"

    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
s AS (SELECT conv_id, turn, role, text, length({escaped("text")}) + CASE WHEN before = role THEN {len(t.next)}
  ELSE {len(t.start)} + length({escaped("role")}) + CASE WHEN role = 'assistant' THEN {len(t.learn)} ELSE {len(t.text)} END + {len(t.end)} END AS n FROM p),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS written,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned, sum(n)::BIGINT AS formatted_chars FROM s GROUP BY 1)
SELECT conv_id, n_turns, sha256(written) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM a"""


_LINES = rf"""
WITH l AS (SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '{_GAP}'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
  sum(w) OVER (PARTITION BY doc_id) AS total FROM l WHERE w > 0),
s AS (SELECT doc_id, q, q + count(*) OVER f - 1 AS last FROM q WINDOW f AS (PARTITION BY doc_id ORDER BY upto - w RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) QUALIFY upto - w + {MIN_WORDS} <= total
  UNION SELECT doc_id, q - count(*) OVER b + 1, q FROM q WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW) QUALIFY upto >= {MIN_WORDS}),
r AS (SELECT s.doc_id, s.q, s.last, string_agg(x.line, chr(10) ORDER BY x.q) AS run FROM s JOIN q x ON x.doc_id = s.doc_id AND x.q BETWEEN s.q AND s.last GROUP BY ALL),
later AS (SELECT doc_id, q, last FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, q) > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(q, last + 1)) AS q FROM later),
gone AS (SELECT q.doc_id, q.i FROM cut JOIN q USING (doc_id, q)),
kept AS (SELECT l.doc_id, count(*) FILTER (w > 0)::BIGINT AS n_lines, count(gone.i)::BIGINT AS n_removed,
  coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""

_VECTORS = """
WITH v AS (SELECT vec_id, {more}list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL {where}AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"""

_TOP = (
    _VECTORS.format(more="", scale=1024, where="")
    + """,
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER o)::INTEGER AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 10"""
)

_NEGATIVES = (
    _VECTORS.format(
        more="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, ",
        scale=256,
        where="AND label IS NOT NULL ",
    )
    + """,
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER o)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 5"""
)

_LEXICAL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), c GROUP BY 1, 2)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50"""

ORACLE = {
    "op1_quality_rules": _quality(),
    "op2_warc": _WARC,
    "op4_decontamination": _DECONTAMINATION,
    "op9_chat_format": _chat(),
    "op10_line_dedup": _LINES,
    "op11_topk_search": _TOP,
    "op12_lexical_search": _LEXICAL,
    "op13_hard_negatives": _NEGATIVES,
}
