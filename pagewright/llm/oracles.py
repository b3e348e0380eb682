"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from .quality import BULLET, ELLIPSIS, RULES, STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, len({WORDS})::BIGINT AS size,
             substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, source_size::DOUBLE / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 3 AS spent,
        sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest FROM o),
f AS (SELECT min((ratio, k)) AS first FROM c WHERE source_size::DOUBLE * 3 * rest > (total::DOUBLE - spent) * weight),
l AS (SELECT total::DOUBLE - spent AS words, rest FROM c, f WHERE (ratio, k) = f.first),
t AS (SELECT c.k, source_size, CASE WHEN (SELECT f.first FROM f) IS NULL OR (ratio, c.k) < (SELECT f.first FROM f) THEN source_size::DOUBLE * 3
        ELSE (SELECT words FROM l) * weight / (SELECT rest FROM l) END AS target FROM c),
x AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
        coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN 2 * before + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""

_COUNTS = rf"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, gram, unnest(list(i)) AS i FROM g GROUP BY r, gram HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM p) GROUP BY r),
n AS (SELECT d.r, doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN c ON d.r = c.r)
"""


def _quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    share = lambda pattern: f"CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '{pattern}')))::DOUBLE / len(lines) ELSE 0 END"
    per_word = lambda a: f"CASE WHEN n_words > 0 THEN ({a})::DOUBLE / n_words ELSE 0 END"
    made = {
        "mean_word_length": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "stop_word_ratio": per_word(rf"len(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), lambda x: x IN ({stops})))"),
        "duplicate_line_ratio": "CASE WHEN len(lines) > 0 THEN n_dup_lines::DOUBLE / len(lines) ELSE 0 END",
        "bullet_line_ratio": share(BULLET),
        "ellipsis_line_ratio": share(ELLIPSIS),
    }
    tests = [f"{made[r.measure]} {sign} {limit}" for r in RULES for sign, limit in ((">=", r.low), ("<=", r.high)) if limit is not None]
    return f"""
WITH {_COUNTS},
b AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
"""


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages),
x AS (SELECT *, sha1(h) AS hexed FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hexed, (10 * (j // 8) + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (j % 8))::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM x
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, i, lines[i] AS line, {LOWER.format(r"regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS last FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT x.*, c.k IS NOT NULL AND doc_id <> last AS gone FROM x LEFT JOIN c ON x.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

SQL = {"op1_mixing": OP1, "op5_quality": _quality(), "op6_warc": OP6, "op7_neardup": OP7, "op9_linededup": OP9}
