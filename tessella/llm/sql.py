"""DuckDB SQL for the results of the corpus queries."""

W = r"[^\x20\x09-\x0D]+"

_OP1_RULES = ("short", "repetitive", "symbol_heavy", "line_repeats")
_OP1_BAD = " OR ".join(f"(h.{r} + p.{r}_m * p.{r}_w) / (h.host_docs + p.{r}_w) >= 0.5" for r in _OP1_RULES)
_OP1_MOMENTS = ", ".join(f"avg({r} / host_docs) AS {r}_m, coalesce(var_samp({r} / host_docs), 0) AS {r}_v" for r in _OP1_RULES)
_OP1_WEIGHTS = ", ".join(
    f"{r}_m, CASE WHEN {r}_v - {r}_m * (1 - {r}_m) * inv > 0 THEN least(1000.0, greatest(1.0, {r}_m * (1 - {r}_m) / ({r}_v - {r}_m * (1 - {r}_m) * inv) - 1)) ELSE 1000.0 END AS {r}_w"
    for r in _OP1_RULES
)
OP1 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{W}') GROUP BY doc_id),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
ruled AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repetitive,
    10 * n_symbols > word_chars AS symbol_heavy, 10 * n_dup_lines > 3 * n_lines AS line_repeats FROM base),
h AS (
  SELECT source, count(*)::DOUBLE AS host_docs, {", ".join(f"sum({r}::INT)::DOUBLE AS {r}" for r in _OP1_RULES)}
  FROM ruled WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(1 / host_docs) AS inv, {_OP1_MOMENTS} FROM h),
p AS (SELECT {_OP1_WEIGHTS} FROM m),
v AS (SELECT h.source, {_OP1_BAD} AS host_rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  coalesce(host_rejected, false) AS host_rejected, NOT (short OR repetitive) AND NOT coalesce(host_rejected, false) AS kept
FROM ruled LEFT JOIN v USING (source)
"""



def op4(limit: int) -> str:
    """A bucket is the shortest prefix of the key's MD5 bits within the limit or with one hash; one hash over the limit
    is cut into pages."""
    word = lambda k: f"lpad(bin(('0x' || substr(m, {k}, 8))::BIGINT), 32, '0')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS digest,
    md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
b AS (SELECT doc_id, n_bytes, digest, {" || ".join(word(k) for k in (1, 9, 17, 25))} AS bits FROM d),
levels AS (
  SELECT depth, left(bits, depth) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*) AS docs, sum(n_bytes) > {limit} AND min(bits) <> max(bits) AS splits
  FROM b, (SELECT unnest(range(0, 129))::INT AS depth) l GROUP BY ALL),
leaf AS (
  SELECT c.* FROM levels c LEFT JOIN levels p ON p.depth = c.depth - 1 AND p.prefix = left(c.prefix, c.depth - 1)
  WHERE NOT c.splits AND (c.depth = 0 OR p.splits)),
placed AS (SELECT b.*, leaf.* FROM b JOIN leaf ON leaf.prefix = left(b.bits, leaf.depth)),
sums AS (
  SELECT *, 2 * n_bytes > {limit} AS large, coalesce(sum(CASE WHEN 2 * n_bytes <= {limit} THEN n_bytes ELSE 0 END) OVER w, 0) AS placed_at, count(CASE WHEN 2 * n_bytes > {limit} THEN 1 END) OVER w AS k
  FROM placed WINDOW w AS (PARTITION BY prefix ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
named AS (SELECT *, CASE WHEN bytes <= {limit} THEN prefix WHEN large THEN prefix || '+' || k ELSE prefix || '.' || (placed_at // greatest(1, {limit} // 2))::BIGINT END AS shard FROM sums)
SELECT doc_id, n_bytes, shard, depth AS shard_depth, (sum(n_bytes) OVER s)::BIGINT AS shard_bytes, count(*) OVER s AS shard_docs FROM named WINDOW s AS (PARTITION BY shard)
"""


OP6 = r"""
WITH r AS (
  SELECT 2 * page_id AS record_id, url, 10 * page_id AS ts, false AS revisit, md5(html) AS etag, (10 * page_id)::VARCHAR AS date,
    octet_length(encode(html))::VARCHAR AS len, html FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again#top',
    10 * page_id + CASE WHEN page_id % 14 = 0 THEN -5 ELSE 5003 END, true, CASE WHEN page_id % 10 = 0 THEN md5(html || 'x') ELSE md5(html) END,
    (10 * page_id + 5003)::VARCHAR, '0', NULL FROM pages WHERE page_id % 2 = 0
  UNION ALL
  SELECT 2 * page_id + 1, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again#top',
    10 * page_id + CASE WHEN page_id % 14 = 0 THEN -5 ELSE 5003 END, true, CASE WHEN page_id % 10 = 0 THEN md5(html || 'x') ELSE md5(html) END,
    (10 * page_id + 5003)::VARCHAR, '0', NULL FROM pages WHERE page_id % 8 = 0),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM r),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.html?$', ''), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params FROM u),
k AS (SELECT *, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canon FROM c),
w AS (
  SELECT *, last_value(CASE WHEN NOT revisit THEN record_id END IGNORE NULLS) OVER (
    PARTITION BY canon ORDER BY ts, revisit DESC, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS response_id FROM k),
j AS (
  SELECT w.record_id, w.canon AS canonical_url, w.response_id, w.etag, w.date, w.len, o.etag AS o_etag, o.len AS o_len, o.html,
    CASE WHEN w.response_id IS NULL THEN 'no_response' WHEN w.etag = o.etag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM w LEFT JOIN k o ON o.record_id = w.response_id WHERE w.revisit)
SELECT record_id, canonical_url, outcome, response_id,
  'cache-control=max-age=60;content-length=' || CASE WHEN outcome = 'resolved' THEN o_len ELSE len END || ';date=' || date || ';etag=' || etag AS headers,
  CASE WHEN outcome = 'resolved' THEN octet_length(encode(html)) END::BIGINT AS payload_bytes, CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5
FROM j
"""

#: A line's tokens fall into the leading two and up to six stretches. For each choice of stretches that may vary (none; one
#: in lines of 4 to 7 tokens; two in longer ones), lines that are equal outside it recur if enough documents hold them.
OP7 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT doc_id, pos, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '{W}') AS tok FROM l),
f AS (SELECT *, len(tok) AS n, least(6, len(tok) - 2) AS b FROM m WHERE len(tok) >= 3),
k AS (SELECT unnest(range(-1, 6))::INT AS i),
masks AS (SELECT a.i AS i, c.i AS j FROM k a, k c),
each AS (
  SELECT doc_id, pos, n, i, j, list_filter(tok, lambda x, p: p <= 2 OR NOT (
    p - 3 >= (n - 2) * i // b AND p - 3 < (n - 2) * (i + 1) // b OR p - 3 >= (n - 2) * j // b AND p - 3 < (n - 2) * (j + 1) // b)) AS rest
  FROM f, masks WHERE i = -1 AND j = -1 OR n BETWEEN 4 AND 7 AND i = j AND i >= 0 AND j < b OR n >= 8 AND i >= 0 AND i < j AND j < b),
again AS (SELECT n, i, j, rest, min(doc_id) AS first FROM each GROUP BY ALL HAVING count(DISTINCT doc_id) >= CASE WHEN n > 50 THEN 2 ELSE 3 END),
lost AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM each JOIN again USING (n, i, j, rest) WHERE doc_id <> first GROUP BY doc_id)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text
FROM documents LEFT JOIN lost USING (doc_id)
"""

ORACLES = {"op1_quality_rules": OP1, "op4_sharding": op4(4 * 1024 * 1024), "op6_warc_revisits": OP6, "op7_line_dedup": OP7}
