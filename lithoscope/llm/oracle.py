"""DuckDB SQL for the training-data queries that SQL can express."""

from .url_graph import LINK

OP2_CHAT_FORMAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    length('<|turn|>' || role || chr(10) || '<|end|>' || chr(10))
    + length(regexp_replace(text, '(</?s>|<\|[a-z_]+\|>|</?SYS>|\[/?INST\])', '\1~', 'g')) AS size
  FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP5_WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""

OP10_QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), facts AS (
  SELECT rid, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n, length(line) AS chars,
    length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
    length(line) - length(replace(line, ' | ', '  ')) AS bars, length(line) - length(replace(line, '!!', '!')) AS shouts
  FROM lines
), judged AS (
  SELECT *, symbols > 0.1 * chars OR bars > 0.15 * n OR shouts > 0.3 * n OR (40 * len(regexp_extract_all(lower(line),
    'all rights reserved|cookie policy|accept cookies|privacy policy|terms of service|terms of use|enable javascript|javascript is disabled|click here|sign up for our newsletter|subscribe to our|log in to|back to top|skip to content|share on facebook|follow us on')) > greatest(n - 1, 0)) AS fails
  FROM facts
), per_doc AS (
  SELECT rid, sum(n) AS n_words, sum(symbols) AS n_symbols, sum(n) FILTER (WHERE NOT fails) AS kept_words,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines
  FROM judged GROUP BY rid
), words AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM d
), windows AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS win FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM words)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), counted AS (
  SELECT d.doc_id, p.n_words::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, p.n_symbols::BIGINT AS n_symbols,
    p.n_dup_lines::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(p.kept_words, 0)::BIGINT AS kept_words
  FROM d JOIN per_doc p USING (rid) JOIN words w USING (rid) LEFT JOIN covered c USING (rid)
)
SELECT *, base_failed = FALSE AND n_words - kept_words <= 0.5 * n_words AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format


def _op11(rounds: int = 20) -> str:
    """Each round as a statement of its own; the ranks as in ``url_graph``."""
    steps = "\n".join(f"""), r{k + 1} AS MATERIALIZED (
  SELECT kind, host, sum(r)::BIGINT AS r FROM (
    SELECT kind, s.dst AS host, CAST(floor(r.r::DOUBLE * s.share) AS BIGINT) AS r FROM r{k} r JOIN ways s USING (kind, host)
    UNION ALL SELECT kind, host, r FROM r0) GROUP BY ALL""" for k in range(rounds))
    link = LINK.replace("'", "''")
    return rf"""
WITH parts AS MATERIALIZED (
  SELECT page_id, {_LOWER("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages
), rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS MATERIALIZED (
  SELECT page_id, host, path, (SELECT max_by(struct_pack(t := h || p, v := verdict), length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM parts
), links AS (
  SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {_LOWER("x")}))) AS dst FROM parts
), edges AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY ALL
), ways AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS host, dst, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY dst) FROM edges
), seeds AS (
  SELECT host, 1000000000 * count(*) FILTER (WHERE rule.v = 'allow') // count(*) AS t, 1000000000 * count(*) FILTER (WHERE rule.v = 'block') // count(*) AS d
  FROM judged WHERE host <> '' GROUP BY host
), r0 AS MATERIALIZED (
  SELECT * FROM (SELECT 'trust' AS kind, host, (t * 15 // 100)::BIGINT AS r FROM seeds UNION ALL SELECT 'distrust', host, (d * 15 // 100)::BIGINT FROM seeds) WHERE r > 0
{steps}
), ranks AS (
  SELECT host, coalesce(sum(r) FILTER (WHERE kind = 'trust'), 0)::BIGINT AS trust, coalesce(sum(r) FILTER (WHERE kind = 'distrust'), 0)::BIGINT AS distrust FROM r{rounds} GROUP BY host
)
SELECT page_id, host, path, rule.t AS rule,
  coalesce(rule.v, CASE WHEN 2 * (coalesce(distrust, 0) - coalesce(trust, 0)) > 150000000 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM judged LEFT JOIN ranks USING (host)
"""


OP12_IMPORTANCE_RESAMPLING = rf"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS MATERIALIZED (
  SELECT kind, rid, doc_id, coalesce(regexp_extract_all({_LOWER("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), features AS MATERIALIZED (
  SELECT kind, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), polynomial AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc
), hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), polynomial
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weighed AS (
  SELECT rid, count(*) AS n, sum(gain)::BIGINT AS g FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY rid
), scored AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM words LEFT JOIN weighed USING (rid) WHERE kind = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, rid) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM placed
"""

OP13_SOURCE_DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER("coalesce(text, '')")} AS text FROM documents
), terms AS MATERIALIZED (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT rid) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), priced AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5))::BIGINT // (total + 5 * v)::BIGINT AS p FROM dense
), usual AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5))::BIGINT // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::BIGINT AS q FROM counts GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM priced x JOIN priced y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM priced JOIN usual USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op11_url_filters": _op11(), "op12_importance_resampling": OP12_IMPORTANCE_RESAMPLING, "op13_source_divergence": OP13_SOURCE_DIVERGENCE, "op2_chat_format": OP2_CHAT_FORMAT, "op5_warc": OP5_WARC, "op10_quality_rules": OP10_QUALITY_RULES}
