"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(CAST(x AS DOUBLE)) OR isinf(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.w, d.w) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP9 = r"""
WITH pages_at AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM pages_at
), rules(rule, verdict) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), fitted AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT *, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules) r
  JOIN parsed p ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY page_id
), seen AS (
  SELECT host, count(*) AS n, sum(quality) AS good FROM parsed JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY host
), overall AS (
  SELECT (sum(good) + 1) / (sum(n) + 2.0) AS mean FROM seen
), known AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(good, 0) AS good, string_split(host, '.') AS labels,
    CASE WHEN len(labels) > 2 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(labels[-1]) = 2 THEN 2 ELSE 1 END AS kept,
    array_to_string(labels[-kept:], '.') AS suffix, CASE WHEN len(labels) <= kept + 1 THEN host ELSE array_to_string(labels[-(kept + 1):], '.') END AS domain
  FROM (SELECT DISTINCT host FROM parsed) LEFT JOIN seen USING (host)
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT mean FROM overall) AS parent FROM known GROUP BY suffix
), s1 AS (
  SELECT *, (SELECT CASE WHEN count(*) < 2 THEN 10000.0 ELSE CASE WHEN any_value(b) <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, any_value(w) / any_value(b) - 1)) END END
    FROM (SELECT sum(n * parent * (1 - parent)) OVER () / sum(n) OVER () AS w,
      (sum(n * power(good / n - parent, 2)) OVER () - (count(*) OVER () - 1) * w) / (sum(n) OVER () - sum(n * n) OVER () / sum(n) OVER ()) AS b FROM s0 WHERE n > 0)) AS k
  FROM s0
), d0 AS (
  SELECT domain, any_value((s1.good + s1.k * s1.parent) / (s1.n + s1.k)) AS parent, sum(known.n) AS n, sum(known.good) AS good FROM known JOIN s1 USING (suffix) GROUP BY domain
), d1 AS (
  SELECT *, (SELECT CASE WHEN count(*) < 2 THEN 10000.0 ELSE CASE WHEN any_value(b) <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, any_value(w) / any_value(b) - 1)) END END
    FROM (SELECT sum(n * parent * (1 - parent)) OVER () / sum(n) OVER () AS w,
      (sum(n * power(good / n - parent, 2)) OVER () - (count(*) OVER () - 1) * w) / (sum(n) OVER () - sum(n * n) OVER () / sum(n) OVER ()) AS b FROM d0 WHERE n > 0)) AS k
  FROM d0
), h0 AS (
  SELECT host, (d1.good + d1.k * d1.parent) / (d1.n + d1.k) AS parent, known.n, known.good FROM known JOIN d1 USING (domain)
), h1 AS (
  SELECT *, (SELECT CASE WHEN count(*) < 2 THEN 10000.0 ELSE CASE WHEN any_value(b) <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, any_value(w) / any_value(b) - 1)) END END
    FROM (SELECT sum(n * parent * (1 - parent)) OVER () / sum(n) OVER () AS w,
      (sum(n * power(good / n - parent, 2)) OVER () - (count(*) OVER () - 1) * w) / (sum(n) OVER () - sum(n * n) OVER () / sum(n) OVER ()) AS b FROM h0 WHERE n > 0)) AS k
  FROM h0
), reputation AS (
  SELECT host, (good + k * parent) / (n + k) AS mean, mean + 2 * sqrt(mean * (1 - mean) / (n + k + 1)) AS upper FROM h1
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN fitted USING (page_id) LEFT JOIN reputation USING (host)
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY 1
), counts AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM words
  ) GROUP BY 1, 2
), candidates AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE f >= 100 AND contains(phrase, ' ')
), cuts AS (
  SELECT lang, phrase, a, unnest(range(1, len(ws))) AS k, ws FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts c JOIN totals USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT DISTINCT q.lang, array_to_string(q.ws[i:j], ' ') AS phrase, q.a FROM candidates q, LATERAL (SELECT unnest(range(1, len(q.ws) + 1)) AS i), LATERAL (SELECT unnest(range(i + 1, len(q.ws) + 1)) AS j) WHERE j - i + 1 < len(q.ws)
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.a >= 100 * b.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

OP12 = r"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8
), words AS (
  SELECT 'd' AS side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 't', NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), features AS (
  SELECT side, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM words
), bytes AS (
  SELECT feature, list_transform(range(octet_length(encode(feature))), lambda j: CAST('0x' || substr(hex(encode(feature)), 2 * j + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT feature FROM features)
), buckets AS (
  SELECT feature, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM features JOIN buckets USING (feature) GROUP BY 1
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM counted) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM counted) + 10000)))) AS BIGINT) AS gain FROM counted
), weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM features JOIN buckets USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT w.doc_id, len(ws) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights x ON x.doc_id = w.doc_id WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY eligible) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""

#: (kind, pattern, measured group, least length) in the order of the kinds.
SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0), ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}", 0, 0), ("bearer", r"(?i:bearer\x20+[A-Za-z0-9._~+/-]{20,})", 0, 0),
]


def op13() -> str:
    """Matches in order, each found again behind the one before it: a match is the first place of its text there."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT doc_id, text, {i} AS kind, regexp_extract_all(text, {quoted(p)}) AS ms FROM documents" for i, (_, p, _, _) in enumerate(SECRETS))
    sizes = " ".join(f"WHEN {i} THEN length({f'regexp_extract(m, {quoted(p)}, {g})' if g else 'm'}) >= {least}" for i, (_, p, g, least) in enumerate(SECRETS))
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, *_) in enumerate(SECRETS))
    joined = lambda condition: f"coalesce(string_agg(name || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, kind) FILTER ({condition}), '')"
    return f"""
WITH RECURSIVE found AS ({found}), walk AS (
  SELECT doc_id, text, kind, ms, 0 AS i, CAST(0 AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS m, CAST(0 AS BIGINT) AS upto FROM found WHERE len(ms) > 0
  UNION ALL SELECT doc_id, text, kind, ms, i + 1, upto + strpos(substr(text, upto + 1), ms[i + 1]) - 1, ms[i + 1], upto + strpos(substr(text, upto + 1), ms[i + 1]) - 1 + length(ms[i + 1]) FROM walk WHERE i < len(ms)
), spans AS (
  SELECT doc_id, kind, CASE kind {names} END AS name, start, m FROM walk WHERE i > 0 AND CASE kind {sizes} END
)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256({joined('kind <= 2')}) AS base_sha256, {joined('kind >= 0')} AS spans
FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1, "op9_url_filter": OP9, "op11_phrase_collocations": OP11, "op12_importance_resampling": OP12, "op13_secret_scan": op13()}
