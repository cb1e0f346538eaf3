"""DuckDB SQL for the training-data queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from . import urls

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT * FROM r WHERE rank <= 20
"""

#: The trees' leaves compared outright: what a descent from the roots must find.
FIXITY = """
WITH r AS (
  SELECT page_id, sha256('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || coalesce('WARC-Target-URI: ' || {url} || chr(13) || chr(10), '')
    || coalesce('Content-Length: ' || CAST(octet_length(encode({html})) AS VARCHAR) || chr(13) || chr(10), 'WARC-Truncated: unspecified' || chr(13) || chr(10))
    || chr(13) || chr(10) || coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS d, {rest} FROM {source}
)"""
LIMBS = " || ':' || ".join(f"CAST(sum(CAST(('0x' || substr(d, {1 + 13 * i}, 13)) AS BIGINT)) AS VARCHAR)" for i in range(5))
LEAVES = f"SELECT page_id, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' || {LIMBS}) AS digest"
WARC_FIXITY = f"""
{FIXITY.format(url="url", html="html", rest="url, html", source="pages")},
copies AS (SELECT page_id, url, CASE WHEN d[1:2] = '00' THEN substr(html, 2) ELSE html END AS html FROM r, range(CASE WHEN d[1:2] = '01' THEN 0 WHEN d[1:2] = '02' THEN 2 ELSE 1 END)),
{FIXITY.format(url="url", html="html", rest="1 AS x", source="copies").strip().removeprefix("WITH r").join(["s", ""])},
a AS ({LEAVES} FROM r GROUP BY page_id), b AS ({LEAVES} FROM s GROUP BY page_id)
SELECT page_id, CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'altered' END AS state,
  coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, a.digest AS digest_a, b.digest AS digest_b
FROM a FULL JOIN b USING (page_id) WHERE a.digest IS DISTINCT FROM b.digest
"""

INTERACTION = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), m AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > least, false)
  ] AS fails FROM d LEFT JOIN labels USING (doc_id)
), g AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM p),
x AS (
  SELECT part, o, step, good, toxic, n, o[step] AS i, fails[o[step]] AS failing, len(list_filter(o[1:step - 1], lambda j: fails[j])) > 0 AS gone,
    fails[o[step]] AND len(list_filter(fails, lambda v: v)) = 1 AS alone FROM g, s
), r AS (
  SELECT part, o, step, i, sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL
) SELECT part, array_to_string([substr('ABCDE', CAST(j AS BIGINT), 1) FOR j IN o], '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM r
"""

ORACLE_SQL: dict[str, str] = {"op1_warc_fixity": WARC_FIXITY, "op3_exact_top_k": TOP_K, "op6_url_filter": urls.judge_sql(), "op12_filter_interaction": INTERACTION}
