"""The text queries that SQL can say as well, for DuckDB."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

CONTAMINATION = rf"""WITH i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
  g AS (SELECT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
  d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
  p AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g))),
  h AS (SELECT doc_id, item_id, k, p.n FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
  c AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM h) GROUP BY doc_id),
  s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS sh FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
  e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) LEFT JOIN n USING (doc_id)"""

REVISITS = r"""WITH u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
  v AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(bare, '^[^/?]*'), '^.*@', '')), ':(80|443)?$', ''), '^www\.', '') AS host,
      regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
      list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$'))) AS asked FROM u),
  w AS (SELECT page_id, html, host || path || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS page FROM v),
  f AS (SELECT page_id, page, page_id * 10 AS moment, md5(html) AS digest, strlen(html) AS size FROM w WHERE page_id % 11 <> 0),
  q AS (SELECT page_id, html, page, 1 AS turn, page_id * 10 + CASE WHEN page_id % 3 = 0 THEN -5 ELSE 3 END AS moment FROM w UNION ALL SELECT page_id, html, page, 2, page_id * 10 + 7 FROM w),
  m AS (SELECT q.page_id, q.page, q.turn, max(q.html) AS html, max(f.page_id) AS met FROM q LEFT JOIN f ON f.page = q.page AND f.moment < q.moment GROUP BY ALL),
  x AS (SELECT m.*, f.digest, f.size, f.moment, CASE WHEN met IS NULL THEN 'no_response' WHEN turn = 1 THEN CASE WHEN m.page_id % 5 <> 0 AND md5(html) = f.digest THEN 'resolved' ELSE 'changed' END
      WHEN m.page_id % 7 = 0 THEN 'unverified' WHEN m.page_id * 10 = f.moment THEN 'resolved' ELSE 'changed' END AS resolution FROM m LEFT JOIN f ON f.page_id = m.met)
  SELECT page_id * 3 + turn AS record_id, page AS canonical_url, met * 3 AS refers_to, resolution,
    CASE WHEN resolution = 'resolved' THEN CASE WHEN turn = 2 THEN 'age: 5' || chr(10) ELSE '' END || 'cache-control: max-age=' || CASE WHEN turn = 1 THEN '3600' ELSE '60' END || chr(10)
      || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || CASE WHEN turn = 1 THEN 'W/' ELSE '' END || '"' || digest || '"' || chr(10) || 'last-modified: day ' || moment END AS headers,
    CASE WHEN resolution = 'resolved' THEN digest END AS payload_digest FROM x"""


_BLANKS = r"\x20\x09-\x0D"
FILL_IN_MIDDLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
  k AS (SELECT doc_id, t, regexp_extract_all(t, '[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+') AS w, [('0x' || substr(h, i * 8 + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
  c AS (SELECT doc_id, t, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
  p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(pre || mid || suf) AS restored_sha256 FROM p"""


def vector_codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Every round as two steps over all distances of parts and entries."""
    steps = [f"""v AS (SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS j, CAST(floor(e[i]::DOUBLE * 1024) AS BIGINT) AS x FROM (SELECT vec_id, e, w, unnest(range(1, len(e) + 1)) AS i FROM v)),
  b0 AS MATERIALIZED (SELECT part, entry, j, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, x.part, entry, sum((x - c) * (x - c)) AS far FROM x JOIN b{r} b ON b.part = x.part AND b.j = x.j GROUP BY ALL),
  a{r} AS MATERIALIZED (SELECT vec_id, part, min(far) AS far, arg_min(entry, (far, entry)) AS entry FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, entry, j, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL),
  b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.j, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM b{r} b LEFT JOIN m{r} USING (part, entry, j))""")
    last = f"""f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
  g AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, j)) AS digest FROM b{rounds})
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM f JOIN v USING (vec_id), g"""
    return "WITH " + ",\n  ".join([*steps, last])
