"""Oracle SQL (DuckDB) of the corpus queries that SQL can express on whole tables."""

OP4 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP7 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, 'unknown'), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), s AS (
  SELECT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, conv_id, turn, role, text FROM t WHERE rn = 1
), p AS (
  SELECT pair_id, max(CASE WHEN side = 'chosen' THEN conv_id END) AS chosen_id, max(CASE WHEN side = 'rejected' THEN conv_id END) AS rejected_id FROM s GROUP BY pair_id
), m AS (
  SELECT pair_id, turn, count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text) AS differs FROM s GROUP BY pair_id, turn
), e AS (SELECT pair_id, min(CASE WHEN differs THEN turn END) AS split FROM m GROUP BY pair_id),
n AS (
  SELECT e.pair_id, e.split, count(CASE WHEN e.split IS NULL OR m.turn < e.split THEN 1 END) AS prompt_turns FROM e JOIN m ON m.pair_id = e.pair_id GROUP BY e.pair_id, e.split
)
SELECT s.pair_id, p.chosen_id, p.rejected_id, n.prompt_turns,
  CASE WHEN n.split IS NULL OR s.turn < n.split THEN 'prompt' ELSE s.side END AS part, s.turn, s.role,
  concat('<|', s.role, '|>', chr(10), s.text, '<|end|>', chr(10)) AS segment,
  (n.split IS NULL OR s.turn < n.split) OR s.role <> 'assistant' AS masked
FROM s JOIN p ON p.pair_id = s.pair_id JOIN n ON n.pair_id = s.pair_id
WHERE NOT (n.split IS NULL OR s.turn < n.split) OR s.side = 'chosen'
"""

OP10 = r"""
WITH u AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(query, '([?&])(utm_[^&]*|ref=[^&]*|fbclid=[^&]*|gclid=[^&]*)(&|$)', '\1', 'g'), '[?&]+$', '') AS cleaned FROM u
), c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '/+$', ''), cleaned) END AS canon FROM q
), l AS (
  SELECT concat(prefix, label, '.example.', domain, '/', lang, '/', n * 5, form) AS canon
  FROM (SELECT unnest(['spam-farm', 'cheap-pills', 'ads-track', 'casino-win', 'free-bets', 'adult-x']) AS label),
    (SELECT unnest(['', 'm.', 'blog.']) AS prefix), (SELECT unnest(['com', 'net', 'org']) AS domain), (SELECT unnest(['en', 'de', 'fr', 'es']) AS lang),
    (SELECT unnest(['', '.html']) AS form), (SELECT unnest(range(2000)) AS n)
  UNION ALL SELECT concat('blog.tionsh.example.com/fr/', n, form) FROM (SELECT unnest(['', '.html']) AS form), (SELECT unnest(range(10000)) AS n)
), r AS (
  SELECT c.page_id, c.host, c.path, l.canon IS NOT NULL AS listed, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM c LEFT JOIN l ON c.canon = l.canon
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": OP4, "op7_preference_chat": OP7, "op10_url_filter": OP10}
