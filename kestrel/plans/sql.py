"""SQL building blocks for the oracle: the same adapters as
``kestrel.sources.adapters``, written as DuckDB common table expressions."""

from __future__ import annotations


def h(expr: str) -> str:
    """First 15 hex digits of md5 as an integer (see functions.hashing)."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"


IND = """ind AS (
  SELECT n_nationkey AS stock_code, r_name AS IndustryCode1, n_name AS IndustryCode2
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 4
)"""

POSTS_BASE = """posts_base AS (
  SELECT o_orderkey AS post_id,
         CAST(o_custkey % 200 AS VARCHAR) AS item_author,
         c_mktsegment AS article_author,
         o_orderpriority AS article_source,
         c_nationkey AS stock_code,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         make_date(year(o_orderdate), month(o_orderdate), 1) AS year_month,
         CAST(o_orderstatus = 'F' AS INTEGER) AS robo_site,
         CAST(o_orderstatus = 'O' AS INTEGER) AS robo_media,
         CAST(o_orderstatus = 'P' AS INTEGER) AS robo_sma,
         CASE o_orderstatus WHEN 'F' THEN 'Negative' WHEN 'O' THEN 'Neutral' WHEN 'P' THEN 'Positive' END AS sentiment_label,
         CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS INTEGER) AS sentiment,
         CAST(o_custkey % 3 AS INTEGER) AS topic,
         o_totalprice AS popularity
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

POSTS = f"""{IND},
{POSTS_BASE},
posts_enriched AS (
  SELECT b.*, coalesce(ind.IndustryCode1, 'others') AS IndustryCode1,
         coalesce(ind.IndustryCode2, 'others') AS IndustryCode2
  FROM posts_base b LEFT JOIN ind ON b.stock_code = ind.stock_code
),
posts AS (
  SELECT * EXCLUDE (_rn, _n), CAST(_rn <= floor(0.05 * _n) AS INTEGER) AS viral
  FROM (SELECT *, row_number() OVER (ORDER BY popularity DESC, post_id) AS _rn,
               count(*) OVER () AS _n FROM posts_enriched)
)"""

TEXTS = """texts AS (
  SELECT d.doc_id AS post_id, d.text AS item_title, d.source AS article_source,
         d.lang AS industry, l.quality AS viral,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         make_date(year(o.o_orderdate), month(o.o_orderdate), 1) AS year_month
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  LEFT JOIN orders o ON d.doc_id = o.o_orderkey
)"""

SCORED = f"""{POSTS},
scored0 AS (
  SELECT post_id, viral AS y,
         CAST({h("'s|' || CAST(post_id AS VARCHAR)")} AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE)
           + CAST(0.3 AS DOUBLE) * viral AS score
  FROM posts
),
scored AS (
  SELECT s.*, CAST(s.score >= t.thr AS INTEGER) AS pred
  FROM scored0 s, (
    SELECT score AS thr FROM (
      SELECT score, row_number() OVER (ORDER BY score DESC, post_id) AS rn,
             count(*) OVER () AS n FROM scored0)
    WHERE rn = CAST(floor(n * 0.01) AS BIGINT) + 1) t
)"""

SPLIT_CASE = """CASE
    WHEN year_month BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'train'
    WHEN year_month BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' THEN 'valid'
    WHEN year_month BETWEEN DATE '2000-07-01' AND DATE '2000-09-30' THEN 'test1'
    WHEN year_month BETWEEN DATE '2000-10-01' AND DATE '2000-12-31' THEN 'test2'
    WHEN year_month BETWEEN DATE '2001-01-01' AND DATE '2001-03-31' THEN 'test3'
    WHEN year_month BETWEEN DATE '2001-04-01' AND DATE '2001-08-31' THEN 'test4'
  END"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
