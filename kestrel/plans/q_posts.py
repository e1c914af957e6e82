"""Queries over the posts table: scans, projections, filters, joins,
aggregates and monthly ranks (SURVEY 2.1-2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalar as S
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import relational as Rel
from ..sources import adapters as A
from ..sources.tables import read_capped, table
from .registry import query
from .sql import IND, POSTS, POSTS_BASE, SCORED, SPLIT_CASE, TEXTS, with_

POST_COLS = ["post_id", "item_author", "article_author", "article_source", "stock_code",
             "IndustryCode1", "IndustryCode2", "year", "month", "year_month", "robo_site",
             "robo_media", "robo_sma", "sentiment_label", "sentiment", "topic", "popularity", "viral"]


@query("scan_posts", with_(POSTS) + "SELECT * FROM posts")
def scan_posts(spark, sf):
    return A.posts(spark, sf).select(*POST_COLS)


@query("scan_pruned", """SELECT o_orderkey AS post_id, CAST(o_orderdate AS DATE) AS post_date,
       o_totalprice AS popularity FROM orders""")
def scan_pruned(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"])
    return o.select(F.col("o_orderkey").alias("post_id"), F.to_date("o_orderdate").alias("post_date"),
                    F.col("o_totalprice").alias("popularity"))


@query("scan_capped", """SELECT o_orderkey AS post_id, o_custkey FROM orders
ORDER BY o_orderkey LIMIT 64000""")
def scan_capped(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    return read_capped(o.withColumnRenamed("o_orderkey", "post_id"), 64000, ["post_id"])


@query("project_posts", with_(POSTS) + """SELECT post_id, year, month, robo_site, robo_media,
       robo_sma, stock_code, viral, sentiment, topic FROM posts""")
def project_posts(spark, sf):
    return Rel.project(A.posts(spark, sf), ["post_id", "year", "month", "robo_site", "robo_media",
                                            "robo_sma", "stock_code", "viral", "sentiment", "topic"])


@query("drop_cols", with_(POSTS) + """SELECT * EXCLUDE (robo_site, robo_media, robo_sma, sentiment_label, popularity)
FROM posts""")
def drop_cols(spark, sf):
    return Rel.drop_columns(A.posts(spark, sf).select(*POST_COLS),
                            ["robo_site", "robo_media", "robo_sma", "sentiment_label", "popularity"])


@query("prefix_cols", with_(POSTS) + """SELECT post_id AS neg_post_id, item_author AS neg_item_author,
       article_author AS neg_article_author, article_source AS neg_article_source,
       stock_code AS neg_stock_code FROM posts WHERE viral = 0""")
def prefix_cols(spark, sf):
    neg = Rel.negatives(A.posts(spark, sf))
    return Rel.prefix_columns(neg, "neg_", ["post_id", "item_author", "article_author",
                                            "article_source", "stock_code"])


@query("cast_block", with_(POSTS_BASE) + """SELECT post_id, CAST(year AS VARCHAR) AS year,
       CAST(stock_code AS BIGINT) AS stock_code, TRY_CAST(item_author AS INTEGER) AS item_author,
       TRY_CAST(article_author AS INTEGER) AS article_author, CAST(topic AS DOUBLE) AS topic
FROM posts_base""")
def cast_block(spark, sf):
    p = A.posts_base(spark, sf).select("post_id", "year", "stock_code", "item_author",
                                       "article_author", "topic")
    return Rel.cast_columns(p, {"year": "string", "stock_code": "bigint", "item_author": "int",
                                "article_author": "int", "topic": "double"})


@query("map_values", """SELECT o_orderkey AS post_id,
  CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS INTEGER) AS sentiment
FROM orders""")
def map_values(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    labels = {"F": "Negative", "O": "Neutral", "P": "Positive"}
    m = Rel.map_values(o, "o_orderstatus", labels, out="sentiment_label")
    m = Rel.map_values(m, "sentiment_label", C.SENTIMENT_CODES, out="sentiment", default=-1)
    return m.select(F.col("o_orderkey").alias("post_id"), F.col("sentiment").cast("int"))


@query("normalize_source", """SELECT page_id, CASE WHEN length(url) > 40 THEN 'canonical-source'
  WHEN url = 'canonical-source■' THEN 'canonical-source' ELSE url END AS article_source FROM pages""")
def normalize_source(spark, sf):
    p = table(spark, sf, "pages", ["page_id", "url"])
    return Rel.normalize_source(p, "url", "canonical-source", C.SOURCE_MAX_LEN,
                                out="article_source").select("page_id", "article_source")


@query("categorize_source", """SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'tier-1'
  WHEN contains(source, 'src2') THEN 'tier-2' ELSE source END AS category FROM documents""")
def categorize_source(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "source"])
    return Rel.categorize_contains(d, "source", [("src1", "tier-1"), ("src2", "tier-2")],
                                   out="category").select("doc_id", "category")


@query("dropna_any", with_(TEXTS) + """SELECT post_id, article_source, industry, viral, year_month
FROM texts WHERE post_id IS NOT NULL AND article_source IS NOT NULL AND industry IS NOT NULL
  AND viral IS NOT NULL AND year_month IS NOT NULL""")
def dropna_any(spark, sf):
    t = A.texts(spark, sf).select("post_id", "article_source", "industry", "viral", "year_month")
    return Rel.drop_null_rows(t, "any")


@query("null_counts", with_(TEXTS) + """SELECT * FROM (
  SELECT 'post_id' AS column_name, CAST(count(*) - count(post_id) AS BIGINT) AS null_count FROM texts
  UNION ALL SELECT 'item_title', count(*) - count(item_title) FROM texts
  UNION ALL SELECT 'article_source', count(*) - count(article_source) FROM texts
  UNION ALL SELECT 'viral', count(*) - count(viral) FROM texts)""")
def null_counts(spark, sf):
    return Rel.null_counts(A.labelled_titles(spark, sf), ["post_id", "item_title", "article_source", "viral"])


@query("positives", with_(POSTS) + "SELECT post_id, item_author, popularity FROM posts WHERE viral = 1")
def positives(spark, sf):
    return Rel.positives(A.posts(spark, sf)).select("post_id", "item_author", "popularity")


@query("date_range", with_(POSTS) + """SELECT post_id, year_month FROM posts
WHERE year_month BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'""")
def date_range(spark, sf):
    rng = ("2000-01-01", "2000-06-30")
    # the range also reaches the orders scan as a pushed filter on the raw date
    return Rel.between_dates(A.posts_base(spark, sf, rng), "year_month", *rng).select("post_id", "year_month")


@query("enrich_industry", with_(IND, POSTS_BASE) + """SELECT post_id, b.stock_code,
  coalesce(IndustryCode1, 'others') AS IndustryCode1, coalesce(IndustryCode2, 'others') AS IndustryCode2
FROM posts_base b LEFT JOIN ind ON b.stock_code = ind.stock_code""")
def enrich_industry(spark, sf):
    return A.posts_base(spark, sf).select("post_id", "stock_code", "IndustryCode1", "IndustryCode2")


@query("enrich_multi", with_(POSTS_BASE) + """SELECT post_id, stock_code, n_nationkey, n_name
FROM posts_base JOIN nation ON n_regionkey = stock_code""")
def enrich_multi(spark, sf):
    p = A.posts_base(spark, sf).select("post_id", "stock_code")
    n = table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return Rel.enrich_multi(p, n, "stock_code", "n_regionkey").select(
        "post_id", "stock_code", "n_nationkey", "n_name")


@query("unmatched_keys", with_(IND, POSTS_BASE) + """SELECT CAST(count(DISTINCT b.stock_code) AS BIGINT)
  AS unmatched_keys FROM posts_base b WHERE b.stock_code IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM ind WHERE ind.stock_code = b.stock_code)""")
def unmatched_keys(spark, sf):
    o = table(spark, sf, "orders", ["o_custkey"])
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    stocks = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_nationkey").alias("stock_code"))
    return Rel.unmatched_keys(stocks, A.industry_dim(spark, sf), "stock_code")


@query("attach_position", """SELECT l.rn AS position, l.o_orderkey, r.c_custkey, r.c_name FROM
  (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) l
  LEFT JOIN (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) r
  ON l.rn = r.rn""")
def attach_position(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    c = table(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal"])
    j = Rel.attach_by_position(o, c, [("o_orderdate", True), ("o_orderkey", True)],
                               [("c_acctbal", False), ("c_custkey", True)])
    return j.select("position", "o_orderkey", "c_custkey", "c_name")


@query("monthly_counts", with_(POSTS_BASE) + """SELECT year, month, item_author, CAST(count(*) AS BIGINT) AS n
FROM posts_base GROUP BY year, month, item_author""")
def monthly_counts(spark, sf):
    return Rel.group_sizes(A.posts_base(spark, sf), ["year", "month", "item_author"])


@query("value_counts", """SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type""")
def value_counts(spark, sf):
    return Rel.value_counts(table(spark, sf, "events", ["event_type"]), "event_type")


_NUNIQUE_COLS = ["item_author", "article_author", "article_source", "stock_code", "IndustryCode1", "IndustryCode2"]


@query("feature_nunique", with_(POSTS) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(DISTINCT {c}) + 1 AS BIGINT) AS nunique FROM posts"
    for c in _NUNIQUE_COLS) + ")")
def feature_nunique(spark, sf):
    return Rel.feature_nunique(A.posts_base(spark, sf), _NUNIQUE_COLS)


@query("distinct_values", with_(POSTS) + "SELECT DISTINCT IndustryCode2 FROM posts")
def distinct_values(spark, sf):
    return Rel.distinct_values(A.posts_base(spark, sf), "IndustryCode2")


@query("dedupe_first", """SELECT c_nationkey, c_custkey, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
  FROM customer) WHERE rn = 1""")
def dedupe_first(spark, sf):
    c = table(spark, sf, "customer", ["c_nationkey", "c_custkey", "c_acctbal"])
    return Rel.dedupe_first(c, ["c_nationkey"], [("c_acctbal", False), "c_custkey"])


@query("dedupe_rows", with_(POSTS_BASE) + "SELECT DISTINCT item_author, article_author, article_source FROM posts_base")
def dedupe_rows(spark, sf):
    return Rel.dedupe_rows(A.posts_base(spark, sf).select("item_author", "article_author", "article_source"))


_DESC_NUM = ["popularity", "stock_code", "sentiment", "topic"]


@query("describe_numeric", with_(POSTS_BASE) + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,
      round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
      round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
      round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM posts_base"""
    for c in _DESC_NUM) + ")")
def describe_numeric(spark, sf):
    d = Rel.describe_numeric(A.posts_base(spark, sf), _DESC_NUM)
    return d.select("column_name", F.col("count").cast("bigint"),
                    *[F.round(c, 6).alias(c) for c in ["mean", "std", "p25", "p50", "p75"]], "min", "max")


_DESC_CAT = ["item_author", "article_author", "article_source", "IndustryCode2"]


@query("describe_categorical", with_(POSTS) + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(sum(f) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS unique,
      arg_min(v, (-f, v)) AS top, CAST(max(f) AS BIGINT) AS freq
    FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS f FROM posts WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in _DESC_CAT) + ")")
def describe_categorical(spark, sf):
    return Rel.describe_categorical(A.posts_base(spark, sf), _DESC_CAT)


@query("split_counts", with_(POSTS) + f"""SELECT split, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(CAST(viral = 1 AS BIGINT)) AS BIGINT) AS n_positive
FROM (SELECT *, {SPLIT_CASE} AS split FROM posts) WHERE split IS NOT NULL GROUP BY split""")
def split_counts(spark, sf):
    from ..operators.splits import chrono_split
    return Rel.split_counts(chrono_split(A.posts(spark, sf), "year_month", C.SPLITS))


@query("rank_within_month", with_(POSTS_BASE) + """SELECT b.post_id, b.year, b.month, b.item_author,
  r.item_author_rank FROM posts_base b LEFT JOIN (
    SELECT year, month, item_author,
      CAST(dense_rank() OVER (PARTITION BY year, month ORDER BY count(*) DESC) AS BIGINT) AS item_author_rank
    FROM posts_base WHERE item_author IS NOT NULL GROUP BY year, month, item_author) r
  ON b.year = r.year AND b.month = r.month AND b.item_author = r.item_author""")
def rank_within_month(spark, sf):
    p = A.posts_base(spark, sf).select("post_id", "year", "month", "item_author")
    return R.rank_within_month(p, "item_author").select("post_id", "year", "month", "item_author",
                                                        "item_author_rank")


def _rank_sql(col: str, lag: int, fill: bool) -> str:
    shift = f"make_date(year, month, 1) + INTERVAL {lag} MONTH"
    r = f"""(SELECT CAST(year({shift}) AS INTEGER) AS year, CAST(month({shift}) AS INTEGER) AS month, {col},
      CAST(dense_rank() OVER (PARTITION BY year, month ORDER BY count(*) DESC) AS BIGINT) AS rk
    FROM posts_base WHERE {col} IS NOT NULL GROUP BY year, month, {col})"""
    capped = f"least(r_{col}.rk, {C.MAX_RANK + 1})"
    if fill:
        capped = f"coalesce({capped}, {C.MAX_RANK + 1})"
    return (f"LEFT JOIN {r} r_{col} ON b.year = r_{col}.year AND b.month = r_{col}.month "
            f"AND b.{col} = r_{col}.{col}", f"CAST({capped} AS BIGINT) AS {col}_rank")


def _ranks_sql(lag: int, fill: bool) -> str:
    parts = [_rank_sql(c, lag, fill) for c in ("item_author", "article_author", "article_source")]
    return (with_(POSTS_BASE) + "SELECT b.post_id, " + ", ".join(p[1] for p in parts)
            + " FROM posts_base b " + " ".join(p[0] for p in parts))


def ranked_posts(spark, sf, lag: int = 0, base=None, stored: bool = False):
    src = base if base is not None else A.posts_base(spark, sf)
    p = src
    for c in ("item_author", "article_author", "article_source"):
        p = R.rank_within_month(p, c, lag_months=lag, source=src, stored=stored)
        p = R.cap_rank(p, f"{c}_rank", C.MAX_RANK, fill_missing=bool(lag))
    return p


@query("rank_capped", _ranks_sql(0, False))
def rank_capped(spark, sf):
    return ranked_posts(spark, sf).select("post_id", "item_author_rank", "article_author_rank",
                                          "article_source_rank")


@query("rank_prev_month", _ranks_sql(1, True))
def rank_prev_month(spark, sf):
    return ranked_posts(spark, sf, lag=1).select("post_id", "item_author_rank", "article_author_rank",
                                                 "article_source_rank")


@query("match_filter", with_(POSTS) + """SELECT post_id, item_author, article_source FROM posts
WHERE article_source = '1-URGENT' AND sentiment = 0 AND topic = 1 AND viral = 0""")
def match_filter(spark, sf):
    p = Rel.match_filter(A.posts(spark, sf), {"article_source": "1-URGENT", "sentiment": 0, "topic": 1})
    return p.select("post_id", "item_author", "article_source")


@query("crosstab", with_(SCORED) + """SELECT y, CAST(sum(CAST(pred = 0 AS BIGINT)) AS BIGINT) AS pred_0,
  CAST(sum(CAST(pred = 1 AS BIGINT)) AS BIGINT) AS pred_1 FROM scored GROUP BY y""")
def crosstab(spark, sf):
    """Wide confusion table."""
    c = M.crosstab(A.scored(spark, sf), "y", "pred", [0, 1])
    return c.select("y", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))


@query("sigmoid", with_(SCORED) + """SELECT post_id, round(1.0 / (1.0 + exp(-score)), 9) AS p,
  round(-ln(1.0 / (1.0 + exp(-score)) + 1e-10), 9) AS loss FROM scored""")
def sigmoid(spark, sf):
    """σ(score) and -log(σ(score) + ε)."""
    p = S.sigmoid("score")
    return A.scored(spark, sf).select("post_id", F.round(p, 9).alias("p"), F.round(-F.log(p + F.lit(1e-10)), 9).alias("loss"))
