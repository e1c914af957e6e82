"""Adapters from the driver's tables to the analytic data model.

``posts``   orders ⋈ customer ⋈ industry dimension (nation, region)
``titles``  documents; ``labelled_titles`` adds labels, ``texts`` the order's date
``scored``  posts with a deterministic pseudo-score and top-1 % labels
``vectors`` embeddings

All of them are lazy plans over the given tables; only the virality
threshold (one row) and the score threshold (one value) are computed
eagerly by a distributed range sort.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SENTIMENT_CODES, TOP_FRACTION
from ..functions.hashing import TWO_60, hash_int
from ..operators.ranking import before_or_at, kth_row, label_top_fraction
from ..operators.relational import enrich_left
from .tables import table

VIRAL_FRACTION = 0.05
VIRAL_ORDER = [("popularity", False), ("post_id", True)]


def industry_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_code → (IndustryCode1, IndustryCode2); nations of region 4 are left
    out so that some stocks are unmatched and become 'others'."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.filter(F.col("n_regionkey") < 4)
             .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.col("n_nationkey").alias("stock_code"),
                     F.col("r_name").alias("IndustryCode1"),
                     F.col("n_name").alias("IndustryCode2")))


def month_range_bounds(start: str, end: str) -> tuple[str, str]:
    """[lo, hi) on the raw date such that first-of-month(date) lies in [start, end]."""
    s, e = date.fromisoformat(start), date.fromisoformat(end)
    lo = s if s.day == 1 else (date(s.year + (s.month == 12), s.month % 12 + 1, 1))
    hi = date(e.year + (e.month == 12), e.month % 12 + 1, 1)
    return lo.isoformat(), hi.isoformat()


def posts_base(spark: SparkSession, sf_dir: str, date_range: tuple[str, str] | None = None) -> DataFrame:
    """Posts without the label: one row per order.  ``date_range`` (inclusive,
    on the first-of-month date) is applied as a range on the raw order date,
    so it reaches the Parquet scan as a pushed filter."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                        "o_totalprice", "o_orderdate", "o_orderpriority"])
    if date_range:
        lo, hi = month_range_bounds(*date_range)
        o = o.filter((F.col("o_orderdate") >= F.lit(lo).cast("timestamp_ntz"))
                     & (F.col("o_orderdate") < F.lit(hi).cast("timestamp_ntz")))
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    d = F.to_date(F.col("o_orderdate"))
    status = F.col("o_orderstatus")
    sentiment_label = (F.when(status == "F", "Negative").when(status == "O", "Neutral")
                        .when(status == "P", "Positive"))
    codes = F.create_map(*[x for k, v in SENTIMENT_CODES.items() for x in (F.lit(k), F.lit(v))])
    p = (o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
          .select(F.col("o_orderkey").alias("post_id"),
                  (F.col("o_custkey") % 200).cast("string").alias("item_author"),
                  F.col("c_mktsegment").alias("article_author"),
                  F.col("o_orderpriority").alias("article_source"),
                  F.col("c_nationkey").alias("stock_code"),
                  F.year(d).alias("year"), F.month(d).alias("month"),
                  F.make_date(F.year(d), F.month(d), F.lit(1)).alias("year_month"),
                  (status == "F").cast("int").alias("robo_site"),
                  (status == "O").cast("int").alias("robo_media"),
                  (status == "P").cast("int").alias("robo_sma"),
                  sentiment_label.alias("sentiment_label"),
                  codes[sentiment_label].cast("int").alias("sentiment"),
                  (F.col("o_custkey") % 3).cast("int").alias("topic"),
                  F.col("o_totalprice").alias("popularity")))
    # the industry dimension has 25 rows at any scale: a bounded broadcast
    return enrich_left(p, industry_dim(spark, sf_dir), "stock_code",
                       fill={"IndustryCode1": "others", "IndustryCode2": "others"}, small_dim=True)


def viral_threshold(spark: SparkSession, sf_dir: str):
    """The last (popularity, post_id) inside the first 5 % of all orders."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).select(
        F.col("o_orderkey").alias("post_id"), F.col("o_totalprice").alias("popularity"))
    row, n, k = kth_row(o, VIRAL_ORDER, lambda n: int(n * VIRAL_FRACTION))
    return row


def posts(spark: SparkSession, sf_dir: str, date_range: tuple[str, str] | None = None) -> DataFrame:
    """Posts with ``viral`` = 1 for the first 5 % of *all* orders by
    (popularity desc, post_id); the label is a predicate against one
    threshold row, so a date range still prunes the scan."""
    base = posts_base(spark, sf_dir, date_range)
    row = viral_threshold(spark, sf_dir)
    if row is None:
        return base.withColumn("viral", F.lit(0).cast("int"))
    return base.withColumn("viral", before_or_at(VIRAL_ORDER, row).cast("int"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline texts alone (documents): what needs neither date nor label reads
    nothing else."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return docs.select(F.col("doc_id").alias("post_id"), F.col("text").alias("item_title"),
                       F.col("source").alias("article_source"), F.col("lang").alias("industry"))


def labelled_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline texts with their quality label (null when unlabelled)."""
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    lab = lab.select(F.col("doc_id").alias("post_id"), F.col("quality").alias("viral"))
    return titles(spark, sf_dir).join(lab, "post_id", "left")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled headline texts dated by the order with the same key (null
    dates where there is none): every document stays."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    d = F.to_date(F.col("o_orderdate"))
    return (labelled_titles(spark, sf_dir).join(o, F.col("post_id") == F.col("o_orderkey"), "left")
            .select("post_id", "item_title", "article_source", "industry", "viral",
                    F.year(d).alias("year"), F.month(d).alias("month"),
                    F.make_date(F.year(d), F.month(d), F.lit(1)).alias("year_month")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, y, score, pred: a deterministic score with some signal, and
    the top-1 % labels of it."""
    # only the key and the label are needed: built from orders alone
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).select(
        F.col("o_orderkey").alias("post_id"), F.col("o_totalprice").alias("popularity"))
    row = viral_threshold(spark, sf_dir)
    viral = before_or_at(VIRAL_ORDER, row).cast("int") if row is not None else F.lit(0)
    p = o.select("post_id", viral.alias("y"))
    s = p.withColumn("score", hash_int(F.lit("s"), F.col("post_id")) / F.lit(TWO_60)
                     + F.lit(0.3) * F.col("y"))
    return label_top_fraction(s, "score", TOP_FRACTION, key="post_id", out="pred")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("embedding"), F.col("label"))
