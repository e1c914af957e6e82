"""Operator 10, mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate (target share of the result divided by
its rows).  A document's count is the inverse Poisson distribution function of
its source's rate at a uniform number hashed from (seed, id, draw); rates above
`max_mean` are the sum of several draws of a smaller mean, so that exp(-mean)
never underflows.  The document is exploded by its count and all copies are
shuffled globally: hash-partitioned by a hash of (seed, id, copy) and sorted by
it inside each partition.  md5 is the hash, so any SQL engine gets the same.

The rate table has one row per source and is joined like any dimension
(broadcast only under Spark's size check, else shuffled with skew splitting).

Defined cases: null is a source of its own; null id is hashed as ''; rows that
repeat an id get equal counts, copies numbered from 0 each; a source without a
given weight gets weight 0 (all rows go); an empty table gives no rows; input
columns named like the output columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, private, read

SEED = "mix-1"
ALPHA = 0.5  # default target weight of a source: rows ** ALPHA
MAX_MEAN = 16.0


def _digest(*parts: Column) -> Column:
    """First 13 hex digits (52 bits) of md5 of the parts, as long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of counts 0.. up to where they reach 1 in double
    arithmetic (mean + 12 sqrt(mean) + 24)."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    zero = F.exp(-mean)

    def step(acc, k):
        return let(acc["p"] * mean / k, lambda p: F.struct(
            p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["cdf"], acc["c"] + p).alias("cdf")))

    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def source_rates(df: DataFrame, source_col: str, weights: dict | None = None, alpha: float = ALPHA,
                 target_rows: float | None = None) -> DataFrame:
    """(source, rows, rate): rate is the mean number of copies of each row."""
    n = df.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        w = F.pow(F.col("rows").cast("double"), F.lit(alpha))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
    n = n.withColumn("weight", w)
    # the one-row-per-source table gives two numbers to the driver
    total = n.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows")).first()
    n = n.withColumns({c: F.lit(total[c]).cast("double") for c in ("all_weight", "all_rows")})
    goal = F.lit(float(target_rows)) if target_rows is not None else F.col("all_rows").cast("double")
    rate = F.when(F.col("all_weight") > 0, goal * F.col("weight") / F.col("all_weight") / F.col("rows")).otherwise(0.0)
    return n.select("source", "rows", rate.alias("rate"))


def mix_sources(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None,
                alpha: float = ALPHA, target_rows: float | None = None, seed: str = SEED) -> DataFrame:
    """Copies of df's rows with columns copy (from 0) and shuffle_key."""
    df = df.drop(*[c for c in ("copy", "shuffle_key") if c not in (source_col, id_col)])
    src, cdf, draws, n = private(df, "src", "cdf", "draws", "n")
    rates = source_rates(df, source_col, weights, alpha, target_rows)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_MEAN))).cast("int")
    rates = rates.select(F.col("source").alias(src), parts.alias(draws),
                         poisson_table(F.col("rate") / parts).alias(cdf))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))

    def drawn(k):
        u = _digest(F.lit(seed), ident, k.cast("string")) / F.lit(float(1 << 52))
        return let(u, lambda x: F.size(F.filter(cdf, lambda c: c <= x)))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(draws)), drawn), F.lit(0), lambda a, x: a + x)
    out = df.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(src))).withColumn(n, count).where(F.col(n) > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    out = out.withColumn("shuffle_key", _digest(F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string")))
    return out.drop(src, cdf, draws, n).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key")


SQL_OP10 = r"""
WITH RECURSIVE n AS (
  SELECT source, count(*) AS n_rows, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, CAST((SELECT sum(n_rows) FROM n) AS DOUBLE) * weight / (SELECT sum(weight) FROM n) / n_rows AS rate FROM n),
means AS (
  SELECT source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS draws FROM rates),
cdf AS (
  SELECT source, rate / draws AS mean, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c FROM means
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf
  WHERE k < ceil(mean + 12 * sqrt(mean) + 24)),
uniform AS (
  SELECT doc_id, documents.source AS source, CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || d), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, row_id, d
  FROM (SELECT *, row_number() OVER () AS row_id FROM documents) documents
  JOIN means ON documents.source IS NOT DISTINCT FROM means.source, unnest(range(1, draws + 1)) AS t(d)),
counts AS (
  SELECT row_id, any_value(doc_id) AS doc_id, any_value(uniform.source) AS source, CAST(sum(below) AS BIGINT) AS n
  FROM (SELECT row_id, d, any_value(doc_id) AS doc_id, any_value(uniform.source) AS source, count(cdf.k) AS below
        FROM uniform LEFT JOIN cdf ON uniform.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= uniform.u
        GROUP BY row_id, d) uniform
  GROUP BY row_id)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('mix-1|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM counts, unnest(range(0, n)) AS t(copy)
"""
