"""Ranking, ordering and top-k operators plus the distributed
global rank (SURVEY 4.3).

A window without ``partitionBy`` sends every row to one task, so ranks over a
whole table are computed here with a range-partitioned sort instead:

1. ``repartitionByRange`` on the full sort order (always ending in a unique
   key, so hot values of the leading column still spread over partitions),
   ``sortWithinPartitions``, and a per-partition row index taken from
   ``monotonically_increasing_id`` (partition id in the high bits).
2. one small aggregate: rows per partition (at most ``num_partitions`` rows
   reach the driver);
3. offsets joined back as a broadcast table whose size is bounded by the
   partition count.

Range bounds are sampled once per shuffle dependency and the sort is a total
order, so a recomputed partition (lost executor) gets the same indices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

Order = list  # list of (column name, ascending) tuples


def sort_exprs(order: Order) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def before_or_at(order: Order, row) -> Column:
    """Predicate: the row sorts at or before ``row`` (a dict/Row) in ``order``.

    Columns of the order must be non-null.
    """
    pred = None
    for c, asc in reversed(order):
        v = row[c]
        strict = (F.col(c) < F.lit(v)) if asc else (F.col(c) > F.lit(v))
        eq = F.col(c) == F.lit(v)
        if pred is None:
            pred = strict | eq
        else:
            pred = strict | (eq & pred)
    return pred


@dataclass
class RangeRanked:
    frame: DataFrame          # input + _pid, _idx (stored in the shared folder)
    offsets: list             # [(pid, rows before pid, rows in pid)]
    total: int

    def locate(self, k: int):
        """Partition and in-partition index of the k-th row (1-based)."""
        for pid, before, cnt in self.offsets:
            if before < k <= before + cnt:
                return pid, k - before - 1
        return None


def range_ranked(df: DataFrame, order: Order, num_partitions: int | None = None) -> RangeRanked:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid = F.spark_partition_id()
    framed = (df.repartitionByRange(n, *sort_exprs(order))
                .sortWithinPartitions(*sort_exprs(order))
                .withColumn("_pid", pid)
                .withColumn("_idx", F.monotonically_increasing_id()
                            - F.shiftleft(pid.cast("bigint"), 33)))
    framed = checkpointed(framed)
    counts = sorted((r["_pid"], r["count"]) for r in framed.groupBy("_pid").count().collect())
    offsets, run = [], 0
    for p, c in counts:
        offsets.append((p, run, c))
        run += c
    return RangeRanked(framed, offsets, run)


def global_row_number(df: DataFrame, order: Order, out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole table in ``order`` without a
    single-partition window. ``order`` must be a total order (end with a key)."""
    rr = range_ranked(df, order, num_partitions)
    spark = df.sparkSession
    off = spark.createDataFrame([(p, b) for p, b, _ in rr.offsets] or [(0, 0)],
                                "_opid INT, _obefore BIGINT")
    # bounded broadcast: one row per shuffle partition
    j = rr.frame.join(F.broadcast(off), F.col("_pid") == F.col("_opid"))
    return j.select(*[F.col(c) for c in df.columns],
                    (F.col("_obefore") + F.col("_idx") + 1).alias(out))


def _kth_row_ranked(df: DataFrame, order: Order, k: int, offset: int = 0):
    cols = [c for c, _ in order]
    rr = range_ranked(df.select(*cols), order)
    loc = rr.locate(k - offset)
    if loc is None:
        return None
    pid, idx = loc
    row = rr.frame.filter((F.col("_pid") == pid) & (F.col("_idx") == idx)).select(*cols).first()
    return row.asDict()


def kth_row(df: DataFrame, order: Order, k_of_n, eps: float = 0.002) -> tuple:
    """Return (row, n, k): the k-th row (1-based) of ``df`` in ``order`` where
    ``k = k_of_n(n)``; row is None when k is outside 1..n.

    Distributed selection, the same way at every size: one aggregate pass gives a
    grid of approximate quantiles of the leading (numeric) column, a second counts
    the rows before a value band around quantile k/n and inside it, and only the
    band (≈ 2·eps·n rows) is sorted by the full order.  If the approximation misses, the band widens, ending with
    the whole table, so the answer is always exact.
    """
    from pyspark.sql.types import NumericType
    cols = [c for c, _ in order]
    lead, asc = order[0]
    base = df.select(*cols)
    numeric = isinstance(df.schema[lead].dataType, NumericType)
    n = base.count()
    k = int(k_of_n(n))
    if k < 1 or k > n:
        return None, n, k
    if not numeric:  # no quantiles of strings or dates: sort them all
        return _kth_row_ranked(base, order, k), n, k
    grid = [i / 1000 for i in range(1001)]
    q = base.agg(F.percentile_approx(lead, grid, 100000).alias("q")).first()["q"]
    x = F.col(lead)
    while True:
        p = k / n if asc else 1.0 - k / n
        lo_i, hi_i = int(max(0.0, p - eps) * 1000), min(1000, int((p + eps) * 1000) + 1)
        if lo_i <= 0 and hi_i >= 1000:
            return _kth_row_ranked(base, order, k), n, k
        lo_v = q[lo_i] if lo_i > 0 else None
        hi_v = q[hi_i] if hi_i < 1000 else None
        in_band = F.lit(True)
        if lo_v is not None:
            in_band = in_band & (x >= F.lit(lo_v))
        if hi_v is not None:
            in_band = in_band & (x <= F.lit(hi_v))
        if asc:
            before = (x < F.lit(lo_v)) if lo_v is not None else F.lit(False)
        else:
            before = (x > F.lit(hi_v)) if hi_v is not None else F.lit(False)
        c = base.agg(F.sum(before.cast("long")).alias("b"), F.sum(in_band.cast("long")).alias("m")).first()
        b, m = c["b"] or 0, c["m"] or 0
        if b < k <= b + m:
            return _kth_row_ranked(base.filter(in_band), order, k, offset=b), n, k
        eps *= 8


# ---------------------------------------------------------------- E1 / E2

def rank_within_month(df: DataFrame, col: str, lag_months: int = 0,
                      year: str = "year", month: str = "month",
                      out: str | None = None, source: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Dense rank of ``col`` by number of rows inside each (year, month), most
    rows first, merged back on (col, year, month).

    ``lag_months=0`` ranks inside the same month; ``lag_months=1`` attaches the
    previous month's rank (unseen values get null).  Null values of ``col``
    are not counted and get a null rank.  The window runs over the per-month
    aggregate, never over the fact table.  ``source`` (default ``df``) is
    the table counted, so several ranks can be attached without each
    recounting the previous joins.  ``stored`` writes the rank table before it is joined.
    """
    out = out or f"{col}_rank"
    counts = ((source if source is not None else df).filter(F.col(col).isNotNull())
                .groupBy(year, month, col).agg(F.count(F.lit(1)).alias("_n")))
    # the rank depends on the count alone: rank each month's distinct counts, join back
    w = Window.partitionBy(year, month).orderBy(F.col("_n").desc())
    places = counts.select(year, month, "_n").distinct().select(
        year, month, "_n", F.row_number().over(w).cast("bigint").alias(out))
    ranked = counts.join(places, [year, month, "_n"]).select(year, month, col, out)
    if lag_months:
        shifted = F.add_months(F.make_date(F.col(year), F.col(month), F.lit(1)), lag_months)
        ranked = ranked.select(F.year(shifted).alias(year), F.month(shifted).alias(month), col, out)
    return df.join(checkpointed(ranked) if stored else ranked, [col, year, month], "left")


def cap_rank(df: DataFrame, rank_col: str, max_rank: int = 10, fill_missing: bool = False) -> DataFrame:
    """Ranks above ``max_rank`` become ``max_rank + 1``; with ``fill_missing``
    a null rank (value unseen in the ranked month) also becomes ``max_rank + 1``."""
    # ``least`` skips nulls, so a missing rank is handled explicitly
    capped = F.when(F.col(rank_col).isNotNull(), F.least(F.col(rank_col), F.lit(max_rank + 1)))
    if fill_missing:
        capped = F.coalesce(capped, F.lit(max_rank + 1))
    return df.withColumn(rank_col, capped.cast("bigint"))


# ---------------------------------------------------------------- E3

def top_categories(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent non-null values (ties by value). Output is bounded by n."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(col).asc()).limit(n))


# ---------------------------------------------------------------- E6 / E7

def label_top_fraction(df: DataFrame, score: str, fraction: float = 0.01,
                       key: str = "post_id", out: str = "pred") -> DataFrame:
    """Mark rows whose score is at least the score found at 0-based position
    ``int(n * fraction)`` of the descending sort (so at least that many plus
    one rows, with ties, are 1)."""
    row, n, k = kth_row(df, [(score, False), (key, True)], lambda n: int(n * fraction) + 1)
    if row is None:
        return df.withColumn(out, F.lit(0).cast("int"))
    return df.withColumn(out, (F.col(score) >= F.lit(row[score])).cast("int"))


# ---------------------------------------------------------------- E8 / D15

def argmax_position(values: list[Column]) -> Column:
    """0-based index of the largest value; the first one wins ties."""
    arr = F.array(*values)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def dominant_topic(df: DataFrame, cols: list[str], out: str = "dominant_topic") -> DataFrame:
    """Index (taken from the digits of the winning column's name) of the
    largest of ``cols``; the first column wins ties."""
    digits = [int("".join(ch for ch in c if ch.isdigit()) or i) for i, c in enumerate(cols)]
    pos = argmax_position([F.col(c).cast("double") for c in cols])
    expr = F.element_at(F.array(*[F.lit(d) for d in digits]), pos + 1)
    return df.withColumn(out, expr.cast("int"))
