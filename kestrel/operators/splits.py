"""Set operations, splits and seeded sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """G1: union by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def split_label(col: str, ranges: list[tuple[str, str, str]]):
    """The name of the first inclusive date range containing ``col`` (null if none)."""
    expr = None
    for name, start, end in ranges:
        cond = F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def chrono_split(df: DataFrame, col: str, ranges: list[tuple[str, str, str]],
                 out: str = "split", keep_unassigned: bool = False) -> DataFrame:
    """One pass labels every row with its named inclusive range.  Write
    the result ``partitionBy(out)`` to get partition pruning per split."""
    r = df.withColumn(out, split_label(col, ranges))
    return r if keep_unassigned else r.filter(F.col(out).isNotNull())


def take_split(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    return df.filter(F.col(col) == name)


def rounds_assignment(df: DataFrame, rounds_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows of each split joined to the (round, role) entries that use it.
    ``rounds_df`` is the small configuration table (round, role, split)."""
    return df.join(F.broadcast(rounds_df), split_col, "inner")


def random_split(df: DataFrame, weights: list[float], seed: int, id_col: str = "post_id",
                 names: list[str] | None = None, out: str = "split") -> DataFrame:
    """Seeded split by a hash of (seed, id) into 10,000 buckets — stable
    under repartitioning and retries (``randomSplit`` is not); sizes are
    approximate."""
    names = names or [f"part{i}" for i in range(len(weights))]
    total = float(sum(weights))
    bucket = F.pmod(hash_int(F.lit(seed), F.col(id_col)), F.lit(10000))
    expr, acc = None, 0.0
    for i, (w, nm) in enumerate(zip(weights, names)):
        acc += w / total
        hi = 10000 if i == len(weights) - 1 else int(round(acc * 10000))
        cond = bucket < hi
        expr = F.when(cond, F.lit(nm)) if expr is None else expr.when(cond, F.lit(nm))
    return df.withColumn(out, expr)


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "post_id") -> DataFrame:
    """``n`` rows chosen by the order of a seeded hash (top-n is the feature)."""
    return (df.withColumn("_h", hash_int(F.lit(seed), F.col(id_col)))
              .orderBy("_h", id_col).limit(n).drop("_h"))
