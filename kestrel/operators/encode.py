"""Feature encoding.

Dictionaries are built from the *distinct* values only and numbered with the
distributed global rank, so no step puts a whole column into one task; the
code table is then joined back (Catalyst/AQE choose broadcast or shuffle from
its size).  Statistics (mean, std) are fitted once as one aggregate row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import is_in_table
from ..sources.tables import checkpointed
from .ranking import global_row_number, top_categories


def _codes(df: DataFrame, col: str, order, base: int, order_col=None) -> DataFrame:
    """(value, code) for the distinct non-null values, numbered in ``order``."""
    if order_col is None:
        d = df.select(col).filter(F.col(col).isNotNull()).distinct()
    else:
        d = (df.filter(F.col(col).isNotNull()).groupBy(col)
               .agg(F.min(order_col).alias("_first")))
    ranked = global_row_number(d, order, "_rn")
    return ranked.select(col, (F.col("_rn") - 1 + base).cast("bigint").alias("_code"))


def factorize(df: DataFrame, col: str, order_col: str = "post_id", out: str | None = None) -> DataFrame:
    """Codes 0.. by first appearance in ``order_col`` order; null → -1."""
    out = out or f"{col}_index"
    codes = _codes(df, col, [("_first", True)], 0, order_col)
    return (df.join(codes, col, "left")
              .withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("bigint")).drop("_code"))


def factorize_many(df: DataFrame, cols: dict, order_col: str = "post_id",
                   source: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """J1 for several columns at once: {column: output name}.  One stacked
    (feature, value, first position) table is numbered by a single
    distributed sort, so k columns cost one ranking job instead of k.
    ``source`` (default ``df``) is the table the dictionaries are built from;
    ``stored`` writes them before they are joined."""
    stacked = (source if source is not None else df).select(F.col(order_col), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_s"))
    firsts = (stacked.filter(F.col("_s.value").isNotNull())
                     .groupBy(F.col("_s.feature").alias("feature"), F.col("_s.value").alias("value"))
                     .agg(F.min(order_col).alias("_first")))
    ranked = global_row_number(firsts, [("feature", True), ("_first", True)], "_rn")
    base = ranked.groupBy("feature").agg(F.min("_rn").alias("_base"))  # one row per feature
    codes = ranked.join(F.broadcast(base), "feature").select(
        "feature", "value", (F.col("_rn") - F.col("_base")).cast("bigint").alias("_code"))
    codes = checkpointed(codes) if stored else codes
    out = df
    for c, name in cols.items():
        d = codes.filter(F.col("feature") == c).select(F.col("value").alias(f"_v_{c}"), F.col("_code").alias(name))
        out = (out.join(d, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
                  .withColumn(name, F.coalesce(F.col(name), F.lit(-1)).cast("bigint")))
    return out


def category_code(df: DataFrame, col: str, out: str | None = None, plus_one: bool = True,
                  null_code: int = 0) -> DataFrame:
    """J2 (plus_one) / J3: codes by sorted value (1.. or 0..); null → ``null_code``."""
    out = out or f"{col}_code"
    codes = _codes(df, col, [(col, True)], 1 if plus_one else 0)
    return (df.join(codes, col, "left")
              .withColumn(out, F.coalesce(F.col("_code"), F.lit(null_code)).cast("bigint")).drop("_code"))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Sorted value → 0..n-1 (null → -1)."""
    return category_code(df, col, out or f"{col}_label", plus_one=False, null_code=-1)


def fit_label_encoder(train: DataFrame, col: str) -> DataFrame:
    """Q15: the dictionary is fitted on the training rows only."""
    return _codes(train, col, [(col, True)], 0)


def apply_label_encoder(df: DataFrame, codes: DataFrame, col: str, out: str | None = None,
                        unseen: int = -1) -> DataFrame:
    out = out or f"{col}_label"
    return (df.join(codes, col, "left")
              .withColumn(out, F.coalesce(F.col("_code"), F.lit(unseen)).cast("bigint")).drop("_code"))


def one_hot(df: DataFrame, col: str, levels: list | None = None) -> DataFrame:
    """One 0/1 column per level (dense form).  Levels become columns, so the
    level list is schema, read from the data when not given; for a column with
    many levels use :func:`one_hot_vector`."""
    if levels is None:
        levels = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).collect()]
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{col}_{v}") for v in levels])


def one_hot_vector(df: DataFrame, index_col: str, out: str):
    """J4 sparse form for models: ``OneHotEncoder(dropLast=False)``."""
    from pyspark.ml.feature import OneHotEncoder
    return OneHotEncoder(inputCols=[index_col], outputCols=[out], dropLast=False).fit(df).transform(df)


def fit_zscore(df: DataFrame, col: str) -> tuple[float, float]:
    """Mean and population standard deviation (one aggregate row)."""
    r = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).first()
    return r["m"], r["s"]


def zscore(df: DataFrame, col: str, out: str | None = None, stats: tuple | None = None) -> DataFrame:
    """(x - mean) / population std (a constant column gives null)."""
    m, s = stats or fit_zscore(df, col)
    if m is None or not s:
        return df.withColumn(out or f"{col}_z", F.lit(None).cast("double"))
    return df.withColumn(out or f"{col}_z", (F.col(col) - F.lit(m)) / F.lit(s))


def class_weights(df: DataFrame, label: str, count: str | None = None) -> DataFrame:
    """Balanced weights n / (classes · n_c), one row per class; a row stands for ``count`` rows if that is named."""
    from pyspark.sql import Window
    counts = df.groupBy(label).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n_c"))
    every = Window.partitionBy()  # over the per-class table: one row per class
    return counts.select(label, F.col("n_c").cast("bigint"),
                         (F.sum("n_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_c")))
                         .alias("weight"))


def reduce_to_top_n(df: DataFrame, col: str, n: int = 10, other: str = "Others",
                    out: str | None = None) -> DataFrame:
    """Keep the n most frequent values (ties by value), others and nulls → ``other``.
    The top table has at most n rows, so broadcasting it is bounded."""
    top = top_categories(df, col, n).select(F.col(col).alias("_top"))
    j = is_in_table(df, col, F.broadcast(top), "_top", "_kept")
    return j.withColumn(out or f"{col}_reduced", F.when(F.col("_kept"), F.col(col)).otherwise(F.lit(other))).drop("_kept")
