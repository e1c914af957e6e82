"""Projections, filters, joins and aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- 2.2


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """B1."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """B2."""
    return df.drop(*cols)


def prefix_columns(df: DataFrame, prefix: str, cols: list[str] | None = None) -> DataFrame:
    """Rename every (or the listed) column to ``prefix + name``; names are stripped."""
    cols = cols or df.columns
    return df.select(*[F.col(f"`{c}`").alias(prefix + c.strip()) for c in cols])


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """ANSI-safe casts (malformed values become null, never an error)."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS {types[c]})").alias(c) if c in types else F.col(c)
                       for c in df.columns])


def map_values(df: DataFrame, col: str, mapping: dict, out: str | None = None, default=None) -> DataFrame:
    """Dictionary lookup; values outside the mapping get ``default``."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    expr = F.coalesce(m[F.col(col)], F.lit(default)) if default is not None else m[F.col(col)]
    return df.withColumn(out or col, expr)


def normalize_source(df: DataFrame, col: str, canonical: str, max_len: int = 40,
                     marker: str = "■", out: str | None = None) -> DataFrame:
    """Values longer than ``max_len`` characters, and the canonical value
    followed by ``marker``, become the canonical value."""
    c = F.col(col)
    expr = (F.when(F.length(c) > max_len, F.lit(canonical))
             .when(c == F.lit(canonical + marker), F.lit(canonical))
             .otherwise(c))
    return df.withColumn(out or col, expr)


def categorize_contains(df: DataFrame, col: str, rules: list[tuple[str, str]],
                        out: str | None = None) -> DataFrame:
    """The label of the first needle contained in the value, else the value."""
    expr = None
    for needle, label in rules:
        cond = F.col(col).contains(needle)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = F.col(col) if expr is None else expr.otherwise(F.col(col))
    return df.withColumn(out or col, expr)


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    """Typed fill per column."""
    return df.na.fill(values)


def drop_null_rows(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """B9."""
    return df.na.drop(how=how, subset=subset)


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column with its null count (one aggregate pass)."""
    cols = cols or df.columns
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.select(F.expr(f"stack({len(cols)}, {stack}) AS (column_name, null_count)"))


def positives(df: DataFrame, label: str = "viral") -> DataFrame:
    """B11."""
    return df.filter(F.col(label) == 1)


def negatives(df: DataFrame, label: str = "viral") -> DataFrame:
    return df.filter(F.col(label) == 0)


def match_filter(df: DataFrame, values: dict, label: str | None = "viral", label_value=0) -> DataFrame:
    """Conjunction of equalities (and the label)."""
    conds = [F.col(c) == F.lit(v) for c, v in values.items()]
    if label:
        conds.append(F.col(label) == F.lit(label_value))
    return df.filter(reduce(lambda a, b: a & b, conds))


def between_dates(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    """Inclusive on both ends."""
    return df.filter(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def is_in_table(df: DataFrame, col: str, values: DataFrame, value_col: str, out: str = "is_in") -> DataFrame:
    """Membership against a table (a join, not a collected list)."""
    v = dedupe_rows(values.select(F.col(value_col).alias("_v"))).withColumn("_hit", F.lit(True))
    return (df.join(v, F.col(col) == F.col("_v"), "left")
              .withColumn(out, F.coalesce(F.col("_hit"), F.lit(False))).drop("_v", "_hit"))


def flag_contains(df: DataFrame, col: str, needles: dict[str, str]) -> DataFrame:
    """One 0/1 column per needle."""
    return df.select("*", *[F.col(col).contains(n).cast("int").alias(name) for name, n in needles.items()])


def sum_columns(cols: list[str]) -> Column:
    """Row-wise sum."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


# ---------------------------------------------------------------- 2.3


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per key in a stated order (deterministic
    ``dropDuplicates``): a grouped minimum of (order, row), combined map-side, so
    a key with very many rows is no task of its own.  ``order``: column names
    (ascending) or (name, ascending) pairs; descending columns are numeric."""
    lead = []
    for o in order:
        name, asc = (o, True) if isinstance(o, str) else o
        lead += [F.col(name)] if asc else [F.col(name).isNull(), -F.col(name)]
    first = F.struct(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(lead)]).alias("_order"),
                     F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    return df.groupBy(*keys).agg(F.min(first).alias("_first")).select("_first._row.*")


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Full-row dedupe."""
    return df.distinct()


def enrich_left(df: DataFrame, dim: DataFrame, on: str, fill: dict | None = None,
                dim_order: list | None = None, small_dim: bool = False) -> DataFrame:
    """Dedupe the dimension on its key (first row in ``dim_order``), left
    join, fill unmatched columns.  ``small_dim`` forces a broadcast only when
    the caller knows the dimension's size bound; otherwise Catalyst/AQE pick
    the strategy from statistics."""
    order = dim_order or [c for c in dim.columns if c != on]
    d = dedupe_first(dim, [on], order)
    if small_dim:
        d = F.broadcast(d)
    out = df.join(d, on, "left")
    return fill_nulls(out, fill) if fill else out


def enrich_multi(df: DataFrame, dim: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Left join allowing many matches, then drop rows left unmatched
    (equal to an inner join when the dimension's columns are non-null)."""
    j = df.join(dim, F.col(left_on) == F.col(right_on), "left")
    return j.na.drop(how="any", subset=[c for c in dim.columns])


def join_counts(df: DataFrame, counts: DataFrame, on: list[str], count_col: str) -> DataFrame:
    """Left join of group counts, unmatched → 0."""
    return df.join(counts, on, "left").withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("bigint"))


def unmatched_keys(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Number of distinct non-null keys of ``df`` absent from the dimension."""
    miss = df.select(on).filter(F.col(on).isNotNull()).join(dim.select(on), on, "left_anti")
    return miss.agg(F.countDistinct(on).cast("bigint").alias("unmatched_keys"))


def attach_by_position(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Put rows side by side by their position in a stated order on each
    side (distributed row numbers, then an equi-join on the position).  Every
    left row stays; a shorter right side leaves nulls."""
    from .ranking import global_row_number
    l = global_row_number(left, left_order, "_pos")
    r = global_row_number(right, right_order, "_pos")
    return l.join(r, "_pos", "left").withColumnRenamed("_pos", "position")


# ---------------------------------------------------------------- 2.4


def group_sizes(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """D1."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(out))


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Counts per value, most frequent first (ties by value)."""
    return group_sizes(df, [col], out).orderBy(F.col(out).desc(), F.col(col).asc())


def feature_nunique(df: DataFrame, cols: list[str]) -> DataFrame:
    """D3: exact distinct count + 1 per feature."""
    agg = df.agg(*[(F.countDistinct(c) + 1).cast("bigint").alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.select(F.expr(f"stack({len(cols)}, {stack}) AS (feature, nunique)"))


def feature_cardinality(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Max + 1 per feature with its role (embedding-table sizes)."""
    cols = list(roles)
    agg = df.agg(*[(F.max(c) + 1).cast("bigint").alias(c) for c in cols])
    stack = ", ".join(f"'{c}', '{roles[c]}', `{c}`" for c in cols)
    return agg.select(F.expr(f"stack({len(cols)}, {stack}) AS (feature, role, cardinality)"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """D5."""
    return df.select(col).distinct()


def split_counts(df: DataFrame, split: str = "split", label: str = "viral") -> DataFrame:
    """Rows and positives per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                 F.sum((F.col(label) == 1).cast("bigint")).cast("bigint").alias("n_positive"))


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict:
    """{column: [value at each q]} with linear interpolation between order
    statistics (as ``quantile_cont``), computed without holding any column
    in one task: all columns are stacked and range-sorted once, and only the
    order statistics at the needed positions (two per quantile and column)
    reach the driver."""
    import math
    from .ranking import range_ranked
    # _t only spreads equal values over partitions; which of them comes first does not show
    stacked = df.withColumn("_t", F.monotonically_increasing_id()).select("_t", F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(cols)]))
        .alias("_s")).select("_s._c", "_s._x", "_t").filter(F.col("_x").isNotNull())
    counts = {r["_c"]: r["n"] for r in stacked.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}
    rr = range_ranked(stacked, [("_c", True), ("_x", True), ("_t", True)])
    start, wanted = 0, {}
    plan = {}
    for i in range(len(cols)):
        n = counts.get(i, 0)
        plan[i] = []
        for q in qs:
            if n == 0:
                plan[i].append(None)
                continue
            h = (n - 1) * q
            lo, hi = math.floor(h), math.ceil(h)
            plan[i].append((start + lo + 1, start + hi + 1, h - lo))
            wanted[start + lo + 1] = wanted[start + hi + 1] = None
        start += n
    locs = {k: rr.locate(k) for k in wanted}
    cond = F.lit(False)
    for pid, idx in set(locs.values()):
        cond = cond | ((F.col("_pid") == pid) & (F.col("_idx") == idx))
    got = {(r["_pid"], r["_idx"]): r["_x"] for r in rr.frame.filter(cond).select("_pid", "_idx", "_x").collect()}
    out = {}
    for i, c in enumerate(cols):
        vals = []
        for item in plan[i]:
            if item is None:
                vals.append(None)
                continue
            a, b, frac = item
            lo_v, hi_v = got[locs[a]], got[locs[b]]
            vals.append(lo_v + frac * (hi_v - lo_v))
        out[c] = vals
    return out


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """D7 (numeric part): count, mean, std (sample), min, quartiles (linear
    interpolation, exact), max — one row per column.  Moments come from one
    aggregate pass; quartiles from :func:`exact_quantiles` (no per-column
    value map in a single task)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    m = df.agg(*aggs).first()
    qv = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, m[f"{c}__count"], m[f"{c}__mean"], m[f"{c}__std"], m[f"{c}__min"], *qv[c], m[f"{c}__max"])
            for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column_name STRING, count BIGINT, mean DOUBLE, std DOUBLE, min DOUBLE, "
              "p25 DOUBLE, p50 DOUBLE, p75 DOUBLE, max DOUBLE")


def describe_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """D7 (categorical part): count, unique, top (most frequent; ties by the
    smallest value), freq — one row per column, from per-value counts."""
    parts = []
    for c in cols:
        counts = (df.select(F.col(c).cast("string").alias("v")).filter(F.col("v").isNotNull())
                    .groupBy("v").agg(F.count(F.lit(1)).alias("f")))
        best = F.min(F.struct((-F.col("f")).alias("nf"), F.col("v").alias("v")))
        parts.append(counts.agg(F.sum("f").cast("bigint").alias("count"),
                                F.count(F.lit(1)).cast("bigint").alias("unique"),
                                best.alias("_b"))
                     .select(F.lit(c).alias("column_name"), "count", "unique",
                             F.col("_b.v").alias("top"), (-F.col("_b.nf")).cast("bigint").alias("freq")))
    return reduce(DataFrame.unionByName, parts)


def histogram(df: DataFrame, col: str, lo: float = -1.0, hi: float = 1.0, nbins: int = 200) -> DataFrame:
    """Fixed-width bins over [lo, hi]; the last bin is closed on the
    right, values outside are dropped; empty bins appear with 0."""
    spark = df.sparkSession
    w = (hi - lo) / nbins
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(nbins - 1)).cast("int")
    counts = (df.filter((x >= lo) & (x <= hi)).select(b.alias("bin"))
                .groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    bins = spark.range(nbins).select(F.col("id").cast("int").alias("bin"))
    return (bins.join(counts, "bin", "left")
                .select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("lo"),
                        (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("hi"),
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of (row, col) with one column per listed value, 0 when absent."""
    p = df.groupBy(row).pivot(col, values).count()
    return p.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(str(v)) for v in values])
