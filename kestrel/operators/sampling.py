"""Matched negative sampling (S1, S2) and candidate statistics.

Group-slot sampling, no positive × group blow-up:

1. Slot the pool per key spec.  Every negative gets a dense position
   ``slot`` in 0..n-1 inside its key group, in the order of a seeded md5
   hash.  The ranking window is partitioned by (key, hash bucket), so a hot
   key (a source holding a third of all rows) is spread over ``buckets``
   tasks; bucket offsets come from a per-(key, bucket) count table whose
   window is bounded by ``buckets`` rows per key.
2. Each positive looks up its group size n (join with the (key, n) table).
3. It draws a uniform subset of m = min(k, n) slots by Floyd's algorithm in m
   hashed draws: distinct, without replacement, deterministic.
4. An equi-join on (key, slot) turns slots into negatives' ids.  Work is
   O(P·k + N), on ids and keys alone; the columns of both sides are joined once
   at the end.
5. Ladder rule (S1): positives with n1 >= k keep their k 3-key draws; the
   others take the union of all 3-key candidates and up to k per fallback
   spec, deduplicated, then the k first by a per-pair hash.  The pool is slotted
   once for the 3-key draws; the fallback specs slot only the groups that the
   others ask for.  Fallback rule
   (S2): the 3-key spec if it has candidates, else the stock spec.

Every random choice is a hash of (seed, ids), so the result does not depend
on partitioning, retries or lost executors, and has an exact SQL twin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SUMMARY_COMBOS
from ..functions.hashing import hash_int
from ..sources.tables import checkpointed
from .relational import join_counts, negatives, positives, sum_columns

KEYS3 = ["item_author", "article_author", "article_source"]
LADDER_SPECS = [("k3", KEYS3), ("src", ["article_source"]), ("stock", ["stock_code"])]


def _not_null(keys):
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def slot_pool(pool: DataFrame, keys: list[str], seed: int, id_col: str = "post_id",
              buckets: int = 1024, prefix: str = "neg_"):
    """Return (slotted, sizes).

    ``slotted``: pool columns prefixed with ``prefix`` plus the bare key
    columns and ``_slot``; ``sizes``: (keys, ``_n``) per key group.
    Ring order inside a group: (bucket, hash, id), bucket = hash mod buckets.
    """
    cols = pool.columns
    h = hash_int(F.lit(seed), F.col(id_col))
    p = (pool.filter(_not_null(keys))
             .select(*[F.col(c).alias(prefix + c) for c in cols],
                     *[F.col(k).alias(f"_k_{k}") for k in keys],
                     h.alias("_h"))
             .withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets))))
    kcols = [f"_k_{k}" for k in keys]
    w = Window.partitionBy(*kcols, "_b").orderBy("_h", prefix + id_col)
    ranked = p.withColumn("_r", F.row_number().over(w) - 1)
    # counted from the ranked rows: already clustered by (key, bucket), so the
    # aggregate needs no new shuffle and the window's exchange is reused
    bcount = ranked.groupBy(*kcols, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*kcols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bcount = bcount.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    slotted = (ranked.join(bcount.select(*kcols, "_b", "_off"), kcols + ["_b"])
                     .withColumn("_slot", F.col("_off") + F.col("_r"))
                     .drop("_h", "_b", "_r", "_off"))
    sizes = bcount.groupBy(*kcols).agg(F.sum("_c").alias("_n"))
    for k in keys:
        slotted = slotted.withColumnRenamed(f"_k_{k}", k)
        sizes = sizes.withColumnRenamed(f"_k_{k}", k)
    return slotted, sizes


def floyd(n, m, draw_hash) -> Column:
    """A uniform m-subset of 0..n-1 as an array, in m draws (Floyd's algorithm):
    draw i takes a position t in 0..j with j = n - m + i - 1, or j if t is taken.
    ``draw_hash(i)`` is the random integer of draw i."""
    def take(acc, i):
        top = n - m + i - 1
        t = F.pmod(draw_hash(i), top + 1)
        return F.array_append(acc, F.when(F.array_contains(acc, t), top).otherwise(t))
    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), m), F.array().cast("array<bigint>"), take)


def draw(pos: DataFrame, slotted: DataFrame, sizes: DataFrame, keys: list[str], spec: str,
         k: int, seed: int, id_col: str = "post_id") -> DataFrame:
    """(id, neg id): a uniform subset of min(k, n) slots of its key group for each
    positive of ``pos`` (which carries the key columns and ``id_col``)."""
    q = pos.join(sizes, keys, "inner").withColumn("_m", F.least(F.lit(k).cast("bigint"), F.col("_n")))
    slots = floyd(F.col("_n"), F.col("_m"), lambda i: hash_int(F.lit(seed), F.lit(spec), F.col(id_col), i))
    q = q.select(id_col, *keys, F.explode(slots).alias("_slot"))
    return q.join(slotted, keys + ["_slot"], "inner").select(id_col, "neg_" + id_col)


def _pool(data: DataFrame, aux: list[DataFrame] | None, label: str) -> DataFrame:
    frames = [data] + list(aux or [])
    pool = reduce(lambda a, b: a.unionByName(b), frames)
    return negatives(pool, label)


def ladder_pairs(pos: DataFrame, pool: DataFrame, k: int = 3, seed: int = 7, id_col: str = "post_id",
                 buckets: int = 1024) -> DataFrame:
    """S1 as (id, neg id): only ids and keys are slotted, drawn and shuffled."""
    specs = dict(LADDER_SPECS)
    keys = sorted({c for ks in specs.values() for c in ks})
    pos, pool = pos.select(id_col, *keys), pool.select(id_col, *keys)
    n1 = pool.filter(_not_null(KEYS3)).groupBy(*KEYS3).agg(F.count(F.lit(1)).alias("_n1"))
    pos_n = checkpointed(pos.join(n1, KEYS3, "left").withColumn("_n1", F.coalesce(F.col("_n1"), F.lit(0))))
    rich = pos_n.filter(F.col("_n1") >= k).drop("_n1")
    poor = pos_n.filter(F.col("_n1") < k).drop("_n1")
    # positives with enough 3-key candidates: k draws from that group
    direct = draw(rich, *slot_pool(pool, KEYS3, seed, id_col, buckets), KEYS3, "k3", k, seed, id_col)
    if poor.isEmpty():
        return direct
    # the rest: all 3-key candidates (fewer than k) and up to k per fallback spec, then the k first by pair hash.
    # A group's slots depend on its own rows alone: only groups that these positives ask for are slotted
    cand = poor.join(pool.select(*KEYS3, F.col(id_col).alias("neg_" + id_col)), KEYS3).select(id_col, "neg_" + id_col)
    for name, ks in LADDER_SPECS[1:]:
        asked = pool.join(poor.select(*ks).distinct(), ks, "left_semi").select(*pool.columns)
        cand = cand.unionByName(draw(poor, *slot_pool(asked, ks, seed, id_col, buckets), ks, name, k, seed, id_col))
    neg_id = "neg_" + id_col
    w = Window.partitionBy(id_col).orderBy(hash_int(F.lit(seed), F.col(id_col), F.col(neg_id)), F.col(neg_id))
    picked = cand.distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    return direct.unionByName(picked)


def fallback_pairs(pos: DataFrame, pool: DataFrame, k: int = 10, seed: int = 7, id_col: str = "post_id",
                   buckets: int = 1024) -> DataFrame:
    """S2 as (id, neg id)."""
    pos, pool = (d.select(id_col, *KEYS3, "stock_code") for d in (pos, pool))
    s3, n3 = slot_pool(pool, KEYS3, seed, id_col, buckets)
    ss, ns = slot_pool(pool, ["stock_code"], seed, id_col, buckets)
    with3 = pos.join(n3.select(*KEYS3), KEYS3, "left_semi")
    without = pos.join(n3.select(*KEYS3), KEYS3, "left_anti")
    return draw(with3, s3, n3, KEYS3, "k3", k, seed, id_col).unionByName(
        draw(without, ss, ns, ["stock_code"], "stock", k, seed, id_col))


def pair_rows(pairs: DataFrame, pos: DataFrame, pool: DataFrame, id_col: str = "post_id") -> DataFrame:
    """The columns of both sides, joined once to the drawn id pairs."""
    neg = pool.select(*[F.col(c).alias("neg_" + c) for c in pool.columns])
    return pairs.join(pos, id_col).join(neg, "neg_" + id_col)


def sample_negatives_ladder(data: DataFrame, aux: list[DataFrame] | None = None, k: int = 3,
                            seed: int = 7, id_col: str = "post_id", label: str = "viral",
                            buckets: int = 1024) -> DataFrame:
    """S1. Positives of ``data``; pool = negatives of ``data`` ∪ ``aux``.
    Output: positive columns + ``neg_``-prefixed negative columns, at most k
    rows per positive (fewer only when all three specs together have fewer)."""
    pos, pool = data.filter(F.col(label) == 1), _pool(data, aux, label)
    return pair_rows(ladder_pairs(pos, pool, k, seed, id_col, buckets), pos, pool, id_col)


def sample_negatives_fallback(data: DataFrame, aux: list[DataFrame] | None = None, k: int = 10,
                              seed: int = 7, id_col: str = "post_id", label: str = "viral",
                              buckets: int = 1024) -> DataFrame:
    """S2. Negatives sharing the three keys if there are any, else sharing
    the stock code; positives with neither are skipped; at most k each."""
    pos, pool = data.filter(F.col(label) == 1), _pool(data, aux, label)
    return pair_rows(fallback_pairs(pos, pool, k, seed, id_col, buckets), pos, pool, id_col)


def shortage(pairs: DataFrame, positives: DataFrame, k: int, id_col: str = "post_id") -> DataFrame:
    """Positives, and how many got fewer than k negatives or none."""
    got = pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_m"))
    j = positives.select(id_col).join(got, id_col, "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n_positive"),
                 F.sum((F.col("_m") < k).cast("bigint")).cast("bigint").alias("n_short"),
                 F.sum((F.col("_m") == 0).cast("bigint")).cast("bigint").alias("n_none"),
                 F.sum("_m").cast("bigint").alias("n_pairs"))


# ---------------------------------------------------------------- D9 / D10

MATCH_SPECS = [("neg_count1", KEYS3), ("neg_count21", ["item_author"]),
               ("neg_count22", ["article_author"]), ("neg_count23", ["article_source"]),
               ("neg_count3", ["stock_code"])]


def match_statistics(data: DataFrame, id_col: str = "post_id", label: str = "viral") -> DataFrame:
    """Per positive, the number of negatives sharing the 3 keys, each key
    alone (and their sum), the stock code, and the total.  Counts are
    pre-aggregated per key (map-side partial aggregation) and joined back."""
    out, neg = positives(data, label), negatives(data, label)
    for name, keys in MATCH_SPECS:
        counts = neg.filter(_not_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        out = join_counts(out, counts, keys, name)
    out = out.withColumn("neg_count2", sum_columns(["neg_count21", "neg_count22", "neg_count23"]))
    out = out.withColumn("total", sum_columns(["neg_count1", "neg_count2", "neg_count3"]))
    return out.select(id_col, "neg_count1", "neg_count21", "neg_count22", "neg_count23",
                      "neg_count2", "neg_count3", "total")


def summarize_counts(stats: DataFrame, combos=SUMMARY_COMBOS) -> DataFrame:
    """Mean, median and number of zeros of each count (or sum of two)."""
    exprs = ", ".join(f"'{name}', CAST({' + '.join(cols)} AS DOUBLE)" for name, cols in combos)
    long = stats.select(F.expr(f"stack({len(combos)}, {exprs}) AS (combo, x)"))
    return long.groupBy("combo").agg(F.avg("x").alias("mean"), F.median("x").alias("median"),
                                     F.sum((F.col("x") == 0).cast("bigint")).cast("bigint").alias("zeros"))
