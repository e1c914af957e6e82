"""Splits, rounds and matched negative sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import relational as Rel
from ..operators import sampling as S
from ..operators.splits import chrono_split, random_split, rounds_assignment, sample_n, take_split, union_all
from ..sources import adapters as A
from ..sources.tables import checkpointed
from .q_posts import POST_COLS
from .registry import query
from .sql import POSTS, SPLIT_CASE, h, with_

SEED = 7


def split_posts(spark, sf, names=None):
    """Posts labelled with their split; ``names`` limits the scan to the
    date range covering those splits (pushed to the Parquet reader)."""
    rng = None
    if names:
        spans = [(s, e) for n, s, e in C.SPLITS if n in names]
        rng = (min(s for s, _ in spans), max(e for _, e in spans))
    return chrono_split(A.posts(spark, sf, rng).select(*POST_COLS), "year_month", C.SPLITS)


def _split_sql(names):
    cond = " OR ".join(f"split = '{n}'" for n in names)
    return f"(SELECT * EXCLUDE (split) FROM (SELECT *, {SPLIT_CASE} AS split FROM posts) WHERE {cond})"


def _slot_sql(name, keys):
    kp = ", ".join(keys)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""slot_{name} AS (
  SELECT post_id AS neg_id, {kp},
         row_number() OVER (PARTITION BY {kp} ORDER BY _h % 1024, _h, post_id) - 1 AS _slot,
         count(*) OVER (PARTITION BY {kp}) AS _n
  FROM pool WHERE {nn}),
size_{name} AS (SELECT DISTINCT {kp}, _n FROM slot_{name})"""


def _draw_sql(name, keys, k, src):
    on_g = " AND ".join(f"p.{c} = g.{c}" for c in keys)
    on_s = " AND ".join(f"q.{c} = s.{c}" for c in keys)
    kp = ", ".join(f"p.{c}" for c in keys)
    t = f"""{h(f"'{SEED}|{name}|' || CAST(p.post_id AS VARCHAR) || '|' || CAST(x[1] AS VARCHAR)")} % (g._n - least({k}, g._n) + x[1])"""
    top = f"g._n - least({k}, g._n) + x[1] - 1"
    return f"""q_{name}_{src} AS (
  SELECT p.post_id AS pos_id, {kp}, unnest(list_reduce(
      list_transform(range(1, least({k}, g._n) + 1), lambda i: [i]),
      lambda acc, x: list_append(acc, CASE WHEN list_contains(acc, {t}) THEN {top} ELSE {t} END),
      CAST([] AS BIGINT[]))) AS _slot
  FROM {src} p JOIN size_{name} g ON {on_g}),
d_{name}_{src} AS (SELECT q.pos_id, s.neg_id FROM q_{name}_{src} q JOIN slot_{name} s ON {on_s} AND q._slot = s._slot)"""


def _pairs_output_sql():
    pcols = ", ".join(f"p.{c}" for c in POST_COLS)
    ncols = ", ".join(f"n.{c} AS neg_{c}" for c in POST_COLS)
    return f"SELECT {pcols}, {ncols} FROM pairs JOIN posts p ON p.post_id = pairs.pos_id JOIN posts n ON n.post_id = pairs.neg_id"


def _ladder_sql(data_splits, aux_splits, k=C.NEG_PER_POS_LADDER):
    keys3 = S.KEYS3
    on = " AND ".join(f"p.{c} = g.{c}" for c in keys3)
    ctes = [POSTS,
            f"data AS {_split_sql(data_splits)}",
            f"pool AS (SELECT *, {h(f"'{SEED}|' || CAST(post_id AS VARCHAR)")} AS _h FROM {_split_sql(data_splits + aux_splits)} WHERE viral = 0)",
            "pos AS (SELECT * FROM data WHERE viral = 1)",
            _slot_sql("k3", keys3), _slot_sql("src", ["article_source"]), _slot_sql("stock", ["stock_code"]),
            f"pos_n AS (SELECT p.*, coalesce(g._n, 0) AS _n1 FROM pos p LEFT JOIN size_k3 g ON {on})",
            f"rich AS (SELECT * FROM pos_n WHERE _n1 >= {k})",
            f"poor AS (SELECT * FROM pos_n WHERE _n1 < {k})",
            _draw_sql("k3", keys3, k, "rich"), _draw_sql("k3", keys3, k, "poor"),
            _draw_sql("src", ["article_source"], k, "poor"), _draw_sql("stock", ["stock_code"], k, "poor"),
            f"""pairs AS (
  SELECT pos_id, neg_id FROM d_k3_rich
  UNION ALL
  SELECT pos_id, neg_id FROM (
    SELECT pos_id, neg_id, row_number() OVER (PARTITION BY pos_id ORDER BY
           {h(f"'{SEED}|' || CAST(pos_id AS VARCHAR) || '|' || CAST(neg_id AS VARCHAR)")}, neg_id) AS r
    FROM (SELECT DISTINCT pos_id, neg_id FROM (
      SELECT * FROM d_k3_poor UNION ALL SELECT * FROM d_src_poor UNION ALL SELECT * FROM d_stock_poor)))
  WHERE r <= {k})"""]
    return with_(*ctes) + _pairs_output_sql()


def _ladder(spark, sf, data_splits, aux_splits):
    # the sampler reads its input several times (positives, and the pool per
    # key spec): materialise the covering date range once in the shared
    # checkpoint folder instead of re-deriving posts for every use
    sp = checkpointed(split_posts(spark, sf, list(data_splits) + list(aux_splits)))
    data = sp.filter(F.col("split").isin(*data_splits)).drop("split")
    aux = [sp.filter(F.col("split").isin(*aux_splits)).drop("split")] if aux_splits else None
    pairs = S.sample_negatives_ladder(data, aux, k=C.NEG_PER_POS_LADDER, seed=SEED)
    return pairs.select(*POST_COLS, *[f"neg_{c}" for c in POST_COLS])


@query("neg_sample_ladder", _ladder_sql(["train"], []))
def neg_sample_ladder(spark, sf):
    """Round 1 training pairs: positives of the train period, 3 matched negatives each."""
    return _ladder(spark, sf, ["train"], [])


@query("neg_sample_round2", _ladder_sql(["test1"], ["train", "valid"]))
def neg_sample_round2(spark, sf):
    """Round 2 training pairs: positives of test1, negatives also from earlier periods."""
    return _ladder(spark, sf, *_round(2, "train"))


def _round(r, role, strict_history=True):
    """(data splits, auxiliary splits) of a walk-forward round; without
    ``strict_history`` the pools are the original ones."""
    pools = C.ROUND_AUX if strict_history else C.ROUND_AUX_AS_ORIGINAL
    return [s for n, what, s in C.ROUNDS if (n, what) == (r, role)], pools[r, role]


@query("neg_sample_valid", _ladder_sql(*_round(1, "valid")))
def neg_sample_valid(spark, sf):
    """Validation pairs: positives of the validation period, negatives also from training."""
    return _ladder(spark, sf, *_round(1, "valid"))


@query("neg_sample_round3", _ladder_sql(*_round(3, "train")))
def neg_sample_round3(spark, sf):
    return _ladder(spark, sf, *_round(3, "train"))


@query("neg_sample_round4", _ladder_sql(*_round(4, "train")))
def neg_sample_round4(spark, sf):
    return _ladder(spark, sf, *_round(4, "train"))


@query("neg_sample_round4_original", _ladder_sql(*_round(4, "train", False)))
def neg_sample_round4_original(spark, sf):
    """Round 4 with the pool of the original study, which leaves test2 out."""
    return _ladder(spark, sf, *_round(4, "train", strict_history=False))


def _fallback_sql(k=C.NEG_PER_POS_FALLBACK):
    keys3 = S.KEYS3
    on = " AND ".join(f"p.{c} = g.{c}" for c in keys3)
    ctes = [POSTS,
            f"data AS {_split_sql(['train'])}",
            f"pool AS (SELECT *, {h(f"'{SEED}|' || CAST(post_id AS VARCHAR)")} AS _h FROM data WHERE viral = 0)",
            "pos AS (SELECT * FROM data WHERE viral = 1)",
            _slot_sql("k3", keys3), _slot_sql("stock", ["stock_code"]),
            f"with3 AS (SELECT p.* FROM pos p WHERE EXISTS (SELECT 1 FROM size_k3 g WHERE {on}))",
            f"without3 AS (SELECT p.* FROM pos p WHERE NOT EXISTS (SELECT 1 FROM size_k3 g WHERE {on}))",
            _draw_sql("k3", keys3, k, "with3"), _draw_sql("stock", ["stock_code"], k, "without3"),
            "pairs AS (SELECT * FROM d_k3_with3 UNION ALL SELECT * FROM d_stock_without3)"]
    return with_(*ctes) + _pairs_output_sql()


@query("neg_sample_fallback", _fallback_sql())
def neg_sample_fallback(spark, sf):
    data = checkpointed(take_split(split_posts(spark, sf, ["train"]), "train").drop("split"))
    pairs = S.sample_negatives_fallback(data, k=C.NEG_PER_POS_FALLBACK, seed=SEED)
    return pairs.select(*POST_COLS, *[f"neg_{c}" for c in POST_COLS])


@query("neg_sample_shortage", _ladder_sql(["train"], []).replace(
    _pairs_output_sql(), f"""SELECT CAST(count(*) AS BIGINT) AS n_positive,
  CAST(sum(CAST(m < {C.NEG_PER_POS_LADDER} AS BIGINT)) AS BIGINT) AS n_short,
  CAST(sum(CAST(m = 0 AS BIGINT)) AS BIGINT) AS n_none, CAST(sum(m) AS BIGINT) AS n_pairs
FROM (SELECT p.post_id, count(pairs.pos_id) AS m FROM pos p LEFT JOIN pairs ON pairs.pos_id = p.post_id
      GROUP BY p.post_id)"""))
def neg_sample_shortage(spark, sf):
    data = checkpointed(take_split(split_posts(spark, sf, ["train"]), "train").drop("split"))
    pos = Rel.positives(data)
    return S.shortage(S.ladder_pairs(pos, Rel.negatives(data), C.NEG_PER_POS_LADDER, SEED), pos, C.NEG_PER_POS_LADDER)


_MATCH_SQL = with_(POSTS, f"data AS {_split_sql(['train'])}") + """,
pos AS (SELECT * FROM data WHERE viral = 1), neg AS (SELECT * FROM data WHERE viral = 0),
c1 AS (SELECT item_author, article_author, article_source, count(*) AS c FROM neg GROUP BY ALL),
c21 AS (SELECT item_author, count(*) AS c FROM neg GROUP BY ALL),
c22 AS (SELECT article_author, count(*) AS c FROM neg GROUP BY ALL),
c23 AS (SELECT article_source, count(*) AS c FROM neg GROUP BY ALL),
c3 AS (SELECT stock_code, count(*) AS c FROM neg GROUP BY ALL),
m AS (
  SELECT p.post_id, CAST(coalesce(c1.c, 0) AS BIGINT) AS neg_count1,
         CAST(coalesce(c21.c, 0) AS BIGINT) AS neg_count21, CAST(coalesce(c22.c, 0) AS BIGINT) AS neg_count22,
         CAST(coalesce(c23.c, 0) AS BIGINT) AS neg_count23, CAST(coalesce(c3.c, 0) AS BIGINT) AS neg_count3
  FROM pos p
  LEFT JOIN c1 ON p.item_author = c1.item_author AND p.article_author = c1.article_author AND p.article_source = c1.article_source
  LEFT JOIN c21 ON p.item_author = c21.item_author LEFT JOIN c22 ON p.article_author = c22.article_author
  LEFT JOIN c23 ON p.article_source = c23.article_source LEFT JOIN c3 ON p.stock_code = c3.stock_code),
stats AS (SELECT post_id, neg_count1, neg_count21, neg_count22, neg_count23,
  neg_count21 + neg_count22 + neg_count23 AS neg_count2, neg_count3,
  neg_count1 + neg_count21 + neg_count22 + neg_count23 + neg_count3 AS total FROM m)
"""


@query("match_counts", _MATCH_SQL.replace("WITH ", "WITH ", 1) + "SELECT * FROM stats")
def match_counts(spark, sf):
    data = checkpointed(take_split(split_posts(spark, sf, ["train"]), "train").drop("split"))
    return S.match_statistics(data)


@query("match_summary", _MATCH_SQL + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS combo, round(avg(x), 6) AS mean, round(median(x), 6) AS median,
  CAST(sum(CAST(x = 0 AS BIGINT)) AS BIGINT) AS zeros FROM (SELECT CAST({' + '.join(cols)} AS DOUBLE) AS x FROM stats)"""
    for name, cols in S.SUMMARY_COMBOS) + ")")
def match_summary(spark, sf):
    data = checkpointed(take_split(split_posts(spark, sf, ["train"]), "train").drop("split"))
    s = S.summarize_counts(S.match_statistics(data))
    return s.select("combo", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "zeros")


# ---------------------------------------------------------------- G1-G5

@query("chrono_split", with_(POSTS) + f"""SELECT post_id, year_month, split FROM
  (SELECT post_id, year_month, {SPLIT_CASE} AS split FROM posts) WHERE split IS NOT NULL""")
def chrono_split_q(spark, sf):
    return chrono_split(A.posts_base(spark, sf).select("post_id", "year_month"), "year_month", C.SPLITS)


@query("union_splits", with_(POSTS) + f"""SELECT post_id, split FROM
  (SELECT post_id, {SPLIT_CASE} AS split FROM posts) WHERE split IN ('train', 'valid', 'test1')""")
def union_splits(spark, sf):
    sp = chrono_split(A.posts_base(spark, sf).select("post_id", "year_month"), "year_month", C.SPLITS)
    return union_all([take_split(sp, n) for n in ("train", "valid", "test1")]).select("post_id", "split")


def _rounds_rows():
    return [(r, role, s) for r, role, s in C.ROUNDS]


_ROUNDS_VALUES = ", ".join(f"({r}, '{role}', '{s}')" for r, role, s in C.ROUNDS)


@query("rounds_assignment", with_(POSTS) + f"""SELECT CAST(r.round AS INTEGER) AS round, r.role,
  CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(viral) AS BIGINT) AS n_positive
FROM (SELECT viral, {SPLIT_CASE} AS split FROM posts) p
JOIN (VALUES {_ROUNDS_VALUES}) r(round, role, split) ON p.split = r.split
GROUP BY r.round, r.role""")
def rounds_assignment_q(spark, sf):
    sp = split_posts(spark, sf)
    cfg = spark.createDataFrame(_rounds_rows(), "round INT, role STRING, split STRING")
    return (rounds_assignment(sp, cfg).groupBy("round", "role")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.sum("viral").cast("bigint").alias("n_positive")))


@query("random_split", with_(POSTS) + f"""SELECT post_id, CASE
    WHEN {h("'42|' || CAST(post_id AS VARCHAR)")} % 10000 < 8000 THEN 'train'
    WHEN {h("'42|' || CAST(post_id AS VARCHAR)")} % 10000 < 9000 THEN 'valid'
    ELSE 'test' END AS split FROM posts""")
def random_split_q(spark, sf):
    p = A.posts_base(spark, sf).select("post_id")
    return random_split(p, [8, 1, 1], 42, names=["train", "valid", "test"])


@query("sample_n", with_(POSTS) + f"""SELECT post_id, popularity FROM posts
ORDER BY {h("'1|' || CAST(post_id AS VARCHAR)")}, post_id LIMIT 20""")
def sample_n_q(spark, sf):
    return sample_n(A.posts_base(spark, sf).select("post_id", "popularity"), 20, 1)
