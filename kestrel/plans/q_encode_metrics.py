"""Encoding and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .. import config as C
from ..operators import encode as E
from ..operators import metrics as M
from ..sources import adapters as A
from ..sources.tables import checkpointed, table
from .registry import query
from .sql import POSTS, SCORED, with_


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (results are compared at 1e-6)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


FACTOR_COLS = [("item_author", "item_author_index"), ("article_author", "article_author_index"),
               ("article_source", "article_source_index"), ("stock_code", "stock_code_index"),
               ("IndustryCode1", "ind_code1_index"), ("IndustryCode2", "ind_code2_index")]


def factorized_posts(spark, sf, base=None):
    p = base if base is not None else A.posts(spark, sf)
    return E.factorize_many(p, dict(FACTOR_COLS), "post_id")


def posts_features(spark, sf, stored: bool = False):
    """Feature table: posts + capped monthly ranks + first-seen codes.  Rank
    and code tables are aggregates of the plain posts plan, joined back once;
    ``stored`` writes the posts first, so that these do not derive them again, and the
    rank and code tables, whose known size decides about the joins before posts are shuffled."""
    from .q_posts import ranked_posts
    p = checkpointed(A.posts(spark, sf)) if stored else A.posts(spark, sf)
    return E.factorize_many(ranked_posts(spark, sf, 0, base=p, stored=stored), dict(FACTOR_COLS), "post_id", source=p, stored=stored)


_FACT_SQL = with_(POSTS) + "SELECT p.post_id, " + ", ".join(
    f"CAST(coalesce(d{i}.code, -1) AS BIGINT) AS {out}" for i, (_, out) in enumerate(FACTOR_COLS)) + \
    " FROM posts p " + " ".join(
    f"""LEFT JOIN (SELECT {c}, row_number() OVER (ORDER BY min(post_id)) - 1 AS code FROM posts
        WHERE {c} IS NOT NULL GROUP BY {c}) d{i} ON p.{c} = d{i}.{c}""" for i, (c, _) in enumerate(FACTOR_COLS))


@query("factorize", _FACT_SQL)
def factorize_q(spark, sf):
    return factorized_posts(spark, sf, A.posts_base(spark, sf)).select(
        "post_id", *[o for _, o in FACTOR_COLS])


@query("category_code", with_(POSTS) + """SELECT p.post_id, CAST(coalesce(d.code, 0) AS BIGINT) AS item_author_code
FROM posts p LEFT JOIN (SELECT item_author, row_number() OVER (ORDER BY item_author) AS code
  FROM (SELECT DISTINCT item_author FROM posts WHERE item_author IS NOT NULL)) d ON p.item_author = d.item_author""")
def category_code_q(spark, sf):
    return E.category_code(A.posts_base(spark, sf), "item_author").select("post_id", "item_author_code")


@query("label_encode", with_(POSTS) + """SELECT p.post_id, CAST(coalesce(d.code, -1) AS BIGINT) AS article_source_label
FROM posts p LEFT JOIN (SELECT article_source, row_number() OVER (ORDER BY article_source) - 1 AS code
  FROM (SELECT DISTINCT article_source FROM posts WHERE article_source IS NOT NULL)) d
  ON p.article_source = d.article_source""")
def label_encode_q(spark, sf):
    return E.label_encode(A.posts_base(spark, sf), "article_source").select("post_id", "article_source_label")


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", with_(POSTS) + "SELECT post_id, " + ", ".join(
    f"CAST(article_source = '{v}' AS INTEGER) AS \"article_source_{v}\"" for v in _LEVELS) + " FROM posts")
def one_hot_q(spark, sf):
    p = A.posts_base(spark, sf).select("post_id", "article_source")
    return E.one_hot(p, "article_source").drop("article_source")


@query("zscore", with_(POSTS) + """SELECT post_id, round((popularity - avg(popularity) OVER ())
  / stddev_pop(popularity) OVER (), 6) AS popularity_z FROM posts""")
def zscore_q(spark, sf):
    p = A.posts_base(spark, sf).select("post_id", "popularity")
    return rounded(E.zscore(p, "popularity").drop("popularity"))


@query("class_weights", with_(POSTS) + """SELECT viral, CAST(count(*) AS BIGINT) AS n_c,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM posts GROUP BY viral""")
def class_weights_q(spark, sf):
    return rounded(E.class_weights(A.posts(spark, sf), "viral"))


@query("reduce_top_n", with_(POSTS) + """SELECT p.post_id, CASE WHEN t.item_author IS NOT NULL
  THEN p.item_author ELSE 'Others' END AS item_author_reduced
FROM posts p LEFT JOIN (SELECT item_author FROM posts WHERE item_author IS NOT NULL GROUP BY item_author
  ORDER BY count(*) DESC, item_author LIMIT 10) t ON p.item_author = t.item_author""")
def reduce_top_n_q(spark, sf):
    p = A.posts_base(spark, sf).select("post_id", "item_author")
    return E.reduce_to_top_n(p, "item_author", C.TOP_N).select("post_id", "item_author_reduced")


def _card_sql():
    ranks = []
    for c in ("item_author", "article_author", "article_source"):
        ranks.append(f"""SELECT '{c}_rank' AS feature, 'author' AS role,
      CAST(least(max(rk), {C.MAX_RANK + 1}) + 1 AS BIGINT) AS cardinality FROM (
      SELECT dense_rank() OVER (PARTITION BY year, month ORDER BY count(*) DESC) AS rk
      FROM posts WHERE {c} IS NOT NULL GROUP BY year, month, {c})""")
    plain = [("month", "post", "max(month) + 1"), ("ind_code1_index", "post", "count(DISTINCT IndustryCode1)"),
             ("ind_code2_index", "post", "count(DISTINCT IndustryCode2)"), ("sentiment", "post", "max(sentiment) + 1"),
             ("topic", "post", "max(topic) + 1"), ("robo_site", "author", "max(robo_site) + 1"),
             ("robo_media", "author", "max(robo_media) + 1"), ("robo_sma", "author", "max(robo_sma) + 1")]
    parts = [f"SELECT '{f}' AS feature, '{r}' AS role, CAST({e} AS BIGINT) AS cardinality FROM posts"
             for f, r, e in plain] + ranks
    return with_(POSTS) + "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@query("feature_cardinality", _card_sql())
def feature_cardinality_q(spark, sf):
    from ..operators.relational import feature_cardinality
    return feature_cardinality(posts_features(spark, sf), C.FEATURE_ROLES)


# ---------------------------------------------------------------- metrics


@query("accuracy", with_(SCORED) + "SELECT round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy FROM scored")
def accuracy_q(spark, sf):
    return rounded(M.accuracy(A.scored(spark, sf)))


_PRF = """SELECT round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (
  SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
    SELECT sum(CAST(y = 1 AND pred = 1 AS DOUBLE)) AS tp, sum(CAST(y <> 1 AND pred = 1 AS DOUBLE)) AS fp,
           sum(CAST(y = 1 AND pred <> 1 AS DOUBLE)) AS fn FROM scored))"""


@query("prf_binary", with_(SCORED) + _PRF)
def prf_binary_q(spark, sf):
    return rounded(M.prf_binary(A.scored(spark, sf)))


@query("confusion_matrix", with_(SCORED) + """SELECT y AS y_true, pred AS y_pred, CAST(count(*) AS BIGINT) AS n
FROM scored GROUP BY y, pred""")
def confusion_matrix_q(spark, sf):
    return M.confusion_matrix(A.scored(spark, sf))


@query("classification_report", with_(SCORED) + """, pc AS (
  SELECT label, sum(t) AS support, sum(q) AS predicted, sum(tp) AS tp FROM (
    SELECT CAST(y AS VARCHAR) AS label, 1 AS t, 0 AS q, CAST(y = pred AS INTEGER) AS tp FROM scored
    UNION ALL SELECT CAST(pred AS VARCHAR), 0, 1, 0 FROM scored) GROUP BY label),
cls AS (SELECT label, CASE WHEN predicted <> 0 THEN tp / predicted ELSE 0.0 END AS precision,
  CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM pc),
cls2 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0.0 END AS f1 FROM cls)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM cls2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM cls2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM cls2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM cls2""")
def classification_report_q(spark, sf):
    return rounded(M.classification_report(A.scored(spark, sf)))


def _reg(spark, sf):
    li = table(spark, sf, "lineitem", ["l_extendedprice", "l_quantity"])
    return li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


_REG = """(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"""


@query("r2", f"""SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
  CAST(count(*) AS BIGINT) AS n FROM {_REG}""")
def r2_q(spark, sf):
    return rounded(M.r2(_reg(spark, sf), "y", "p"))


@query("adj_r2", f"""SELECT round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2 - 1), 6) AS adj_r2 FROM (
  SELECT 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, count(*) AS n FROM {_REG})""")
def adj_r2_q(spark, sf):
    return rounded(M.adj_r2(_reg(spark, sf), "y", "p", 2))


@query("mse", f"""SELECT round(avg((y - p) * (y - p)), 6) AS mse, round(sum((y - p) * (y - p)), 6) AS sse FROM {_REG}""")
def mse_q(spark, sf):
    return rounded(M.mse(_reg(spark, sf), "y", "p"))


@query("log_loss", with_(SCORED) + """SELECT round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss
FROM (SELECT y, least(greatest(score / 1.3, 1e-15), 1 - 1e-15) AS q FROM scored)""")
def log_loss_q(spark, sf):
    s = A.scored(spark, sf).withColumn("prob", F.col("score") / F.lit(1.3))
    return rounded(M.log_loss(s, "y", "prob"))


@query("outcome_code", with_(SCORED) + """SELECT post_id, CAST(CASE WHEN y = 1 AND pred = 1 THEN 2
  WHEN y = 0 AND pred = 0 THEN 0 WHEN y = 1 AND pred = 0 THEN -1 WHEN y = 0 AND pred = 1 THEN 1 END AS INTEGER)
  AS outcome FROM scored""")
def outcome_code_q(spark, sf):
    return M.outcome_code(A.scored(spark, sf)).select("post_id", "outcome")


@query("label_top_fraction", with_(SCORED) + "SELECT post_id, round(score, 6) AS score, pred FROM scored")
def label_top_fraction_q(spark, sf):
    return rounded(A.scored(spark, sf).select("post_id", "score", "pred"))


@query("label_viral", with_(POSTS) + "SELECT post_id, viral FROM posts")
def label_viral_q(spark, sf):
    return A.posts(spark, sf).select("post_id", "viral")


def _ndcg_sql(k):
    cut = {None: "n", 10: "10", 0.05: "CAST(floor(0.05 * n) AS BIGINT)"}[k]
    return with_(SCORED) + f""", nn AS (SELECT count(*) AS n FROM scored),
c AS (SELECT {cut} AS cut FROM nn),
pr AS (SELECT y, row_number() OVER (ORDER BY score DESC, post_id) AS rn FROM scored),
id AS (SELECT y, row_number() OVER (ORDER BY y DESC, post_id) AS rn FROM scored),
d AS (SELECT coalesce(sum((pow(2, y) - 1) / log2(rn + 1)), 0) AS v FROM pr, c WHERE rn <= cut),
i AS (SELECT coalesce(sum((pow(2, y) - 1) / log2(rn + 1)), 0) AS v FROM id, c WHERE rn <= cut)
SELECT round(CASE WHEN i.v > 0 THEN d.v / i.v ELSE 0.0 END, 6) AS ndcg, CAST(c.cut AS BIGINT) AS k FROM d, i, c"""


def _ndcg(spark, sf, k):
    return rounded(M.ndcg(A.scored(spark, sf), "y", "score", k))


@query("ndcg_at_10", _ndcg_sql(10))
def ndcg_at_10(spark, sf):
    return _ndcg(spark, sf, 10)


@query("ndcg_at_5pct", _ndcg_sql(0.05))
def ndcg_at_5pct(spark, sf):
    return _ndcg(spark, sf, 0.05)


@query("ndcg_all", _ndcg_sql(None))
def ndcg_all(spark, sf):
    return _ndcg(spark, sf, None)


def _ndcg_ties_sql(k):
    cut = "n" if k is None else str(k)
    return with_(SCORED) + f""", nn AS (SELECT count(*) AS n FROM scored),
c AS (SELECT {cut} AS cut FROM nn),
m AS (SELECT pred, avg(y) AS my FROM scored GROUP BY pred),
pr AS (SELECT pred, row_number() OVER (ORDER BY pred DESC, post_id) AS rn FROM scored),
id AS (SELECT y, row_number() OVER (ORDER BY y DESC, post_id) AS rn FROM scored),
d AS (SELECT coalesce(sum(m.my / log2(rn + 1)), 0) AS v FROM pr JOIN m ON pr.pred = m.pred, c WHERE rn <= cut),
i AS (SELECT coalesce(sum(y / log2(rn + 1)), 0) AS v FROM id, c WHERE rn <= cut)
SELECT round(CASE WHEN i.v > 0 THEN d.v / i.v ELSE 0.0 END, 6) AS ndcg, CAST(c.cut AS BIGINT) AS k FROM d, i, c"""


@query("ndcg_ties", _ndcg_ties_sql(None))
def ndcg_ties(spark, sf):
    return rounded(M.ndcg_tie_averaged(A.scored(spark, sf), "y", "pred", None))


@query("ndcg_ties_at_10", _ndcg_ties_sql(10))
def ndcg_ties_at_10(spark, sf):
    return rounded(M.ndcg_tie_averaged(A.scored(spark, sf), "y", "pred", 10))


# ---------------------------------------------------------------- pairwise loss on sampled pairs

def _bpr_sql():
    from .q_sampling import _ladder_sql, _pairs_output_sql
    base = _ladder_sql(["train"], [])
    return base.replace(_pairs_output_sql(), """SELECT round(avg(l), 6) AS mean_loss, round(sum(l), 6) AS sum_loss,
  CAST(count(*) AS BIGINT) AS n_pairs FROM (
  SELECT CASE WHEN d >= 0 THEN ln(1 + exp(-d)) ELSE -d + ln(1 + exp(d)) END AS l FROM (
    SELECT (p.popularity - n.popularity) / 100000.0 AS d FROM pairs
    JOIN posts p ON p.post_id = pairs.pos_id JOIN posts n ON n.post_id = pairs.neg_id))""")


@query("bpr_loss", _bpr_sql())
def bpr_loss_q(spark, sf):
    from .q_sampling import neg_sample_ladder
    pairs = neg_sample_ladder(spark, sf)
    d = pairs.select((F.col("popularity") / F.lit(100000.0)).alias("s_pos"),
                     (F.col("neg_popularity") / F.lit(100000.0)).alias("s_neg"))
    return rounded(M.pairwise_loss(d, "s_pos", "s_neg"))
