"""Model queries.  Results depend on
model fitting, so these have no SQL twin; each returns a small table whose
columns and row count are stable, and tests check their properties."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import config as C
from ..functions.hashing import TWO_60, hash_int
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import rankers as R
from ..operators import sampling as S
from ..operators import search as SE
from ..operators import text as T
from ..operators import topics as TP
from ..operators.splits import chrono_split, random_split
from ..sources import adapters as A
from ..session import shared_path
from ..sources.tables import checkpointed, fingerprint, materialize_once, table, table_path
from .q_encode_metrics import posts_features, rounded
from .registry import query
from .sql import POSTS, SPLIT_CASE, h, with_

FEATURES = C.POST_FEATURES + C.AUTHOR_FEATURES


PAIR_KEYS = ["item_author", "article_author", "article_source", "stock_code"]


def _code_version() -> str:
    """Hash of the library code that the feature table depends on."""
    root = Path(__file__).resolve().parent.parent
    files = [root / "config.py", *sorted(f for d in ("functions", "operators", "plans", "sources") for f in (root / d).glob("*.py"))]
    return hashlib.md5(b"".join(f.read_bytes() for f in files)).hexdigest()


def _feature_table(spark, sf):
    """Feature table with its split, materialised once (A10) in the shared
    checkpoint folder under a fingerprint of its input files and of the code: every model
    query rereads the compact table instead of re-deriving it, and a lost
    executor never forces the derivation again."""
    def build():
        f = chrono_split(posts_features(spark, sf, stored=True), "year_month", C.SPLITS)
        return f.select("post_id", "split", "viral", *PAIR_KEYS, *FEATURES)
    inputs = [table_path(sf, n) for n in ("orders", "customer", "nation", "region")]
    key = fingerprint(spark, inputs, _code_version())
    return materialize_once(build, shared_path(spark, f"features-{key}"), spark)


def _split_features(spark, sf, table_=None):
    f = table_ if table_ is not None else _feature_table(spark, sf)
    return ML.assemble(f.select("post_id", "split", "viral", *FEATURES), FEATURES)


def _acc_rows(model, data, label="viral"):
    pred = model.transform(data)
    return (pred.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                      F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")))


@query("assemble_features", with_(POSTS) + f"""SELECT post_id, CAST({len(FEATURES)} AS BIGINT) AS n_features
FROM (SELECT post_id, {SPLIT_CASE} AS split FROM posts) WHERE split IS NOT NULL""")
def assemble_features(spark, sf):
    f = _split_features(spark, sf)
    return f.select("post_id", F.size(vector_to_array("features")).cast("bigint").alias("n_features"))


@query("gbt_grid")
def gbt_grid(spark, sf):
    d = _split_features(spark, sf)
    cv = ML.fit_gbt_grid(d.filter("split = 'train'"))
    return rounded(_acc_rows(cv.bestModel, d.filter("split <> 'train'")))


@query("forest_cv")
def forest_cv(spark, sf):
    d = _split_features(spark, sf)
    cv = ML.fit_forest_cv(d.filter("split = 'train'"))
    return rounded(_acc_rows(cv.bestModel, d.filter("split <> 'train'")))


@query("logistic_grid")
def logistic_grid(spark, sf):
    d = _split_features(spark, sf)
    cv = ML.fit_logistic_grid(d.filter("split = 'train'"), weighted=True)
    return rounded(_acc_rows(cv.bestModel, d.filter("split <> 'train'")))


@query("logistic_grid_unweighted")
def logistic_grid_unweighted(spark, sf):
    d = _split_features(spark, sf)
    cv = ML.fit_logistic_grid(d.filter("split = 'train'"), weighted=False)
    return rounded(_acc_rows(cv.bestModel, d.filter("split <> 'train'")))


def _search_rows(spark, sf, folds):
    """Feature rows with nulls filled by rule and a fold, stored once, and the folder of their searches."""
    fill = {c: C.MAX_RANK + 1 if c.endswith("_rank") else -1 for c in FEATURES}
    inputs = [table_path(sf, n) for n in ("orders", "customer", "nation", "region")]
    store = shared_path(spark, f"search-{fingerprint(spark, inputs, _code_version())}-{folds}")
    rows = SE.with_folds(_feature_table(spark, sf).select("post_id", "split", "viral", *FEATURES).na.fill(fill), "post_id", folds)
    return materialize_once(rows, f"{store}/rows", spark), store


FOREST_FOLDS, LOGISTIC_FOLDS = 5, 3
ONE_HOT = ["sentiment", "topic"]
SCALED = [c for c in FEATURES if c not in ONE_HOT]


def forest_estimator(**params):
    return ML.forest(**params)


@query("forest_search")
def forest_search(spark, sf):
    """L2/L13 in full: all points of config.FOREST_GRID, five folds, resumable; one row per point."""
    rows, store = _search_rows(spark, sf, FOREST_FOLDS)
    train = ML.assemble(rows.where("split = 'train'"), FEATURES)
    points = ML.grid_points(C.FOREST_GRID)
    got = SE.search(train, SE.estimator_fitter(forest_estimator), points, f"{store}/forest", FOREST_FOLDS)
    best = SE.point_name(SE.best_point(got, points))
    return rounded(SE.point_scores(got).withColumn("best", F.col("params") == best))


def _logistic_parts(spark, sf):
    rows, store = _search_rows(spark, sf, LOGISTIC_FOLDS)
    train = rows.where("split = 'train'")
    encodings = SE.fit_encodings(train, SCALED, ONE_HOT, "viral", LOGISTIC_FOLDS)
    return rows, train, store, encodings


@query("logistic_pipeline")
def logistic_pipeline(spark, sf):
    """L3 in full: one-hot, scaling, class weights and feature choice fitted inside each fold,
    ten values of C, the best refitted on the whole training split; accuracy of the later splits."""
    rows, train, store, encodings = _logistic_parts(spark, sf)
    # the fits read equal rows of a fold once, weighed by their number
    rows, n = materialize_once(SE.counted(rows, ["fold", "split", "viral", *FEATURES], "_n"), f"{store}/counted", spark), "_n"
    train = rows.where("split = 'train'")
    chosen = SE.choose_per_fold(train, encodings, "viral", 5, count=n)
    fit = SE.logistic_fitter(encodings, chosen, count=n)
    points = [{"C": c} for c in C.LOGISTIC_CS]
    best = SE.best_point(SE.search(train, fit, points, f"{store}/logistic", LOGISTIC_FOLDS, count=n), points)
    pred = fit(train, best, None)(rows.where("split <> 'train'"))
    hit = F.when(F.col("prediction") == F.col("viral"), F.col(n)).when(F.col("viral").isNotNull(), 0)
    return rounded(pred.groupBy("split").agg(F.lit(best["C"]).alias("c"), F.sum(n).alias("n"),
                                             (F.sum(hit) / F.sum(F.when(F.col("viral").isNotNull(), F.col(n)))).alias("accuracy")))


@query("fold_statistics", with_(POSTS) + f""", f AS (
  SELECT month, topic, viral, ({h("'42|' || CAST(post_id AS VARCHAR)")}) % 3 AS fold FROM (SELECT *, {SPLIT_CASE} AS split FROM posts) WHERE split = 'train')
SELECT CAST(k.fold AS INTEGER) AS fold, round(avg(month), 6) AS mean, round(stddev_pop(month), 6) AS deviation, count(DISTINCT topic) AS topics,
  round(count(*) / (2.0 * sum(1 - viral)), 6) AS weight_0, round(count(*) / (2.0 * sum(viral)), 6) AS weight_1
FROM f JOIN (VALUES (0), (1), (2)) k(fold) ON f.fold <> k.fold GROUP BY k.fold""")
def fold_statistics(spark, sf):
    """J4-J6 inside the folds: what the encoders of each fold learnt from the other folds."""
    encodings = _logistic_parts(spark, sf)[3]
    rows = [(k, *e.stats["month"], len(e.levels["topic"]), e.weights.get("0"), e.weights.get("1"))
            for k, e in encodings.items() if k is not None]
    return rounded(spark.createDataFrame(rows, "fold INT, mean DOUBLE, deviation DOUBLE, topics BIGINT, weight_0 DOUBLE, weight_1 DOUBLE"))


@query("rfe")
def rfe_q(spark, sf):
    d = _split_features(spark, sf).filter("split = 'train'")
    ranks = ML.rfe(d, FEATURES, keep=5)
    return spark.createDataFrame(ranks, "feature STRING, rank INT")


@query("feature_importance")
def feature_importance_q(spark, sf):
    d = _split_features(spark, sf)
    m = ML.fit_forest_fixed(d.filter("split = 'train'"))
    return rounded(ML.feature_importance(spark, m, FEATURES))


def _lineitem(spark, sf):
    li = table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return ML.assemble(li, ["l_quantity", "l_discount", "l_tax"])


@query("linear_fit")
def linear_fit(spark, sf):
    li = _lineitem(spark, sf)
    models = ML.fit_linear(li, "features", ["l_extendedprice"])
    rows = []
    for t, m in models.items():
        p = m.transform(li)
        r = M.r2(p, t, "prediction").first()
        rows.append((t, int(m.numFeatures), float(r["r2"])))
    return rounded(spark.createDataFrame(rows, "target STRING, n_features INT, r2 DOUBLE"))


@query("lasso_fit")
def lasso_fit(spark, sf):
    li = _lineitem(spark, sf)
    m = ML.fit_linear(li, "features", ["l_extendedprice"], reg=10.0, l1=True)["l_extendedprice"]
    coefs = list(m.coefficients.toArray())
    return rounded(spark.createDataFrame([(n, float(c)) for n, c in zip(["l_quantity", "l_discount", "l_tax"], coefs)],
                                         "feature STRING, coefficient DOUBLE"))


@query("regr_slope", """SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem""")
def regr_slope(spark, sf):
    """Closed-form single-feature least squares (L6 with one feature)."""
    li = table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"])
    return rounded(li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"),
                          F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept")))


def _feature_pairs(spark, sf, data_splits, aux_splits=(), table_=None):
    f = table_ if table_ is not None else _feature_table(spark, sf)
    data = f.filter(F.col("split").isin(*data_splits)).drop("split")
    aux = [f.filter(F.col("split").isin(*aux_splits)).drop("split")] if aux_splits else None
    pairs = S.sample_negatives_ladder(data, aux, k=C.NEG_PER_POS_LADDER)
    return checkpointed(pairs.select("post_id", *FEATURES, *[f"neg_{c}" for c in FEATURES]))


@query("pairwise_ranker")
def pairwise_ranker(spark, sf):
    pairs = _feature_pairs(spark, sf, ["train"])
    m = ML.fit_pairwise_ranker(pairs, FEATURES)
    w = list(m.coefficients.toArray())
    return rounded(spark.createDataFrame([(c, float(x)) for c, x in zip(FEATURES, w)], "feature STRING, weight DOUBLE"))


@query("train_rounds")
def train_rounds(spark, sf):
    ft = _feature_table(spark, sf)
    splits = {r: s for r, role, s in C.ROUNDS if role == "train"}
    by_round = {r: _feature_pairs(spark, sf, [s], C.ROUND_AUX[r, "train"], table_=ft) for r, s in splits.items()}
    models = ML.train_rounds(by_round, FEATURES)
    rows = []
    for r, m in models.items():
        scored = ML.ranker_score(m, by_round[r], FEATURES, "s_pos")
        scored = ML.ranker_score(m, scored.select(*[F.col("neg_" + c).alias(c) for c in FEATURES], "s_pos"),
                                 FEATURES, "s_neg")
        loss = M.pairwise_loss(scored, "s_pos", "s_neg").first()
        rows.append((r, int(loss["n_pairs"]), float(loss["mean_loss"] or 0.0)))
    return rounded(spark.createDataFrame(rows, "round INT, n_pairs BIGINT, mean_loss DOUBLE"))


@query("bilinear_ranker")
def bilinear_ranker(spark, sf):
    """Post vector times author vector, from the linear ranker's weights; the loss of each."""
    pairs = _feature_pairs(spark, sf, ["train"])
    linear = ML.ranker_steps(pairs, FEATURES)
    start = R.mean_loss(R.pair_diffs(pairs, FEATURES), FEATURES, linear)
    m = R.fit_bilinear(pairs, C.POST_FEATURES, C.AUTHOR_FEATURES, linear)
    rows = [("linear", start), ("bilinear", R.pair_loss(pairs, m))]
    return rounded(spark.createDataFrame(rows, "model STRING, mean_loss DOUBLE"))


@query("early_stop_ranker")
def early_stop_ranker(spark, sf):
    """Epochs until the validation loss has not fallen twice; the best one is kept."""
    ft = _feature_table(spark, sf)
    train = _feature_pairs(spark, sf, ["train"], table_=ft)
    valid = _feature_pairs(spark, sf, ["valid"], C.ROUND_AUX[1, "valid"], table_=ft)
    got = R.fit_with_patience(train, valid, FEATURES)
    rows = [(e, a, b, e == got.epoch) for e, a, b in got.history]
    return rounded(spark.createDataFrame(rows, "epoch INT, train_loss DOUBLE, valid_loss DOUBLE, best BOOLEAN"))


@query("walk_forward")
def walk_forward(spark, sf):
    """Each round's ranker on the period after it: loss, precision, recall, F1, NDCG."""
    ft = _feature_table(spark, sf)
    splits = {r: s for r, role, s in C.ROUNDS if role == "train"}
    tests = {r: s for r, role, s in C.ROUNDS if role == "test"}
    train = {r: _feature_pairs(spark, sf, [s], C.ROUND_AUX[r, "train"], table_=ft) for r, s in splits.items()}
    test = {r: _feature_pairs(spark, sf, [s], table_=ft) for r, s in tests.items()}
    rounds = spark.createDataFrame(list(tests.items()), "round INT, split STRING")
    rows = ft.join(F.broadcast(rounds), "split")  # one row per round
    fill = {c: C.MAX_RANK + 1 if c.endswith("_rank") else -1 for c in FEATURES}
    rows = rows.na.fill(fill).select("round", "post_id", F.col("viral").alias("y"), *FEATURES)
    return rounded(R.walk_forward(train, test, rows, FEATURES)[1])


@query("round_metrics", with_(POSTS) + f""", s AS (
  SELECT r.round, post_id, viral AS y, ({h("'s|' || CAST(post_id AS VARCHAR)")}) / 1152921504606846976.0 + 0.3 * viral AS score
  FROM (SELECT *, {SPLIT_CASE} AS split FROM posts) p
  JOIN (VALUES {", ".join(f"({r}, '{n}')" for r, role, n in C.ROUNDS if role == "test")}) r(round, split) ON p.split = r.split),
k AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY score DESC, post_id) AS rank, count(*) OVER (PARTITION BY round) AS n,
  sum(y) OVER (PARTITION BY round) AS positives FROM s),
l AS (SELECT round, score AS least FROM k WHERE rank = floor(n * {C.TOP_FRACTION}) + 1),
c AS (
  SELECT k.round, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(CAST(score >= least AS INTEGER)) AS BIGINT) AS predicted,
    sum(y * CAST(score >= least AS INTEGER)) AS tp, avg(CAST(y = CAST(score >= least AS INTEGER) AS DOUBLE)) AS accuracy,
    sum(CASE WHEN y = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= positives THEN 1 / log2(rank + 1) ELSE 0 END) AS idcg
  FROM k JOIN l ON k.round = l.round GROUP BY k.round),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(positives, 0), 0) AS recall FROM c)
SELECT CAST(round AS INTEGER) AS round, n, positives, predicted, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM m""")
def round_metrics(spark, sf):
    """The test metrics of every round, on stored scores."""
    p = chrono_split(A.posts(spark, sf), "year_month", C.SPLITS)
    rounds = spark.createDataFrame([(r, s) for r, role, s in C.ROUNDS if role == "test"], "round INT, split STRING")
    p = p.join(F.broadcast(rounds), "split")  # one row per round
    score = hash_int(F.lit("s"), F.col("post_id")) / F.lit(TWO_60) + F.lit(0.3) * F.col("viral")
    return rounded(R.evaluate_rounds(p.select("round", "post_id", F.col("viral").alias("y"), score.alias("score")), fraction=C.TOP_FRACTION))


@query("early_stop")
def early_stop(spark, sf):
    d = _split_features(spark, sf)
    m = ML.fit_gbt_early_stop(d.filter("split = 'train'").drop("split"), d.filter("split = 'valid'").drop("split"),
                              max_iter=30)
    return spark.createDataFrame([(int(m.getNumTrees),)], "n_trees INT")


@query("score_report")
def score_report(spark, sf):
    ft = _feature_table(spark, sf)
    pairs = _feature_pairs(spark, sf, ["train"], table_=ft)
    m = ML.fit_pairwise_ranker(pairs, FEATURES)
    test = _split_features(spark, sf, ft).filter("split = 'test1'")
    rep = ML.score_and_report(m, test, FEATURES, fraction=C.TOP_FRACTION)
    return rounded(rep.select("post_id", "score", "pred", "viral",
                              F.transform("feature_attention", lambda v: F.round(v, 6)).alias("feature_attention")))


@query("param_sweep")
def param_sweep(spark, sf):
    pairs = _feature_pairs(spark, sf, ["train"])
    grid = {"regParam": [0.0, 0.01], "maxIter": [20, 50]}
    rows = []
    for pt in ML.grid_points(grid):
        m = ML.fit_pairwise_ranker(pairs, FEATURES, reg=pt["regParam"], max_iter=pt["maxIter"])
        rows.append((float(pt["regParam"]), int(pt["maxIter"]), float(m.summary.objectiveHistory[-1])))
    return rounded(spark.createDataFrame(rows, "reg_param DOUBLE, max_iter INT, objective DOUBLE"))


# ---------------------------------------------------------------- text models


def _tok(spark, sf):
    t = A.labelled_titles(spark, sf).select("post_id", "item_title", "viral")
    t = T.tokenize(T.clean_text(t, "item_title", "clean"), "clean")
    return checkpointed(t.select("post_id", "viral", "tokens"))


@query("lda_topics")
def lda_topics(spark, sf):
    t = _tok(spark, sf)
    m = TP.fit_topics(t, "tokens", k=3, seed=10, max_iter=10)
    return rounded(TP.top_terms(m, 10))


@query("dominant_topic")
def dominant_topic_q(spark, sf):
    t = _tok(spark, sf)
    m = TP.fit_topics(t, "tokens", k=3, seed=10, max_iter=10)
    return TP.assign_topics(m, t).select("post_id", "dominant_topic")


@query("embed_text")
def embed_text(spark, sf):
    t = _tok(spark, sf)
    m = ML.fit_embedder(t, "tokens", dim=16)
    e = m.transform(t)
    return e.select("post_id", vector_to_array("embedding_vec").alias("embedding"))


def _vec_split(spark, sf):
    v = A.vectors(spark, sf)
    from pyspark.ml.functions import array_to_vector
    v = v.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    return checkpointed(random_split(v, [8, 2], 3, id_col="vec_id", names=["train", "test"]))


def _shape(v):
    """(inputs, classes) of the labelled vectors, read from the data."""
    r = v.agg(F.max(F.size("embedding")), F.max("label")).first()
    return int(r[0]), int(r[1]) + 1


@query("topic_classifier")
def topic_classifier(spark, sf):
    v = _vec_split(spark, sf)
    m = ML.fit_topic_classifier(v.filter("split = 'train'"), "features", "label", *_shape(v), max_iter=50)
    return rounded(_acc_rows(m, v, "label"))


@query("classify_topics")
def classify_topics(spark, sf):
    v = _vec_split(spark, sf)
    m = ML.fit_topic_classifier(v.filter("split = 'train'"), "features", "label", *_shape(v), max_iter=50)
    return m.transform(v.filter("split = 'test'")).select("vec_id", F.col("prediction").cast("int").alias("topic"))


@query("sentiment_label_counts")
def sentiment_label_counts(spark, sf):
    t = _tok(spark, sf)
    labelled = t.filter(F.col("viral").isNotNull()).withColumn("label", F.col("viral").cast("double"))
    m = ML.fit_sentiment_labeller(labelled, "tokens", "label")
    pred = m.transform(t).select(F.col("prediction").cast("int").alias("sentiment_label"))
    return pred.groupBy("sentiment_label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
