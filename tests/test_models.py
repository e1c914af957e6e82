"""Properties of the queries that fit models (no SQL twin)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from kestrel import config as C
from kestrel.plans.q_models import FEATURES


def rows(spark, sf, name):
    return E.queries()[name](spark, sf).collect()


@pytest.mark.parametrize("name", ["gbt_grid", "forest_cv", "logistic_grid", "logistic_grid_unweighted"])
def test_grids_score_every_later_split(spark, sf, name):
    got = {r["split"]: r for r in rows(spark, sf, name)}
    assert set(got) <= {"valid", "test1", "test2", "test3", "test4"} and got
    assert all(0 <= r["accuracy"] <= 1 and r["n"] > 0 for r in got.values())


def test_rfe_ranks(spark, sf):
    got = {r["feature"]: r["rank"] for r in rows(spark, sf, "rfe")}
    assert set(got) == set(FEATURES) and sum(v == 1 for v in got.values()) == 5
    assert sorted(v for v in got.values() if v > 1) == list(range(2, len(FEATURES) - 3))


def test_importances_sum_to_one(spark, sf):
    got = [r["importance"] for r in rows(spark, sf, "feature_importance")]
    assert len(got) == len(FEATURES) and got == sorted(got, reverse=True) and abs(sum(got) - 1) < 1e-4


def test_linear_and_lasso_against_numpy(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_extendedprice").toPandas().astype(float)
    x = np.c_[li[["l_quantity", "l_discount", "l_tax"]].to_numpy(), np.ones(len(li))]
    y = li["l_extendedprice"].to_numpy()
    w, *_ = np.linalg.lstsq(x, y, rcond=None)
    r2 = 1 - ((y - x @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(rows(spark, sf, "linear_fit")[0]["r2"] - r2) < 1e-5
    lasso = {r["feature"]: r["coefficient"] for r in rows(spark, sf, "lasso_fit")}
    assert set(lasso) == {"l_quantity", "l_discount", "l_tax"} and abs(lasso["l_quantity"] - w[0]) < 0.05 * abs(w[0])


def test_rankers(spark, sf):
    assert {r["feature"] for r in rows(spark, sf, "pairwise_ranker")} == set(FEATURES)
    got = rows(spark, sf, "train_rounds")
    assert [r["round"] for r in sorted(got, key=lambda r: r["round"])] == [1, 2, 3, 4]
    assert got[0]["mean_loss"] < np.log(2)
    sweep = rows(spark, sf, "param_sweep")
    assert len(sweep) == 4 and all(r["objective"] < np.log(2) + 1e-6 for r in sweep)


def test_report(spark, sf):
    got = rows(spark, sf, "score_report")
    ones = sum(r["pred"] for r in got)
    assert ones >= int(len(got) * C.TOP_FRACTION) + 1
    low = min(r["score"] for r in got if r["pred"])
    assert all(r["score"] <= low for r in got if not r["pred"])
    assert all(abs(sum(r["feature_attention"]) - 1) < 1e-4 for r in got)


def test_early_stop(spark, sf):
    assert 1 <= rows(spark, sf, "early_stop")[0]["n_trees"] <= 30


def test_topics(spark, sf):
    top = rows(spark, sf, "lda_topics")
    assert len(top) == 30 and {r["topic"] for r in top} == {0, 1, 2} and {r["rank"] for r in top} == set(range(1, 11))
    docs = rows(spark, sf, "dominant_topic")
    assert len(docs) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r["dominant_topic"] for r in docs} <= {0, 1, 2, None}
    emb = rows(spark, sf, "embed_text")
    assert len(emb) == len(docs) and {len(r["embedding"]) for r in emb} == {16}


def test_classifiers(spark, sf):
    acc = {r["split"]: r["accuracy"] for r in rows(spark, sf, "topic_classifier")}
    assert acc["train"] > 0.2  # ten classes
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    classes = {r[0] for r in v.select("label").distinct().collect()}
    assert {r["topic"] for r in rows(spark, sf, "classify_topics")} <= classes
    n = sum(r["n"] for r in rows(spark, sf, "sentiment_label_counts"))
    assert n == spark.read.parquet(f"{sf}/documents.parquet").agg(F.count("*")).first()[0]
