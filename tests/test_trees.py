"""Forests and boosted trees on cells: the same trees as Spark's where nothing is drawn, and whole grids."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.sql import functions as F

from kestrel import config as C
from kestrel.operators import models as ML
from kestrel.operators import trees as TR
from kestrel.plans import q_models as Q


def sample(spark, n=500, wide=False, classes=2):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 200 if wide else 6, (n, 4))
    top = x.max()
    y = np.minimum((x[:, 0] / top + x[:, 1] * x[:, 2] / top ** 2 + rng.random(n) > 1.2).astype(int) + (classes > 2) * (x[:, 3] > top / 2), classes - 1)
    rows = [(i, i % 3, *(int(v) for v in x[i]), int(y[i])) for i in range(n)]
    return ML.assemble(spark.createDataFrame(rows, "id INT, fold INT, a INT, b INT, c INT, d INT, viral INT").repartition(3, "id"), ["a", "b", "c", "d"])


def loaded(c):
    """Bins and class counts of all cells."""
    r = c.table.toPandas()
    x = np.array([list(k) for k in r["_key"]], np.uint8)
    n = r[[f"n_{s}_{k}" for s in range(c.slots) for k in range(c.classes)]].to_numpy().reshape(len(x), c.slots, c.classes)
    return x, n


def test_cells_count_every_row(spark):
    df = sample(spark)
    twice = df.unionByName(df)
    x, n = loaded(TR.cells(twice, "features", "viral", "fold", 3))
    want = {tuple(r)[:4]: list(tuple(r)[4:]) for r in twice.groupBy("a", "b", "c", "d").agg(
        *[F.count(F.when((F.col("fold") == s) & (F.col("viral") == k), 1)) for s in range(3) for k in range(2)]).collect()}
    assert {tuple(int(v) for v in k): list(v.ravel()) for k, v in zip(x, n, strict=True)} == want and n.sum() == 1000


def test_wide_features_get_quantiles(spark):
    edges = TR.fit_edges(sample(spark, wide=True), "features")
    assert all(20 <= len(e) <= TR.MAX_BINS - 1 and e == sorted(set(e)) for e in edges)


def test_bad_labels_and_no_rows(spark):
    df = sample(spark, 20)
    for bad in (F.lit(None).cast("int"), F.lit(-1), F.lit(0.5)):
        with pytest.raises(ValueError):
            TR.cells(df.withColumn("viral", F.when(F.col("id") == 3, bad).otherwise(F.col("viral"))), "features", "viral", "fold", 3)
    with pytest.raises(ValueError):
        TR.cells(df.limit(0), "features", "viral", "fold", 3)


@pytest.mark.parametrize("classes", [2, 3])
def test_a_tree_is_sparks(spark, classes):
    df = sample(spark, classes=classes).cache()
    c = TR.cells(df, "features", "viral", "fold", 3)
    x, n = loaded(c)
    levels = TR.grow(x, n.sum(axis=1), 6, 9, 4, 42, 0)
    got = TR.votes(levels, x, [2, 4, 9])
    for depth in (2, 4, 9) if classes == 2 else (2, 4):  # deeper, splits of equal gain differ by rounding
        m = DecisionTreeClassifier(labelCol="viral", maxDepth=depth).fit(df)
        plain = m.transform(df)
        want = {(r["a"], r["b"], r["c"], r["d"]): list(r["probability"].toArray()) for r in plain.collect()}
        assert all(np.allclose(want[tuple(int(v) for v in k)], p) for k, p in zip(x, got[depth], strict=True))
        feature, cut, left, share, worth = TR._flat(levels, depth, 4)
        assert np.allclose(worth, m.featureImportances.toArray())
        node = np.zeros(len(x), int)
        while (inner := feature[node] >= 0).any():
            to = left[node] + (x[np.arange(len(x)), feature[node]] > cut[node])
            node = np.where(inner, to, node)
        assert np.allclose(share.reshape(-1, classes)[node], got[depth])


def test_few_nodes_at_a_time_give_the_same_tree(spark, monkeypatch):
    x, n = loaded(TR.cells(sample(spark), "features", "viral", "fold", 3))
    a = TR.grow(x, n.sum(axis=1), 6, 8, 2, 7, 5)
    monkeypatch.setattr(TR, "HISTOGRAM", 12)
    b = TR.grow(x, n.sum(axis=1), 6, 8, 2, 7, 5)
    assert len(a) == len(b) > 3 and all((p.feature == q.feature).all() and (p.cut == q.cut).all() and (p.weight == q.weight).all() for p, q in zip(a, b, strict=True))


def test_boosted_trees_are_sparks(spark):
    df = sample(spark).cache()
    c = TR.cells(df, "features", "viral", "fold", 3)
    m = TR.fit_boosted(c, "features", 42, maxDepth=3, maxIter=6, stepSize=0.3)
    plain = GBTClassifier(labelCol="viral", maxDepth=3, maxIter=6, stepSize=0.3).fit(df).transform(df)
    want = {r["id"]: (float(r["probability"][1]), r["prediction"]) for r in plain.collect()}
    got = {r["id"]: (r["probability"][1], r["prediction"]) for r in m.transform(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 1e-6 and got[i][1] == want[i][1] for i in want)
    points = [{"maxDepth": 3, "maxIter": k, "stepSize": 0.3} for k in (2, 6)]
    scores = TR.boosted_scores(c, points, [0, 1, 2], 42)
    for i, p in enumerate(points):
        for k in range(3):
            fitted = GBTClassifier(labelCol="viral", **p).fit(df.where(F.col("fold") != k)).transform(df.where(F.col("fold") == k))
            n, hits = fitted.agg(F.count("*"), F.sum((F.col("prediction") == F.col("viral")).cast("int"))).first()
            assert scores[i, k] == (n, hits)


def test_drawn_rows_and_features_are_as_many_as_asked_for():
    rng = np.random.default_rng(1)
    n = np.array([0, 1, 1, 5] * 5000)
    assert abs(TR._thinned(n, 0.8, rng).sum() / n.sum() - 0.8) < 0.01 and (TR._thinned(n, 1.0, rng) == n).all()
    assert (TR._thinned(n, 0.8, rng) <= n).all() and abs(TR._bag(n, 4, 1).sum() / n.sum() - 1) < 0.02
    d = TR._drawn(np.arange(1, 4001, dtype=np.uint64), 42, 3, 11, 4)
    assert all(len(set(r)) == 4 for r in d[:100].tolist()) and np.abs(np.bincount(d.ravel(), minlength=11) / 4000 - 4 / 11).max() < 0.04
    assert [TR.subset_size(s, 11) for s in ("0.3", "0.5", "0.7", "all", "auto", "sqrt", "2")] == [4, 6, 8, 11, 11, 4, 2]


def test_points_of_a_forest_share_their_trees(spark):
    df = sample(spark)
    c = TR.cells(df, "features", "viral", "fold", 3)
    points = [{"maxDepth": d, "numTrees": t} for d in (2, 9) for t in (3, 17, 20)]
    both = TR.forest_scores(c, points, [0, 1, 2], 42)
    for p in points:
        alone = TR.forest_scores(c, [p], [1], 42)
        assert alone == {(p["maxDepth"], p["numTrees"], 1): both[p["maxDepth"], p["numTrees"], 1]}
    assert sum(both[9, 20, k][0] for k in range(3)) == 500 and min(both[9, 20, k][1] for k in range(3)) > 100
    m = TR.fit_forest(c, "features", 42, 9, 20)
    got = m.transform(df.unionByName(df)).agg(F.count("*"), F.avg((F.col("prediction") == F.col("viral")).cast("double"))).first()
    assert got[0] == 1000 and got[1] > 0.85
    held = TR.fit_forest(TR.cells(df.where("fold != 1"), "features", "viral", "fold", 3), "features", 42, 9, 20).transform(df.where("fold = 1"))
    assert held.where("prediction = viral").count() == both[9, 20, 1][1]


def test_registered_searches_fit_the_whole_grids(spark, sf, monkeypatch):
    asked = {}

    def noted(name):
        def scores(c, points, folds, seed):
            asked[name] = (points, folds)
            return {(i, k) if name == "gbt" else (p["maxDepth"], p["numTrees"], k): (1, 0) for i, p in enumerate(points) for k in folds}
        return scores

    monkeypatch.setattr(TR, "boosted_scores", noted("gbt"))
    monkeypatch.setattr(TR, "forest_scores", noted("forest"))
    assert Q.gbt_grid(spark, sf).count() and Q.forest_cv(spark, sf).count()
    assert asked == {"gbt": (ML.grid_points(C.GBT_GRID), [0, 1, 2]), "forest": (ML.grid_points(C.FOREST_GRID), [0, 1, 2, 3, 4])}
    assert len(asked["gbt"][0]) == 243 and len(asked["forest"][0]) == 15


def test_more_cells_than_a_task_holds_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(TR, "MAX_CELLS", 10)
    df = sample(spark, 60)
    for m in (ML.fit_gbt_grid(df, grid={"maxDepth": [2], "maxIter": [2]}, folds=2), ML.fit_forest_cv(df, grid={"maxDepth": [2], "numTrees": [3]}, folds=2)):
        assert m.bestModel.transform(df).where("prediction IS NOT NULL").count() == 60 and len(m.avgMetrics) == 1


def test_a_forest_of_many_rows_is_grown_on_cells(spark, monkeypatch):
    df = sample(spark)
    few = ML.fit_forest_fixed(df, depth=6, trees=12)
    monkeypatch.setattr(ML, "FEW_ROWS", 499)
    many = ML.fit_forest_fixed(df, depth=6, trees=12)
    assert isinstance(many, TR.ForestModel) and not isinstance(few, TR.ForestModel)
    got = ML.feature_importance(spark, many, ["a", "b", "c", "d"]).collect()
    assert abs(sum(r["importance"] for r in got) - 1) < 1e-9 and got[0]["feature"] == "a"
    assert np.abs(many.featureImportances.toArray() - few.featureImportances.toArray()).max() < 0.15
