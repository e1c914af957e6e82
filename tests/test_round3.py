"""Findings of round 3 on models: how much work a fit does, with the same results."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import RandomForestClassifier

from kestrel.operators import models as ML
from kestrel.operators import sampling as SM
from kestrel.operators import text as T
from kestrel.plans import q_models as Q


def few_rows(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (n, 3))
    y = (x[:, 0] + rng.integers(0, 9, n) > 11).astype(int)
    rows = [(i, *(int(v) for v in x[i]), int(y[i])) for i in range(n)]
    return ML.assemble(spark.createDataFrame(rows, "id INT, a INT, b INT, c INT, viral INT").repartition(3, "id"), ["a", "b", "c"]).cache()


def trees(model):
    return re.sub(r"uid=\w+", "", model.toDebugString)


def test_forests_keep_node_ids_and_grow_the_same_trees(spark):
    df = few_rows(spark)
    m = ML.fit_forest_fixed(df, depth=12, trees=7)
    assert m.getOrDefault("cacheNodeIds") and Q.forest_estimator(numTrees=3).getCacheNodeIds()
    assert ML.fit_forest_cv(df, grid={"maxDepth": [3]}, folds=2).bestModel.getOrDefault("cacheNodeIds")
    plain = RandomForestClassifier(labelCol="viral", featuresCol="features", seed=42, maxDepth=12, numTrees=7).fit(df)
    assert trees(m) == trees(plain)


def posts(spark, spec):
    rows = [(i, viral, *keys, stock) for i, (viral, keys, stock) in enumerate(spec)]
    return spark.createDataFrame(rows, "post_id INT, viral INT, item_author STRING, article_author STRING, article_source STRING, stock_code INT")


def test_fallback_groups_are_slotted_only_where_asked_for(spark, monkeypatch):
    slotted, real = [], SM.slot_pool

    def noted(pool, keys, *rest):
        slotted.append((tuple(keys), sorted(r["post_id"] for r in pool.collect())))
        return real(pool, keys, *rest)

    monkeypatch.setattr(SM, "slot_pool", noted)
    a, b = ("a", "x", "s"), ("b", "x", "t")
    full = [(1, a, 1), *[(0, a, k) for k in (1, 2, 2, 3)], (0, b, 7), (0, b, 2), (0, b, None)]
    got = SM.sample_negatives_ladder(posts(spark, full), k=3).select("post_id", "neg_post_id").collect()
    assert [k for k, _ in slotted] == [tuple(SM.KEYS3)] and len({r[1] for r in got}) == 3
    slotted.clear()
    poor = [*full, (1, ("c", "x", "t"), 2), (1, ("c", None, None), None)]  # the last one finds nothing
    got = {tuple(r) for r in SM.sample_negatives_ladder(posts(spark, poor), k=3).select("post_id", "neg_post_id").collect()}
    assert dict(slotted)["article_source",] == [5, 6, 7] and dict(slotted)["stock_code",] == [2, 3, 6]
    assert {p for p, _ in got} == {0, 8} and {n for p, n in got if p == 8} <= {2, 3, 5, 6, 7} and sum(p == 8 for p, _ in got) == 3


def test_a_token_travels_once_for_all_texts_of_a_block(spark):
    texts = [(1, ["a", "b", "a"]), (2, ["a", None]), (2, ["c"]), (3, []), (4, None), (None, ["a"]), (5, ["zz"])]
    df = spark.createDataFrame(texts, "id LONG, tokens ARRAY<STRING>").coalesce(1)
    got = {r["token"]: sorted(zip(r["ids"], r["ns"]), key=str) for r in T.token_blocks(df, "id", "tokens").collect()}
    assert got == {"a": [(1, 2), (2, 1), (None, 1)], "b": [(1, 1)], None: [(2, 1)], "c": [(2, 1)], "zz": [(5, 1)]}
    lex = spark.createDataFrame([("a", 1.0), ("b", -2.0), ("c", 4.0), ("c", 2.0)], "word STRING, score DOUBLE")
    plan = T.lexicon_sentiment(df, "id", "tokens", lex)._jdf.queryExecution().optimizedPlan().toString()
    assert "token_blocks" in plan or "mapinarrow" in plan.lower()
    long = spark.createDataFrame([(r, t) for r, ts in texts for t in ts or []], "id LONG, token STRING").groupBy("id", "token").count()
    long.createOrReplaceTempView("long_tokens")
    lex.createOrReplaceTempView("lex_words")
    plain = dict(map(tuple, spark.sql("""SELECT id, sum(coalesce(score, 0.0) * count) / sum(count) FROM long_tokens
      LEFT JOIN lex_words ON token = word GROUP BY id""").collect()))
    out = sorted(((r["id"], r["sentiment_score"]) for r in T.lexicon_sentiment(df, "id", "tokens", lex).collect()), key=str)
    assert out == sorted(((i, plain.get(i, 0.0) if i is not None else 0.0) for i, _ in texts), key=str)
