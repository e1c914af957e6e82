"""Topics with the weights of words in a table (kestrel/operators/topics.py)."""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import text as T
from kestrel.operators import topics as TP


def test_functions():
    assert np.allclose(TP.digamma([1.0, 0.5, 10.0]), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-9)
    assert np.allclose(TP.trigamma([1.0, 0.5]), [math.pi ** 2 / 6, math.pi ** 2 / 2], atol=1e-9)
    h = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    g = TP.hashed_gamma(h)
    assert abs(g.mean() - 1) < 0.002 and abs(g.std() - 0.1) < 0.002 and (TP.hashed_gamma(h[:7]) == g[:7]).all()


def test_infer_as_one_by_one():
    rng = np.random.default_rng(2)
    doc = np.repeat([0, 1, 2], [4, 1, 6])
    count, beta, prior = rng.integers(1, 5, 11).astype(float), rng.random((11, 3)), np.array([0.2, 0.5, 0.3])
    first = rng.gamma(100, 0.01, (3, 3))
    got = TP.infer(doc, count, beta, prior, first)
    for d in range(3):
        b, c, g, change = beta[doc == d], count[doc == d], first[d], 1.0
        while change > 1e-3:
            theta = np.exp(TP.digamma(g) - TP.digamma(g.sum()))
            new = theta * (b.T @ (c / (b @ theta))) + prior
            g, change = new, np.abs(new - g).mean()
        assert np.allclose(g, got[d])


def test_blocks_end_at_a_number_of_tokens(spark):
    df = spark.createDataFrame([(i, ["a", "b", "a"]) for i in range(10)] + [(10, None), (11, [])], "id long, tokens array<string>").coalesce(1)
    parts = T.token_blocks(df, "id", "tokens", 6).collect()
    assert len({r["block"] for r in parts}) >= 4
    assert sorted((i, r["token"], n) for r in parts for i, n in zip(r["ids"], r["ns"])) == sorted(
        (i, w, n) for i in range(10) for w, n in (("a", 2), ("b", 1)))


def test_topics_from_a_table_of_weights(spark):
    x, y = [f"x{i}" for i in range(6)], [f"y{i}" for i in range(6)]
    rows = [(i % 150, (x if i % 2 else y) * 5) for i in range(400)] + [(None, x * 5), (7, []), (8, None), (9, ["x0"] * 3)]
    df = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    m = TP.fit_topics(df, "tokens", k=2, seed=3, max_iter=30)
    # before: a vocabulary and a matrix held by the driver
    assert isinstance(m.weights, DataFrame) and {r["token"] for r in m.weights.collect()} == {*x, *y}
    top = TP.top_terms(m, 6).collect()
    assert {(r["topic"], r["rank"]) for r in top} == {(t, n) for t in (0, 1) for n in range(1, 7)}
    kinds = [{r["term"][0] for r in top if r["topic"] == t} for t in (0, 1)]
    assert sorted(map(sorted, kinds)) == [["x"], ["y"]]
    out = TP.assign_topics(m, df.union(spark.createDataFrame([(10, ["never"])], df.schema)))
    assert out.count() == len(rows) + 1
    got = {(r["w"], r["dominant_topic"]) for r in out.select(F.get("tokens", F.lit(0)).alias("w"), "dominant_topic").collect()}
    assert got == {("x0", kinds.index({"x"})), ("y0", kinds.index({"y"})), (None, None), ("never", None)}
    for size in (3, 12):
        assert TP.fit_topics(df, "tokens", k=2, vocab_size=size, max_iter=1).weights.count() == size


def test_no_word_at_all(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "post_id long, tokens array<string>")
    m = TP.fit_topics(df, "tokens", max_iter=2)
    assert TP.top_terms(m).collect() == [] and [r["dominant_topic"] for r in TP.assign_topics(m, df).collect()] == [None, None]
