"""Text adapter, storage, stream, sampler and ranking behaviour."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from kestrel.operators import models as ML
from kestrel.operators import ranking as R
from kestrel.operators import relational as Rel
from kestrel.operators import sampling as S
from kestrel.operators import text as T
from kestrel.sources import adapters as A
from kestrel.sources import tables as IO
from kestrel.streaming.scorer import score_new_arrivals


def _copy(spark, sf, to, *names):
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").write.parquet(f"{to}/{n}.parquet")


def test_documents_without_an_order_stay(spark, sf, tmp_path):
    d = str(tmp_path)
    _copy(spark, sf, d, "documents", "labels")
    spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 2 = 0").write.parquet(f"{d}/orders.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    t = A.texts(spark, d)
    assert t.count() == A.titles(spark, d).count() == docs
    assert t.where("year_month is null").count() >= docs // 2


def test_texts_are_read_without_joins_where_possible(spark, sf):
    plan = A.titles(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_half_written_table_is_not_read(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    (tmp_path / "t" / "_SUCCESS").unlink()  # a write that died
    assert IO.materialize_once(spark.range(7), p, spark).count() == 7
    assert IO.materialize_once(lambda: 1 / 0, p, spark).count() == 7
    (tmp_path / "u" / "_temporary").mkdir(parents=True)
    assert IO.materialize_once(spark.range(2), str(tmp_path / "u"), spark).count() == 2


def test_fingerprint_sees_files_and_versions(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    a = IO.fingerprint(spark, [p], "1")
    assert a == IO.fingerprint(spark, [f"file://{p}"], "1") != IO.fingerprint(spark, [p], "2")
    spark.range(4).write.mode("append").parquet(p)
    assert a != IO.fingerprint(spark, [p], "1")


def test_stream_of_a_folder_table(spark, sf, tmp_path):
    d = str(tmp_path / "orders.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.repartition(3).write.parquet(d)
    out = score_new_arrivals(spark, d, orders.schema, lambda b: b.select("o_orderkey"), max_files_per_trigger=2)
    assert out.count() == orders.count() and out.columns == ["o_orderkey"]
    none = str(tmp_path / "none.parquet")
    orders.limit(0).write.parquet(none)
    assert score_new_arrivals(spark, none, orders.schema, lambda b: b.select("o_orderkey")).count() == 0


def test_attach_keeps_left_rows(spark):
    left = spark.createDataFrame([(i,) for i in range(5)], "a INT")
    right = spark.createDataFrame([(9,), (8,)], "b INT")
    got = Rel.attach_by_position(left, right, [("a", True)], [("b", True)]).collect()
    assert {(r["position"], r["a"], r["b"]) for r in got} == {(1, 0, 8), (2, 1, 9), (3, 2, None), (4, 3, None), (5, 4, None)}


def test_floyd_draws_every_subset(spark):
    draws = spark.range(3000).select(F.array_sort(S.floyd(F.lit(5).cast("bigint"), F.lit(2).cast("bigint"),
                                                          lambda i: S.hash_int(F.lit(1), F.col("id"), i))).alias("s"))
    n = {tuple(r["s"]): r["count"] for r in draws.groupBy("s").count().collect()}
    assert set(n) == set(itertools.combinations(range(5), 2))
    assert max(n.values()) < 1.4 * min(n.values())


def test_pair_rows_obey_the_candidate_rule(spark):
    rows = [(i, f"a{i % 3}", f"b{i % 2}", "s", i % 4, int(i < 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "post_id INT, item_author STRING, article_author STRING, article_source STRING, stock_code INT, viral INT")
    got = S.sample_negatives_ladder(df, k=3).collect()
    by = {}
    for r in got:
        assert r["viral"] == 1 and r["neg_viral"] == 0 and r["post_id"] != r["neg_post_id"]
        assert (r["item_author"], r["article_author"]) == (r["neg_item_author"], r["neg_article_author"])  # groups of 9 or 10
        by.setdefault(r["post_id"], set()).add(r["neg_post_id"])
    assert len(got) == 18 and all(len(v) == 3 for v in by.values())


def test_stopwords_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, []), (1, ["a", "b"]), (1, ["c", "x"]), (3, None)], "id INT, t ARRAY<STRING>")
    words = spark.createDataFrame([("a",), ("x",), ("y",), ("a",), (None,)], "word STRING")
    got = sorted((r["id"], r["k"]) for r in T.remove_stopwords(df, "t", words, out="k").collect() if r["t"] is not None)
    assert got == [(1, ["b"]), (1, ["b", "c"]), (1, ["c"]), (2, [])]
    assert [r["k"] for r in T.remove_stopwords(df, "t", words, out="k").where("t IS NULL").collect()] == [None]
    assert {tuple(r["t"]) for r in T.remove_stopwords(df, "t", words.limit(0)).where("t IS NOT NULL").collect()} == {("a", "b", "c", "a"), (), ("a", "b"), ("c", "x")}


def test_dedupe_first_orders_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (1, None, "y"), (1, 7.0, "b"), (1, 7.0, "a"), (None, 1.0, "n")], "k INT, v DOUBLE, s STRING")
    got = {(r["k"], r["v"], r["s"]) for r in Rel.dedupe_first(df, ["k"], [("v", False), "s"]).collect()}
    assert got == {(1, 7.0, "a"), (None, 1.0, "n")}


def test_nothing_stays_persisted(spark):
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = held().size()
    df = spark.range(200).select(F.col("id").alias("post_id"), (F.col("id") % 7).cast("double").alias("s"))
    R.global_row_number(df, [("s", False), ("post_id", True)]).count()
    R.kth_row(df, [("s", False), ("post_id", True)], lambda n: 11)
    assert held().size() == before


def test_assemble_fills_nulls_by_rule(spark):
    df = spark.createDataFrame([(None, None), (3, 1)], "a_rank INT, code INT")
    got = [list(r["features"]) for r in ML.assemble(df, ["a_rank", "code"]).collect()]
    assert got == [[11.0, -1.0], [3.0, 1.0]]


def test_rounds_start_from_the_last_weights(spark):
    import random
    rng = random.Random(1)
    rows = [(rng.gauss(1, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)]
    pairs = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE, neg_x DOUBLE, neg_y DOUBLE")
    full = ML.ranker_steps(pairs, ["x", "y"], steps=12)
    fitted = list(ML.fit_pairwise_ranker(pairs, ["x", "y"]).coefficients.toArray())
    assert all(abs(a - b) < 0.02 for a, b in zip(full, fitted, strict=True))
    w = ML.train_rounds({1: pairs, 2: pairs.limit(0), 3: pairs}, ["x", "y"], steps=6)
    assert w[2] == w[1] and abs(w[3][0] - full[0]) < 1e-6


def test_stopwords_of_a_long_text_by_one_set_difference(spark):
    text = ["s%d" % (i % 7) if i % 3 else "k%d" % i for i in range(30_000)] + [None, "s1"]
    df = spark.createDataFrame([(1, text), (2, ["s1", "s1"]), (3, []), (4, None)], "id int, t array<string>")
    words = spark.createDataFrame([("s%d" % k,) for k in range(7)] + [(None,)], "word string")
    out = T.remove_stopwords(df, "t", words, out="k")
    # not one search among the dropped positions for each token
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["k"] for r in out.collect()}
    assert got == {1: [w for w in text if w is None or w[0] == "k"], 2: [], 3: [], 4: None}
