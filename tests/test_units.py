"""Hand-made rows for each behaviour decision that changes a result."""

import math

import pytest
from pyspark.sql import functions as F

from kestrel.functions import scalar as S
from kestrel.operators import encode as E
from kestrel.operators import metrics as M
from kestrel.operators import ranking as R
from kestrel.operators import relational as Rel
from kestrel.operators import sampling as SM
from kestrel.operators import text as T


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_enrich_left_dedupes_and_fills(spark):
    facts = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "post_id INT, stock_code INT")
    dim = spark.createDataFrame([(10, "B"), (10, "A"), (30, "C")], "stock_code INT, ind STRING")
    out = Rel.enrich_left(facts, dim, "stock_code", fill={"ind": "others"})
    assert rows(out, "post_id", "ind") == [(1, "A"), (2, "others"), (3, "others")]


def test_normalize_source(spark):
    vals = ["x" * 40, "y" * 41, "canon■", None, "plain"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id INT, s STRING")
    out = Rel.normalize_source(df, "s", "canon", 40)
    assert [r["s"] for r in out.orderBy("id").collect()] == ["x" * 40, "canon", "canon", None, "plain"]


def test_parse_topics(spark):
    vals = ["[(0, 0.12), (2, 0.88)]", "[(1, 1e-05)]", "[]", None, "([(0, 0.5)], [(1, [(0, 0.5)])])"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id INT, s STRING")
    out = df.select("id", S.parse_topics("s").alias("t")).select(
        "id", *[S.topic_prob("t", k).alias(f"t{k}") for k in range(3)], S.best_topic("t").alias("best"))
    got = {r["id"]: (r["t0"], r["t1"], r["t2"], r["best"]) for r in out.collect()}
    assert got[0] == (0.12, 0.0, 0.88, 2)
    assert got[1] == (0.0, 1e-05, 0.0, 1)
    assert got[2] == (0.0, 0.0, 0.0, None)
    assert got[4][0] == 1.0  # the per-word tuple form: every (topic, prob) pair is read


def test_rank_ties_cap_and_lag(spark):
    data = []
    pid = 0
    # month 2000-01: a has 3 posts, b 3, c 1 -> dense ranks 1, 1, 2
    for a, n in (("a", 3), ("b", 3), ("c", 1)):
        for _ in range(n):
            data.append((pid, 2000, 1, a)); pid += 1
    # month 2000-02 only author a
    data.append((pid, 2000, 2, "a")); pid += 1
    # December 1999 for the January lag
    data.append((pid, 1999, 12, "c")); pid += 1
    df = spark.createDataFrame(data, "post_id INT, year INT, month INT, author STRING")
    r = R.rank_within_month(df, "author")
    got = {(x["year"], x["month"], x["author"]): x["author_rank"] for x in r.collect()}
    assert got[(2000, 1, "a")] == 1 and got[(2000, 1, "b")] == 1 and got[(2000, 1, "c")] == 2
    lag = R.cap_rank(R.rank_within_month(df, "author", lag_months=1), "author_rank", 10, fill_missing=True)
    got = {(x["year"], x["month"], x["author"]): x["author_rank"] for x in lag.collect()}
    assert got[(2000, 1, "c")] == 1       # December 1999 -> January 2000
    assert got[(2000, 1, "a")] == 11      # absent in the previous month
    assert got[(2000, 2, "a")] == 1


def test_cap_rank(spark):
    df = spark.createDataFrame([(10,), (11,), (12,), (None,)], "r INT")
    assert [x["r"] for x in R.cap_rank(df, "r", 10).collect()] == [10, 11, 11, None]


def test_factorize_vs_category_code(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a"), (3, "z"), (4, None), (5, "m")], "post_id INT, v STRING")
    f = E.factorize(df, "v", "post_id", "fi")
    assert rows(f, "post_id", "fi") == [(1, 0), (2, 1), (3, 0), (4, -1), (5, 2)]
    c = E.category_code(df, "v", "cc")
    assert rows(c, "post_id", "cc") == [(1, 3), (2, 1), (3, 3), (4, 0), (5, 2)]


def _posts(spark, spec):
    """spec: list of (post_id, item_author, article_author, article_source, stock_code, viral)."""
    return spark.createDataFrame(spec, "post_id INT, item_author STRING, article_author STRING, "
                                       "article_source STRING, stock_code INT, viral INT")


@pytest.mark.parametrize("n3", [0, 1, 2, 3, 10])
def test_ladder_candidate_counts(spark, n3):
    spec = [(0, "a", "b", "s", 1, 1)]
    pid = 1
    for _ in range(n3):
        spec.append((pid, "a", "b", "s", 9, 0)); pid += 1
    for _ in range(2):  # same source only
        spec.append((pid, "x", "y", "s", 8, 0)); pid += 1
    for _ in range(2):  # same stock only
        spec.append((pid, "x", "y", "t", 1, 0)); pid += 1
    out = SM.sample_negatives_ladder(_posts(spark, spec), k=3)
    got = [r["neg_post_id"] for r in out.collect()]
    assert len(got) == 3 and len(set(got)) == 3
    if n3 >= 3:
        assert all(1 <= g <= n3 for g in got)
    else:
        # three-key candidates also share the source, so all negatives but none else are candidates
        assert set(got) <= set(range(1, pid)) and (n3 == 0 or set(got) & set(range(1, pid)))


def test_ladder_total_below_k(spark):
    spec = [(0, "a", "b", "s", 1, 1), (1, "a", "b", "s", 5, 0)]
    out = SM.sample_negatives_ladder(_posts(spark, spec), k=3)
    assert [r["neg_post_id"] for r in out.collect()] == [1]


def test_ladder_null_source_never_matches(spark):
    spec = [(0, "a", "b", None, 1, 1), (1, "a", "b", None, 2, 0), (2, "q", "r", "s", 1, 0)]
    out = SM.sample_negatives_ladder(_posts(spark, spec), k=3)
    assert [r["neg_post_id"] for r in out.collect()] == [2]


def test_fallback_rules(spark):
    spec = [
        (0, "a", "b", "s", 1, 1), (1, "x", "y", "z", 1, 0),                  # 0 three-key -> stock
        (2, "c", "d", "e", 7, 1),                                            # nothing -> skipped
        (3, "f", "g", "h", 3, 1), (4, "f", "g", "h", 4, 0),                  # exactly 1
    ] + [(10 + i, "k", "l", "m", 5, 0) for i in range(15)] + [(9, "k", "l", "m", 6, 1)]  # > k
    out = SM.sample_negatives_fallback(_posts(spark, spec), k=10)
    by = {}
    for r in out.collect():
        by.setdefault(r["post_id"], []).append(r["neg_post_id"])
    assert by[0] == [1] and 2 not in by and by[3] == [4]
    assert len(by[9]) == 10 and len(set(by[9])) == 10


def test_sampler_stable_under_repartition(spark):
    spec = [(i, f"a{i % 3}", "b", f"s{i % 2}", i % 4, int(i % 7 == 0)) for i in range(200)]
    df = _posts(spark, spec)
    a = rows(SM.sample_negatives_ladder(df, k=3), "post_id", "neg_post_id")
    b = rows(SM.sample_negatives_ladder(df.repartition(7), k=3), "post_id", "neg_post_id")
    assert a == b
    # fewer hash buckets change the ring order, never the rule: k distinct each
    c = SM.sample_negatives_ladder(df, k=3, buckets=3).groupBy("post_id").agg(
        F.count("*").alias("n"), F.countDistinct("neg_post_id").alias("d")).collect()
    assert all(r["n"] == 3 and r["d"] == 3 for r in c)


def test_label_top_fraction_small_n(spark):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate([0.1, 0.9, 0.9, 0.5])], "post_id INT, score DOUBLE")
    out = R.label_top_fraction(df, "score", 0.01)
    assert rows(out, "post_id", "pred") == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_label_top_fraction_threshold_ties(spark):
    scores = [1.0] * 3 + [0.5] * 197
    df = spark.createDataFrame(list(enumerate(scores)), "post_id INT, score DOUBLE")
    out = R.label_top_fraction(df, "score", 0.01)  # n1 = 2 -> threshold 1.0
    assert out.filter("pred = 1").count() == 3


def test_global_row_number_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 17).alias("g"))
    a = R.global_row_number(df, [("g", False), ("id", True)], "rn", num_partitions=5)
    b = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("g").desc(), "id")))
    assert rows(a, "id", "rn") == rows(b, "id", "rn")


def test_ndcg_edges(spark):
    zeros = spark.createDataFrame([(i, 0, float(i)) for i in range(5)], "post_id INT, y INT, score DOUBLE")
    assert M.ndcg(zeros, k=None).first()["ndcg"] == 0.0
    ideal = spark.createDataFrame([(i, 5 - i, float(10 - i)) for i in range(5)], "post_id INT, y INT, score DOUBLE")
    assert abs(M.ndcg(ideal, k=None).first()["ndcg"] - 1.0) < 1e-12
    assert abs(M.ndcg(ideal, k=1).first()["ndcg"] - 1.0) < 1e-12
    with pytest.raises(ValueError):
        M.ndcg(ideal, k=-1)


def test_ndcg_ties_averaged(spark):
    # two tied scores, one relevant: the tie shares the gain over ranks 1 and 2
    df = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "post_id INT, y INT, pred DOUBLE")
    got = M.ndcg_tie_averaged(df, "y", "pred").first()["ndcg"]
    expect = (0.5 * (1 + 1 / math.log2(3))) / 1.0
    assert abs(got - expect) < 1e-12


def test_r2_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y DOUBLE, p DOUBLE")
    assert M.r2(df, "y", "p").first()["r2"] is None
    df2 = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y DOUBLE, p DOUBLE")
    assert M.adj_r2(df2, "y", "p", 1).first()["adj_r2"] is None  # n = p + 1


def test_classification_report_unpredicted_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y INT, pred INT")
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["f1"] == 0.0
    assert abs(rep["accuracy"]["f1"] - 1 / 3) < 1e-12
    one = spark.createDataFrame([(1, 1), (1, 1)], "y INT, pred INT")
    rep = {r["label"]: r for r in M.classification_report(one).collect()}
    assert rep["1"]["f1"] == 1.0 and rep["accuracy"]["support"] == 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (1.5,), (-2.0,), (0.0,)], "x DOUBLE")
    h = {r["bin"]: r["n"] for r in Rel.histogram(df, "x", -1.0, 1.0, 200).collect()}
    assert h[0] == 1 and h[199] == 1 and h[100] == 1 and sum(h.values()) == 3 and len(h) == 200


def test_clean_and_tokenize(spark):
    vals = ["股票 上涨！", "Éléphant café 123", "!!!", "", None, "a_b 9x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id INT, t STRING")
    c = T.clean_text(df, "t", "c")
    got = {r["id"]: r["c"] for r in c.collect()}
    assert got[0] == "股票 上涨" and got[1] == "Éléphant café " and got[2] == "" and got[4] is None
    assert got[5] == "a_b x"
    tok = {r["id"]: r["tokens"] for r in T.tokenize(df, "t").collect()}
    assert tok[1] == ["éléphant", "café", "123"] and tok[2] == [] and tok[3] == []


def test_lexicon_sentiment_edges(spark):
    df = spark.createDataFrame([(1, ["zz", "yy"]), (2, []), (3, ["good", "zz"])], "id INT, tokens ARRAY<STRING>")
    lex = spark.createDataFrame([("good", 1.0)], "word STRING, score DOUBLE")
    got = {r["id"]: r["s"] for r in T.lexicon_sentiment(df, "id", "tokens", lex, 0.0, out="s").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.5}


def test_encode_tokens_lengths(spark):
    toks = [["a"] * 5, ["b"] * 32, ["a", "b"] * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "id INT, tokens ARRAY<STRING>")
    vocab = T.vocabulary(df, "tokens", 1)
    out = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in T.encode_tokens(df, "id", "tokens", vocab).collect()}
    assert out[0][0] == [1] * 5 + [0] * 27 and out[0][1] == [1] * 5 + [0] * 27
    assert out[1][0] == [2] * 32 and sum(out[1][1]) == 32
    assert out[2][0] == [1, 2] * 16


def test_dominant_topic_first_wins(spark):
    df = spark.createDataFrame([(0.2, 0.5, 0.5), (0.7, 0.1, 0.2)], "topics_val1 DOUBLE, topics_val2 DOUBLE, topics_val3 DOUBLE")
    out = R.dominant_topic(df, ["topics_val1", "topics_val2", "topics_val3"])
    assert [r["dominant_topic"] for r in out.collect()] == [2, 1]


def test_log_clip(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (0.5,), (100.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(S.log_clip("x")).collect()] == [None, 0.0, 0.0, 2.0]


def test_reduce_top_n_ties_by_value(spark):
    data = [(i, v) for i, v in enumerate(["b", "a", "c", "c", None])]
    df = spark.createDataFrame(data, "id INT, v STRING")
    out = E.reduce_to_top_n(df, "v", 2)
    assert rows(out, "id", "v_reduced") == [(0, "Others"), (1, "a"), (2, "c"), (3, "c"), (4, "Others")]


@pytest.mark.parametrize("asc", [True, False])
def test_kth_row_band_path_is_exact(spark, asc):
    import random
    rnd = random.Random(9)
    data = [(i, float(rnd.randint(0, 300))) for i in range(5000)]   # many ties
    df = spark.createDataFrame(data, "post_id INT, score DOUBLE")
    order = [("score", asc), ("post_id", True)]
    brute = sorted(data, key=lambda r: ((r[1] if asc else -r[1]), r[0]))
    for k in (1, 37, 250, 2500, 4999, 5000):
        row, n, kk = R.kth_row(df, order, lambda n, k=k: k)
        assert n == 5000 and (row["post_id"], row["score"]) == brute[k - 1]


def test_char_ngram_tokens(spark):
    df = spark.createDataFrame([(1, "股票上涨"), (2, "ab")], "id INT, t STRING")
    got = {r["id"]: r["tokens"] for r in T.tokenize(df, "t", mode="char_ngram", n=2).collect()}
    assert got[1] == ["股票", "票上", "上涨"] and got[2] == ["ab"]


def test_pluggable_batch_encoder(spark):
    import numpy as np
    from kestrel.operators.models import embed_text_with

    def make_predict_fn():
        def predict(texts):
            return np.stack([[float(len(t)), float(t.count("a"))] for t in texts]).astype(np.float32)
        return predict

    df = spark.createDataFrame([(1, "banana"), (2, "kiwi")], "id INT, t STRING")
    out = {r["id"]: r["embedding"] for r in embed_text_with(df, make_predict_fn, "t", 2).collect()}
    assert out[1] == [6.0, 3.0] and out[2] == [4.0, 0.0]


def test_label_encoder_fitted_on_train_only(spark):
    train = spark.createDataFrame([("b",), ("a",)], "v STRING")
    test = spark.createDataFrame([("a",), ("c",)], "v STRING")
    codes = E.fit_label_encoder(train, "v")
    out = {r["v"]: r["v_label"] for r in E.apply_label_encoder(test, codes, "v").collect()}
    assert out == {"a": 0, "c": -1}


def test_zscore_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x DOUBLE")
    assert sorted(r["x_z"] for r in E.zscore(df, "x").collect()) == [-1.0, 1.0]
    const = spark.createDataFrame([(2.0,), (2.0,)], "x DOUBLE")
    assert all(r["x_z"] is None for r in E.zscore(const, "x").collect())


def test_one_hot_and_class_weights(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id INT, v STRING")
    oh = {r["id"]: (r["v_a"], r["v_b"]) for r in E.one_hot(df, "v").collect()}
    assert oh == {1: (1, 0), 2: (0, 1), 3: (1, 0)}
    w = {r["v"]: r["weight"] for r in E.class_weights(df, "v").collect()}
    assert abs(w["a"] - 3 / 4) < 1e-12 and abs(w["b"] - 3 / 2) < 1e-12


def test_outcome_codes(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 1)], "y INT, pred INT")
    assert [r["outcome"] for r in M.outcome_code(df).collect()] == [2, 0, -1, 1]
