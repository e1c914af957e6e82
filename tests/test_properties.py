"""Properties on seeded random data and the test tables."""

import random

from pyspark.sql import functions as F

from kestrel import config as C
from kestrel.operators import encode as E
from kestrel.operators import metrics as M
from kestrel.operators import models as ML
from kestrel.operators import relational as Rel
from kestrel.operators import splits as SP
from kestrel.sources import adapters as A


def test_chrono_split_disjoint_and_covering(spark, sf):
    p = A.posts_base(spark, sf)
    s = SP.chrono_split(p, "year_month", C.SPLITS, keep_unassigned=True)
    assert s.filter(F.col("split").isNull()).count() == 0          # 1995-01 .. 2001-08 all covered
    assert s.groupBy("post_id").count().filter("count > 1").count() == 0


def test_random_split_stable_and_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "post_id")
    a = SP.random_split(df, [8, 1, 1], 42, names=["tr", "va", "te"])
    b = SP.random_split(df.repartition(13), [8, 1, 1], 42, names=["tr", "va", "te"])
    ca = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    cb = {r["split"]: r["count"] for r in b.groupBy("split").count().collect()}
    assert ca == cb and sum(ca.values()) == 5000 and 3700 < ca["tr"] < 4300


def test_codes_are_a_bijection(spark, sf):
    p = A.posts_base(spark, sf)
    f = E.factorize_many(p, {"item_author": "ia", "IndustryCode2": "i2"})
    for col, code in (("item_author", "ia"), ("IndustryCode2", "i2")):
        pairs = f.select(col, code).distinct()
        assert pairs.count() == pairs.select(col).distinct().count() == pairs.select(code).distinct().count()
        mx = f.agg(F.max(code)).first()[0]
        assert mx == pairs.count() - 1


def test_ndcg_bounds(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, rnd.randint(0, 3), rnd.random()) for i in range(300)],
                               "post_id INT, y INT, score DOUBLE")
    for k in (None, 0.1, 5):
        v = M.ndcg(df, k=k).first()["ndcg"]
        assert 0.0 <= v <= 1.0
    ideal = df.withColumn("score", F.col("y").cast("double") + F.lit(0.0))
    assert abs(M.ndcg(ideal, k=None).first()["ndcg"] - 1.0) < 1e-9


def test_pivot_and_confusion_totals(spark, sf):
    p = A.posts_base(spark, sf)
    n = p.count()
    piv = Rel.pivot_counts(p, "year", "topic", [0, 1, 2])
    assert piv.agg(F.sum(F.col("0") + F.col("1") + F.col("2"))).first()[0] == n
    s = A.scored(spark, sf)
    assert M.confusion_matrix(s).agg(F.sum("n")).first()[0] == s.count()


def test_pairwise_ranker_recovers_planted_order(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        a, b = [rnd.random() for _ in range(2)], [rnd.random() for _ in range(2)]
        # the planted score 2·f1 - f2 decides which side is the positive
        sa, sb = 2 * a[0] - a[1], 2 * b[0] - b[1]
        pos, neg = (a, b) if sa > sb else (b, a)
        rows.append((i, pos[0], pos[1], neg[0], neg[1]))
    pairs = spark.createDataFrame(rows, "post_id INT, f1 DOUBLE, f2 DOUBLE, neg_f1 DOUBLE, neg_f2 DOUBLE")
    m = ML.fit_pairwise_ranker(pairs, ["f1", "f2"])
    w = m.coefficients.toArray()
    assert w[0] > 0 and w[1] < 0


def test_classifier_beats_majority_and_is_repeatable(spark):
    rnd = random.Random(11)
    rows = [(i, float(x), float(int(x + rnd.gauss(0, 0.1) > 0.5))) for i, x in ((i, rnd.random()) for i in range(600))]
    df = ML.assemble(spark.createDataFrame(rows, "post_id INT, x DOUBLE, viral DOUBLE"), ["x"])
    a = ML.fit_forest_fixed(df, depth=4, trees=10, seed=1)
    b = ML.fit_forest_fixed(df, depth=4, trees=10, seed=1)
    acc = a.transform(df).agg(F.avg((F.col("prediction") == F.col("viral")).cast("double"))).first()[0]
    major = max(df.agg(F.avg("viral")).first()[0], 1 - df.agg(F.avg("viral")).first()[0])
    assert acc > major
    assert a.featureImportances == b.featureImportances
