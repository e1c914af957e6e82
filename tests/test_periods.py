"""One later period at a time, by a stored model."""

from __future__ import annotations

from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import __spark_entry__ as E
from kestrel import config as C
from kestrel.operators import models as ML
from kestrel.operators import periods as P
from kestrel.sources import adapters as A
from kestrel.sources.tables import save_model


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).glob("*.parquet")}


def test_a_rerun_touches_its_own_period_only(spark, tmp_path):
    rows = [(i, ["p1", "p2", None][i % 3], [i, i % 5, 0, 0], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "post_id long, period string, ids array<long>, label double")
    enc, model, sink = ML.hashed_encoder(3), str(tmp_path / "model"), str(tmp_path / "topics")
    fitted = PipelineModel(stages=[ML.fit_topic_classifier(P.embedded(df, "ids", enc, 4), "features", "label", 3, 2, hidden=(4,), max_iter=5)])
    save_model(fitted, model)

    def run(posts, period):
        P.classify_period(spark, posts, "post_id", "period", period, "ids", enc, 4, model, sink)

    for period in ("p1", "p2", "p3"):  # p3 has no posts
        run(df, period)
    want = {(r["post_id"], r["period"]): int(r["prediction"]) for r in
            fitted.transform(P.embedded(df.where("period IS NOT NULL"), "ids", enc, 4)).collect()}
    back = {(r["post_id"], r["period"]): r["topic"] for r in P.read_periods(spark, sink).collect()}
    assert back == want and len(back) == 40
    before = files(f"{sink}/period=p1")
    run(df.where("post_id < 30"), "p2")
    assert files(f"{sink}/period=p1") == before
    again = P.read_periods(spark, sink)
    assert again.where("period = 'p2'").count() == 10 and again.where("period = 'p1'").count() == 20


def test_query_classifies_every_later_text(spark, sf):
    got = E.queries()["classify_periods"](spark, sf)
    later = A.texts(spark, sf).where(F.col("year_month").between(C.SPLITS[1][1], C.SPLITS[-1][2]))
    assert sorted(r[0] for r in got.select("post_id").collect()) == sorted(r[0] for r in later.select("post_id").collect())
    assert {r[0] for r in got.select("topic").distinct().collect()} <= {0, 1}
