"""The weak-label classifier, the registry and the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kestrel.llm import queries, weak_labels
from kestrel.llm.common import materialize

from . import fixtures as X


def test_label_model_finds_accuracies():
    import random
    rng = random.Random(4)
    acc = [0.95, 0.8, 0.7]
    pats: dict[str, int] = {}
    for _ in range(20000):
        good = rng.random() < 0.5
        p = "".join("-" if rng.random() < 0.3 else "g" if (rng.random() < a) == good else "b" for a in acc)
        pats[p] = pats.get(p, 0) + 1
    m = weak_labels.fit_label_model(pats)
    assert all(abs(a - b) < 0.08 for a, b in zip(m["accuracy"], acc, strict=True))
    assert m["posterior"]["ggg"] > 0.95 and m["posterior"]["bbb"] < 0.05 and m["posterior"]["---"] == 0.5
    assert weak_labels.fit_label_model({})["posterior"] == {}


def test_classifier_held_out(spark):
    """Trained without labels; the labels table is only used here."""
    sf = "/root/testdata/sf0.01"
    got = weak_labels.op8_quality_classifier(spark, sf)
    gold = spark.read.parquet(f"{sf}/labels.parquet").join(got, "doc_id")
    r = gold.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("acc"),
                 F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("recall")).first()
    assert r["acc"] >= 0.95 and r["recall"] >= 0.98
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_classifier_odd_rows(spark):
    df, rows = X.documents(spark)
    got = weak_labels.classify_quality(df)
    assert got.count() == len(rows) and len(set(got.columns)) == len(got.columns)
    assert got.where("score is null or kept is null").count() == 0
    assert weak_labels.classify_quality(X.empty(spark)).count() == 0
    assert weak_labels.classify_quality(X.frame(spark, [(1, None, None), (2, "", None)])).where("kept").count() == 2


def test_registry(spark, sf):
    import __spark_entry__ as E
    names = set(E.queries())
    assert set(queries.QUERIES) <= names and {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in queries.QUERIES if n != "pipeline"}
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    import duckdb

    from tools.oracle_check import TABLES, digest, type_mismatches
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert set(cols) == set(df.columns) and len(got) == len(want)
    assert not type_mismatches(df.schema, cur.description)
    assert digest(df.columns, got) == digest(cols, want)


def test_pipeline(spark, sf):
    """Stage by stage against the operators' own brute-force checks."""
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES][:2] == ["quality_rules", "near_duplicates"] and len(P.STAGES) == 5
    stage = dict(P.STAGES)
    good = materialize(stage["quality_rules"](spark, docs, sf), "test")
    assert good.columns == docs.columns
    judged = queries.QUERIES["op4_quality_rules"](spark, sf)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in judged.where("kept").collect()}
    one = materialize(stage["near_duplicates"](spark, good, sf), "test")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in X.jaccard(rows, 5, 80)})
    clean = materialize(stage["decontaminate"](spark, one, sf), "test")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect() if not any(t in r["text"] for t in items)}
    mixed = materialize(stage["mix"](spark, clean, sf), "test")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    last = materialize(P.run(spark, sf), "test")
    assert last.columns == [*docs.columns, "size", "shard", "slot"]
    key = ["doc_id", "text", "lang", "source", "n_chars"]
    assert last.select(key).exceptAll(mixed.select(key)).count() == 0 and last.count() == mixed.count()
    per = last.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("k")).collect()
    assert all(r["n"] == r["k"] == r["m"] + 1 for r in per)
