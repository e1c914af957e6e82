"""Sources and sinks (A4-A13): round trips through files."""

from pyspark.sql import functions as F

from kestrel.sources import tables as IO


def test_delimited_round_trip_quotes_separator(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b", 0.5), (2, "plain", None)], "id INT, title STRING, x DOUBLE")
    path = str(tmp_path / "pairs")
    IO.write_delimited(df, path, "<")
    back = IO.read_delimited(spark, path, "id INT, title STRING, x DOUBLE", "<")
    assert sorted(back.collect()) == sorted(df.collect())


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id INT, v STRING")
    for fmt in ("csv", "parquet"):
        p = str(tmp_path / f"t.{fmt}")
        IO.write_table(df, p, fmt=fmt)
        back = IO.read_table(spark, p, "id INT, v STRING", fmt=fmt)
        assert sorted(back.collect()) == sorted(df.collect())
    pruned = IO.read_table(spark, str(tmp_path / "t.parquet"), columns=["v"])
    assert pruned.columns == ["v"]


def test_drop_index_columns(spark):
    df = spark.createDataFrame([(0, 0, 5)], "`Unnamed: 0` INT, `Unnamed: 0.1` INT, v INT")
    assert IO.drop_index_columns(df).columns == ["v"]


def test_wordlist_and_lexicon(spark, tmp_path):
    w = tmp_path / "words.txt"
    w.write_text(" the \nthe\na\n\n", encoding="utf-8")
    assert sorted(r["word"] for r in IO.read_wordlist(spark, str(w)).collect()) == ["a", "the"]
    lx = tmp_path / "lex.txt"
    lx.write_text("good 0.8\nbad -0.5\nthree fields 1\nword notanumber\n  spaced   0.1  \n", encoding="utf-8")
    got = {r["word"]: r["score"] for r in IO.read_lexicon(spark, str(lx)).collect()}
    assert got == {"good": 0.8, "bad": -0.5, "spaced": 0.1}


def test_materialize_once(spark, tmp_path):
    p = str(tmp_path / "once")
    a = IO.materialize_once(spark.range(3), p)
    b = IO.materialize_once(spark.range(10), p)  # already there: not recomputed
    assert a.count() == 3 and b.count() == 3


def test_metadata_round_trip(spark, tmp_path):
    meta = spark.createDataFrame([("month", "post", 13), ("topic", "post", 3)], "feature STRING, role STRING, cardinality INT")
    p = str(tmp_path / "meta")
    IO.save_metadata(meta, p)
    assert IO.load_metadata(spark, p) == {"month": 13, "topic": 3}


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1.0, 2.0)], "a DOUBLE, b DOUBLE")
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")]).fit(df)
    p = str(tmp_path / "model")
    IO.save_model(m, p)
    back = IO.load_model(p)
    assert back.transform(df).select(F.col("f")).first()[0].toArray().tolist() == [1.0, 2.0]


def test_checkpointed_uses_shared_folder(spark):
    df = IO.checkpointed(spark.range(5).withColumn("y", F.col("id") * 2))
    assert df.count() == 5
    assert spark.conf.get("spark.checkpoint.dir")


def test_checkpoint_folder_without_the_setting(spark, monkeypatch):
    """A local session that names no folder gets one, and keeps it; a cluster has to name it."""
    from kestrel import session

    class Context:
        master, applicationId = "local[2]", "app-of-the-test"
        seen = None

        def getCheckpointDir(self):
            return self.seen

        def setCheckpointDir(self, d):
            self.seen = d

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    d = session.checkpoint_dir(Session)
    assert d and session.checkpoint_dir(Session) == d == Session.sparkContext.seen
    Session.sparkContext = Context()
    Session.sparkContext.master, Session.sparkContext.applicationId = "spark://host:7077", "another"
    import pytest
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session)
