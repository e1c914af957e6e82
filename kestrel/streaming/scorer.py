"""Score newly arrived posts with a stored model under Structured
Streaming.

The source is a file stream over the arriving table; each micro-batch is
scored with the same column expressions a batch job uses (no state, so no
watermark) and written to a Parquet sink through ``foreachBatch``, one folder
per batch id.  ``trigger(availableNow=True)`` processes everything present and
stops.  Given a stable ``base`` folder a later run goes on where the last one
ended: it scores the files that are new, and a batch that was written but not
committed is written over by the same batch id.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.tables import file_system


def run_available_now(stream_df: DataFrame, transform, sink_path: str, ckpt_path: str) -> None:
    def write_batch(batch: DataFrame, batch_id: int):
        (transform(batch).withColumn("_batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}"))

    q = (stream_df.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", ckpt_path).trigger(availableNow=True).start())
    q.awaitTermination()


def score_new_arrivals(spark: SparkSession, path: str, schema, transform,
                       max_files_per_trigger: int = 1000, base: str | None = None) -> DataFrame:
    """Stream a table (a folder of part files or a single file, on any store)
    through ``transform`` and return the sink as a batch DataFrame.

    ``base`` holds the checkpoint and the sink; runs that name the same one resume,
    without it every run starts afresh."""
    base = base.rstrip("/") if base else shared_path(spark, f"stream-{uuid.uuid4().hex}")
    sink = f"{base}/sink"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    fs, p = file_system(spark, path)
    if fs.isDirectory(p):
        stream = src.parquet(path)
    else:  # a file source watches folders: the file's folder, narrowed to its name
        folder, name = path.rsplit("/", 1)
        stream = src.option("pathGlobFilter", name).parquet(folder)
    out = transform(stream)
    run_available_now(stream, transform, sink, f"{base}/checkpoint")
    empty = spark.createDataFrame([], out.schema)
    empty.write.mode("overwrite").parquet(f"{sink}/batch=-1")  # the sink exists even if nothing arrived
    return spark.read.schema(out.schema).parquet(sink).select(*out.columns)


def fit_arrival_model(history: DataFrame, path: str) -> PipelineModel:
    """Least squares of the price on the author number over past posts, saved
    under ``path`` and loaded back: the stream scores with the stored model."""
    stages = [SQLTransformer(statement="SELECT *, CAST(o_custkey % 200 AS DOUBLE) AS author FROM __THIS__"),
              VectorAssembler(inputCols=["author"], outputCol="features"),
              LinearRegression(featuresCol="features", labelCol="o_totalprice", solver="normal")]
    Pipeline(stages=stages).fit(history.where("o_custkey IS NOT NULL AND o_totalprice IS NOT NULL")).write().overwrite().save(path)
    return PipelineModel.load(path)


def arrival_scorer(model: PipelineModel):
    """transform for :func:`score_new_arrivals`: (post_id, period, score)."""
    def score(batch: DataFrame) -> DataFrame:
        d = F.to_date("o_orderdate")
        return model.transform(batch).select(
            F.col("o_orderkey").alias("post_id"),
            F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")).alias("period"),
            F.round("prediction", 4).alias("score"))
    return score
