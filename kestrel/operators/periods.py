"""A stored classifier applied to one later period at a time."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_model
from .models import embed_tokens


def embedded(df: DataFrame, ids: str, make_encoder, length: int) -> DataFrame:
    """df with ``features``: the mean-pooled embedding of its token ids as a vector."""
    return embed_tokens(df, ids, make_encoder, length, out="_e").withColumn("features", array_to_vector("_e")).drop("_e")


def classify_period(spark: SparkSession, posts: DataFrame, id_col: str, period_col: str, period: str, ids: str,
                    make_encoder, length: int, model_path: str, sink: str) -> None:
    """Read the posts of ``period``, embed their token ids, predict with the model stored
    under ``model_path`` and write (id, topic) to the period's own folder of ``sink``.

    A rerun replaces that folder's files and touches no other period's; a run that died is
    mended by running the period again.  A period without posts leaves an empty table;
    rows with a null period belong to none; repeated rows are classified each."""
    rows = posts.where(F.col(period_col) == period).select(F.col(id_col).alias("_id"), F.col(ids).alias("_ids"))
    got = load_model(model_path).transform(embedded(rows, "_ids", make_encoder, length))
    got = got.select(F.col("_id").alias(id_col), F.col("prediction").cast("int").alias("topic"))
    got.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/period={period}")


def read_periods(spark: SparkSession, sink: str, id_col: str = "post_id", id_type: str = "long") -> DataFrame:
    """(id, topic, period): what the finished periods of ``sink`` hold."""
    return spark.read.schema(f"`{id_col}` {id_type}, topic int, period string").parquet(sink)
