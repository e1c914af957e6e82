"""A training-data pipeline: five stages over the documents table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again as the next stage's docs.  All but the last return the columns of documents.

1. quality_rules: documents that the base rules or the n-gram score reject go.
2. near_duplicates: one document of each group of similar documents (Jaccard of
   five-word shingles 0.8 or more) stays.
3. decontaminate: documents that hold a benchmark item go.
4. mix: sources are brought to their target weights by Poisson replication.
5. shard: everything is put into 16 shards of near-equal bytes, with slots.

Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import materialize, read
from kestrel.llm.decontaminate import decontaminate
from kestrel.llm.jaccard import drop_near_duplicates
from kestrel.llm.mixing import mix_sources
from kestrel.llm.quality_rules import judge_quality
from kestrel.llm.sharding import shard_by_bytes

N_SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge_quality(docs, read(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five-word shingles and 80 %; operator 6's own query has other limits
    return drop_near_duplicates(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot."""
    return shard_by_bytes(docs, N_SHARDS)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", without_benchmark),
          ("mix", mix), ("shard", shard)]

#: Hashes of the quality score and the shards' key have no SQL counterpart; tests
#: hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
