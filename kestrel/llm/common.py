"""Shared helpers: tables in the cluster's shared folder, reading, hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import shared_path

#: Java and RE2 class of word characters (a word is a maximal run of these).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder (spark.checkpoint.dir) and read it back:
    cuts lineage, survives lost executors, keeps column pruning.  A fresh name
    every time, so a write that died is never read."""
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names built from `names` that do not clash with df's own
    (names compare without case, as Spark resolves them)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def word_array(text: Column) -> Column:
    """The words of a text (null: none) as an array, JVM-side."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row (a lambda variable), where
    plain reuse would let the optimiser copy the expression into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Size of membership filters sent to Python workers (2 MB), whatever the corpus.
BITMAP_BITS = 1 << 24


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> bytes:
    """A bit set at pmod(col, bits) for every row, built by Spark: the driver gets
    bits / 32768 rows of 4 kB at most."""
    b = F.pmod(F.col(col), F.lit(bits))
    rows = (df.select(b.alias("b")).groupBy(F.floor(F.col("b") / 32768).alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod("b", F.lit(32768)) + 1)).alias("m")).collect())
    out = bytearray(bits // 8)
    for k, m in rows:
        out[k * 4096:(k + 1) * 4096] = m
    return bytes(out)


def in_bitmap(mask: bytes, values: np.ndarray) -> np.ndarray:
    """Whether each (signed 64-bit) value's bit is set."""
    at = values.astype(np.int64) % np.int64(len(mask) * 8)
    return np.frombuffer(mask, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
