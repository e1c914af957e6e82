"""Sources and sinks."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_path


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               columns: list[str] | None = None, fmt: str | None = None,
               header: bool = True) -> DataFrame:
    """A1/A2: read Parquet or CSV with a declared schema; ``columns`` prunes
    (for Parquet the pruning reaches the scan's ReadSchema)."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", header).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    else:
        df = r.format(fmt).load(path)
    return df.select(*columns) if columns else df


def read_capped(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """A3: the first ``n`` rows in a stated order (file order is undefined)."""
    return df.orderBy(*order).limit(n)


def drop_index_columns(df: DataFrame) -> DataFrame:
    """A5: drop stored row-index columns (``Unnamed: 0``, ``Unnamed: 0.1``, ...)."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed: ")])


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, stripped, deduplicated, blanks dropped."""
    return (spark.read.text(path).select(F.trim("value").alias("word"))
            .filter(F.col("word") != "").distinct())


def parse_lexicon(lines: DataFrame, col: str = "value") -> DataFrame:
    """A7 on a column of ``word score`` lines: keep lines with exactly two
    whitespace-separated fields whose second field is a number."""
    parts = F.split(F.trim(F.col(col)), r"\s+")
    return (lines.select(parts.alias("_p"))
            .filter(F.size("_p") == 2)
            .select(F.col("_p")[0].alias("word"),
                    F.expr("try_cast(_p[1] AS DOUBLE)").alias("score"))
            .filter(F.col("score").isNotNull()))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon file with ``word score`` lines."""
    return parse_lexicon(spark.read.text(path))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Table sink (Parquet by default; CSV with a header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


write_report = write_table


#: Quoting of delimited files: a quote inside a value is doubled, blanks are kept, an
#: empty string is a quoted one and null an unquoted nothing.
_DELIMITED = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
              "ignoreTrailingWhiteSpace": False, "nullValue": "", "encoding": "UTF-8"}


def write_delimited(df: DataFrame, path: str, sep: str, mode: str = "overwrite", max_records: int = 0) -> None:
    """Delimited text with a custom separator; values that hold the separator, a
    quote or a line break are quoted (unlike a hand-joined line).  Files of at most
    ``max_records`` rows (0: no limit) bound what one reader's task gets, since files
    with line breaks inside values cannot be split."""
    w = df.write.mode(mode).options(**_DELIMITED).option("header", True).option("sep", sep).option("emptyValue", '""')
    w.option("maxRecordsPerFile", max_records).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str,
                   header: bool = True, malformed: str | None = None) -> DataFrame:
    """A4: delimited text with a custom single-character separator and a declared schema,
    line breaks inside quoted values included.  With ``malformed`` a record that does not
    fit the schema keeps its raw text in a column of that name (null for good records).
    A quoted nothing reads as an empty string, an unquoted one as null; a text that is one
    NUL character alone reads as empty."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    r = spark.read.options(**_DELIMITED).option("header", header).option("sep", sep).option("emptyValue", "\u0000")
    r = r.option("multiLine", True).option("mode", "PERMISSIVE")
    if malformed:
        schema = StructType(schema.fields).add(malformed, "string")
        r = r.option("columnNameOfCorruptRecord", malformed)
    df = r.schema(schema).csv(path)  # the reader takes "" itself for null
    texts = {f.name for f in schema if f.dataType.simpleString() == "string"} - {malformed}
    return df.select(*[F.when(F.col(f"`{c}`") == "\u0000", "").otherwise(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`")
                       for c in df.columns])


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object: any store Spark can read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has finished writing ``path``."""
    fs, p = file_system(spark, path.rstrip("/") + "/_SUCCESS")
    return fs.exists(p)


def fingerprint(spark: SparkSession, paths: list[str], *versions: str) -> str:
    """Hash of every file's path, length and time below ``paths`` (files or
    folders, on any store) and of ``versions``."""
    h = hashlib.md5()
    for path in sorted(paths):
        fs, p = file_system(spark, path)
        files = fs.listFiles(p, True)
        names = []
        while files.hasNext():
            f = files.next()
            names.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        h.update("\n".join(sorted(names)).encode())
    for v in versions:
        h.update(v.encode())
    return h.hexdigest()[:16]


def materialize_once(df, path: str, spark: SparkSession | None = None) -> DataFrame:
    """A10: compute and write the table only when ``path`` holds no finished
    one, then read the stored table (lineage is cut at the write).  ``df`` may
    be a DataFrame or a function building it, called only when needed.

    The table is written under a fresh name and renamed when its ``_SUCCESS``
    mark is there, so a write that died is never read; what such a write (of
    anyone) left under ``path`` itself is moved aside."""
    spark = spark or df.sparkSession
    if not is_complete(spark, path):
        fresh = f"{path}.{uuid.uuid4().hex}"
        (df() if callable(df) else df).write.parquet(fresh)
        fs, p = file_system(spark, path)
        if not is_complete(spark, path):  # else another session was first: read its table
            if fs.exists(p):
                fs.rename(p, file_system(spark, f"{fresh}.unfinished")[1])
            fs.rename(file_system(spark, fresh)[1], p)
    return spark.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared ``spark.checkpoint.dir``:
    column pruning and filter pushdown still work on what is read back."""
    path = shared_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_metadata(meta: DataFrame, path: str) -> None:
    """One row per feature (feature, role, cardinality)."""
    meta.coalesce(1).write.mode("overwrite").parquet(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    return {r["feature"]: r["cardinality"] for r in spark.read.parquet(path).collect()}


def save_model(model, path: str) -> None:
    """Spark ML model persistence."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_table(spark, table_path(sf_dir, name), columns=columns)
