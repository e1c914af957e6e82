"""Deterministic hashing shared by Spark and the SQL oracle.

``hash_int(parts)`` is the first 15 hex digits of ``md5`` of the parts joined
with ``'|'``, read as an unsigned 60-bit integer.  Unlike Spark's ``hash`` or
``rand`` it has the same value in any SQL engine that offers ``md5``, does not
depend on partitioning, and survives task retries unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_60 = float(1 << 60)


def hash_str(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash_int(*parts) -> Column:
    """Unsigned 60-bit integer from md5 of ``'|'``-joined parts (BIGINT)."""
    return F.conv(F.substring(F.md5(hash_str(*parts)), 1, 15), 16, 10).cast("bigint")
