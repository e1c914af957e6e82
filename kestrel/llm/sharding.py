"""Operator 1, sharding by histogram sort (DataFrame functions only).

Rows are ordered by the key (63-bit hash of the text, id); equal texts are
neighbours.  Candidate boundaries in key space are probed by counting the exact
bytes below them, all partitions at once; cells that hold a wanted splitter are
probed again more finely until every splitter is within the tolerance of its
target; then the rows are exchanged once, by cell.

Cells are finer than shards (several per shard), so that neither the exchange
nor the numbering of rows inside a shard puts a shard into one task.  What the
driver sees per round is at most (cells x 2**bits) histogram rows.

Defined cases: a null text has size 1 and the key of the empty text; a null id
sorts as the smallest id; non-integer ids are ordered by their hash; rows that
repeat the same (text, id) form one indivisible key (they are neighbours, their
slots differ and follow a hash of the remaining columns); an empty table gives
an empty result; fewer rows than shards leave shards empty; input columns named
like the output columns are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, private, read

KEY_BITS = 63
FIRST_BITS = 12  # 4096 cells in the first round, and prefixes in the lookup table
NEXT_BITS = 8

_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _text_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))), 1)


def _id_key(df: DataFrame, id_col: str) -> Column:
    """Non-negative 63-bit key that keeps the order of integer ids up to the last bit."""
    c = F.col(f"`{id_col}`")
    if isinstance(df.schema[id_col].dataType, _INTEGERS):
        v = F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
        return F.shiftrightunsigned(v.bitwiseXOR(F.lit(-(1 << 63))), 1)
    return F.shiftrightunsigned(F.xxhash64(c), 1)


def _refine(keys: DataFrame, targets: list[float], tol: float) -> list[tuple[int, int, int]]:
    """Splitters as (h, id, j): rows with key >= (h, id) are right of target j.

    keys has columns h, i, size.  Each round holds, for every open target, one
    cell (a prefix of h, or of i under a fixed h) and the exact bytes below it.
    """
    found: list[tuple[int, int, int]] = []
    shift = KEY_BITS - FIRST_BITS
    rows = keys.groupBy(F.shiftright("h", shift).alias("p")).agg(F.sum("size").alias("b")).collect()
    hist = sorted((r["p"], r["b"]) for r in rows)

    def settle(cells, below, open_targets):
        """Place targets among ordered cells [(prefix, bytes)]; yield (j, prefix, below) left open."""
        k, acc = 0, below
        for j, t in open_targets:
            while k < len(cells) and acc + cells[k][1] <= t:
                acc += cells[k][1]
                k += 1
            if k == len(cells):
                yield j, None, acc  # exactly at the end of the cells
            else:
                yield j, cells[k][0], acc

    open_cells: dict[int, tuple[float, list]] = {}
    size_of = dict(hist)
    for j, p, acc in settle(hist, 0, list(enumerate(targets))):
        if p is None:
            found.append(((1 << KEY_BITS) - 1, (1 << KEY_BITS) - 1, j))
        elif targets[j] - acc <= tol:
            found.append((p << shift, 0, j))
        elif acc + size_of[p] - targets[j] <= tol:
            found.append(((p + 1) << shift, 0, j))
        else:
            open_cells.setdefault(p, (acc, []))[1].append((j, targets[j]))
    while open_cells and shift > 0:
        step = min(NEXT_BITS, shift)
        new = shift - step
        sub = (keys.where(F.shiftright("h", shift).isin(list(open_cells)))
               .groupBy(F.shiftright("h", new).alias("p")).agg(F.sum("size").alias("b")).collect())
        by: dict[int, list] = {}
        for r in sub:
            by.setdefault(r["p"] >> step, []).append((r["p"], r["b"]))
        nxt: dict[int, tuple[float, list]] = {}
        for cell, (below, wanted) in open_cells.items():
            cells = sorted(by[cell])
            size_of = dict(cells)
            for j, p, acc in settle(cells, below, wanted):
                if p is None:
                    found.append(((cell + 1) << shift, 0, j))
                elif targets[j] - acc <= tol:
                    found.append((p << new, 0, j))
                elif acc + size_of[p] - targets[j] <= tol:
                    found.append(((p + 1) << new, 0, j))
                else:
                    nxt.setdefault(p, (acc, []))[1].append((j, targets[j]))
        open_cells, shift = nxt, new
    if open_cells:  # single texts that hold a target: refine by id under a fixed h
        _refine_ids(keys, open_cells, targets, tol, settle, found)
    return sorted(found, key=lambda s: s[2])


def _refine_ids(keys, open_cells, targets, tol, settle, found) -> None:
    hot = keys.where(F.col("h").isin(list(open_cells)))
    spans = hot.groupBy("h").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).collect()
    open_ids = {}
    for r in spans:
        shift = (r["lo"] ^ r["hi"]).bit_length()
        below, wanted = open_cells[r["h"]]
        open_ids[(r["h"], r["lo"] >> shift)] = (shift, below, wanted)
    while open_ids:
        step = {k: min(NEXT_BITS, s) for k, (s, _, _) in open_ids.items()}
        probe = F.lit(None).cast("int")
        width = F.lit(None).cast("int")
        for (h, p), (shift, _, _) in open_ids.items():
            hit = (F.col("h") == F.lit(h)) & (F.shiftright("i", shift) == F.lit(p))
            width = F.when(hit, F.lit(shift - step[(h, p)])).otherwise(width)
            probe = F.when(hit, F.lit(shift)).otherwise(probe)
        sub = (hot.withColumns({"w": width, "s": probe}).where("w is not null")
               .groupBy("h", F.expr("shiftright(i, s)").alias("p"), F.expr("shiftright(i, w)").alias("q"))
               .agg(F.sum("size").alias("b")).collect())
        by: dict[tuple, list] = {}
        for r in sub:
            by.setdefault((r["h"], r["p"]), []).append((r["q"], r["b"]))
        nxt = {}
        for key, (shift, below, wanted) in open_ids.items():
            h, new = key[0], shift - step[key]
            cells = sorted(by[key])
            size_of = dict(cells)
            for j, q, acc in settle(cells, below, wanted):
                if q is None:
                    found.append((h, (key[1] + 1) << shift, j))
                elif targets[j] - acc <= tol or (new == 0 and targets[j] - acc <= acc + size_of[q] - targets[j]):
                    found.append((h, q << new, j))
                elif acc + size_of[q] - targets[j] <= tol or new == 0:
                    found.append((h, (q + 1) << new, j))
                else:
                    nxt.setdefault((h, q), (new, acc, []))[2].append((j, targets[j]))
        open_ids = nxt


def shard_by_bytes(df: DataFrame, n_shards: int = 16, text_col: str = "text", id_col: str = "doc_id",
                   cells_per_shard: int | None = None, tolerance: float = 0.001) -> DataFrame:
    """All rows of df with columns size, shard (0..n_shards-1) and slot (gapless
    from 0 inside each shard); shard sizes in bytes differ from the mean by at
    most `tolerance` of it plus one document at either end.

    cells_per_shard defaults to spark.sql.shuffle.partitions / n_shards.  The
    result is partitioned by cell and ordered by the key inside each cell.
    """
    spark = df.sparkSession
    df = df.drop(*[c for c in ("size", "shard", "slot") if c not in (text_col, id_col)])
    h, i, size, cell, rest, prefix, base, cuts, at_cell, first = private(
        df, "h", "i", "size", "cell", "rest", "prefix", "base", "cuts", "at_cell", "first")
    text = F.col(f"`{text_col}`").cast("string")
    keyed = df.withColumns({h: _text_key(text), i: _id_key(df, id_col),
                            size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1})
    keys = materialize(keyed.select(F.col(h).alias("h"), F.col(i).alias("i"), F.col(size).alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    if cells_per_shard is None:
        cells_per_shard = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_shards))
    n = n_shards * cells_per_shard
    targets = [total * j / n for j in range(1, n)]
    splitters = _refine(keys, targets, tolerance * total / n_shards) if total else []
    lookup = F.broadcast(_lookup(spark, splitters).toDF(prefix, base, cuts))
    place = lambda d, hc, ic: (
        d.join(lookup, F.shiftright(hc, KEY_BITS - FIRST_BITS) == F.col(prefix))
        .withColumn(cell, F.col(base) + F.size(F.filter(cuts, lambda s: (s["h"] < F.col(hc)) | ((s["h"] == F.col(hc)) & (s["i"] <= F.col(ic))))))
        .drop(prefix, base, cuts))
    counts = place(keys, "h", "i").groupBy(cell).count()
    shard = F.floor(F.col(cell) / F.lit(cells_per_shard)).cast("int")
    # one row per cell: at most n rows
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("shard", shard).select(
        F.col(cell).alias(at_cell), "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    # ids differ from their key by the last bit; equal keys are told apart by the other columns
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = Window.partitionBy(cell).orderBy(h, i, F.col(f"`{id_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in hashable if c != text_col]))
    out = place(keyed, h, i).withColumn(rest, F.row_number().over(order))
    out = out.join(F.broadcast(offsets), F.col(cell) == F.col(at_cell))
    keep = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*keep, F.col(size).alias("size"), "shard", (F.col(first) + F.col(rest) - 1).cast("long").alias("slot"))


def _lookup(spark: SparkSession, splitters) -> DataFrame:
    """One row per key prefix (4096): the cell of the prefix's first key and the
    splitters inside the prefix.  Broadcast: 4096 rows plus one entry per cell."""
    cuts: dict[int, list] = {}
    for h, i, _ in splitters:
        cuts.setdefault(min(h, (1 << KEY_BITS) - 1) >> (KEY_BITS - FIRST_BITS), []).append((min(h, (1 << KEY_BITS) - 1), min(i, (1 << KEY_BITS) - 1)))
    rows, base = [], 0
    for p in range(1 << FIRST_BITS):
        own = sorted(cuts.get(p, []))
        rows.append((p, base, own))
        base += len(own)
    return spark.createDataFrame(rows, "_p long, _base int, _cuts array<struct<h:long,i:long>>")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard_by_bytes(read(spark, sf_dir, "documents"), 16)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return d.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))
