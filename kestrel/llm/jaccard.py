"""Operator 6, exact n-gram Jaccard join by set-relation skipping.

A document's set is its distinct word shingles (64-bit hashes).  Equal sets are
collapsed to one class first.  The rest goes in three steps.

1. Index.  Elements are put into one global order: first those that occur once in
   the corpus, then the others, each by hash.  Two sets that link share one of
   their first n - ceil(n * percent / 100) + 1 elements (n: own size), and an element
   that occurs once is shared by nobody, so a set files only the others among them:
   block-skipping, most sets file nothing.  Which elements occur again is counted in
   buckets of 32-bit remainders and kept as a bitmap (its size follows the text, up to
   MAX_BITS); a wrong mark only moves an element behind the unmarked ones, for all sets
   alike, so the order stays one order.  Lists are split by size class; classes overlap,
   so that two sets whose sizes allow a link meet in one.  Sets that share a list,
   directly or through others, form a cluster: no link leaves it.
2. Answers from a similar set.  The smallest set of a cluster is its pivot p, so no
   difference has more than twice its member's elements; every member x is compared
   with p once, on whole sets, and kept as its difference d(x) = x ^ p.  From then on whole sets are not needed:
   |x ^ y| = |d(x) ^ d(y)|, so x and y link when |d(x)| + |d(y)| - 2 |d(x) & d(y)|
   is at most H(x, y).  All members within H of the pivot are one component.
3. Skipping.  A linked pair in different components shares elements of its
   differences (if d(x) and d(y) were disjoint, one of them would be p itself).  Each difference files only its H + 1 rarest elements (rarest in
   the cluster first); elements that only one member has are skipped, and so are
   positions from which the rest of either difference cannot give enough overlap.  What meets there is verified on
   the differences.  Pairs inside one component are never made.  A pivot unlike its members stays in all
   their differences; while that gives many pairs, members that share an element so form smaller
   clusters with new pivots, for which all of this holds again, and then meet a few hubs of each list.

In a large group of near copies the shared text cancels out of the differences,
so the group is handled by its edits alone.

Defined cases: empty or null texts have no shingles and are linked with nothing
(component is the row's own id); texts of fewer words than a shingle are one
shingle of all their words; repeated rows are one class; null ids take part,
the smallest non-null id names the component; an empty table gives no rows;
other columns, whatever their names, are untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import bitmap, in_bitmap, materialize, private, read
from .graph import components

SHINGLE = 3
PERCENT = 90        # link when 100 * intersection >= PERCENT * union
MIN_BITS, MAX_BITS = 1 << 22, 1 << 30  # of the bitmap of elements that occur again
BUCKET_BYTES = 6 << 20  # text whose elements one bucket counts
FLUSH = 1 << 19         # elements that a task deals out together
PAIRS = 8               # ordered pairs for each shown element that are made without more ado
HUBS = 2                # members of a list that all others meet before pairs are made


def size_classes(percent: int, most: int) -> list[int]:
    """Lower bounds of size classes: sets that may link are in one or neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out + [max(out[-1] + 1, -(-out[-1] * 100 // percent)), ]


def max_difference(total: int, percent: int) -> int:
    """Largest |x ^ y| of a linked pair with |x| + |y| = total."""
    return total * (100 - percent) // (100 + percent)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    if len(h) < n:
        return T.mix(T.gram_hashes(h, len(h)) ^ np.uint64(len(h)))
    return np.unique(T.gram_hashes(h, n))


def _sets(texts: pa.Array, n: int):
    """Shingle sets of a batch's texts, A-Z lower-cased, in order."""
    buf, off = T.flat(texts)
    for lo, hi in T.chunks(off, 1 << 19):
        part, o = T.lower_ascii(buf[off[lo]:off[hi]]), off[lo:hi + 1] - off[lo]
        s, e, first = T.words(part, o)
        h = T.word_hashes(part, s, e)
        for k in range(hi - lo):
            yield shingle_set(h[first[k]:first[k + 1]], n)


def set_key(g: np.ndarray) -> bytes:
    """128-bit hash of a set."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(T.mix(g), dtype=np.uint64)
        b = np.add.reduce(T.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(g))], np.uint64).tobytes()


def prefix_length(n: int, percent: int) -> int:
    """Elements that a set of n shows: linked sets share one of them."""
    return n + (-percent * n) // 100 + 1


def _rows(df: DataFrame, text_col: str, id_col: str, shingle: int) -> DataFrame:
    """One row per input row: id, th (hash of the text), n, key; materialised."""
    text = F.col(f"`{text_col}`").cast("string")
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def run(batches):
        for b in batches:
            sets = [(len(g), set_key(g)) for g in _sets(b.column(2), shingle)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in sets], pa.int64()),
                                              pa.array([k for _, k in sets], pa.binary())], names=["id", "th", "n", "key"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = src.mapInArrow(run, f"id {kind}, th long, n long, key binary")
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "sets")


def _remainder(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, the next 32 bits) of element hashes; there are 2 ** bits buckets."""
    return (h >> np.uint64(64 - bits)).astype(np.int32), (h >> np.uint64(32 - bits)).astype(np.uint32)


def _mark(bucket, rest: np.ndarray) -> np.ndarray:
    return T.mix((np.asarray(bucket).astype(np.uint64) << np.uint64(32)) | rest.astype(np.uint64)).view(np.int64)


def _again(texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """Marks (m long) of the elements that occur in two rows or more (and of a
    few others that have the same remainder)."""
    def run(batches):
        held, size = [], 0
        for b in batches:
            for g in _sets(b.column(0), shingle):
                held.append(g)
                size += len(g)
                if size >= FLUSH:
                    yield dealt(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield dealt(np.concatenate(held))

    def dealt(h):
        h, n = np.unique(h, return_counts=True)
        h = np.sort(np.concatenate((h, h[n > 1])))  # twice is all that counts
        bucket, rest = _remainder(h, bits)
        used, first = np.unique(bucket, return_index=True)
        ends = pa.array(np.append(first, len(h)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(used), pa.ListArray.from_arrays(ends, pa.array(rest.view(np.int32)))], names=["bucket", "v"])

    def found(parts, bucket):
        v = np.sort(np.concatenate(parts)).view(np.uint32)
        v = np.unique(v[1:][v[1:] == v[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(_mark(np.full(len(v), bucket), v))], names=["m"])

    def count(batches):
        parts, bucket = [], None
        for b in batches:
            lists = b.column(1)
            for r, here in enumerate(b.column(0).to_pylist()):
                if bucket is not None and here != bucket:
                    yield found(parts, bucket)
                    parts = []
                bucket = here
                parts.append(lists[r].values.to_numpy())
        if parts:
            yield found(parts, bucket)

    packed = texts.mapInArrow(run, "bucket int, v array<int>")
    return packed.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "m long")


def _filed(df: DataFrame, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(key, sigs): the list keys under which each different set is filed; sets
    that file nothing are left out."""
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(-(-size // BUCKET_BYTES) - 1).bit_length())
    room = min(MAX_BITS, max(MIN_BITS, 1 << int(size // 8).bit_length()))
    mask = df.sparkSession.sparkContext.broadcast(bitmap(_again(texts, shingle, bits), "m", room))

    def run(batches):
        bounds = size_classes(percent, 1000)
        for b in batches:
            keys, lists, ends = [], [], [0]
            for g in _sets(b.column(0), shingle):
                n = len(g)
                if not n:
                    continue
                again = in_bitmap(mask.value, _mark(*_remainder(g, bits)))
                take = prefix_length(n, percent) - (n - int(again.sum()))
                if take <= 0:
                    continue
                if n >= bounds[-3]:
                    bounds = size_classes(percent, 2 * n)
                family = int(np.searchsorted(bounds, n, side="right")) - 1
                e = g[again][:take]
                lists += [T.mix(e ^ np.uint64((f + 1) << 40)) for f in (family - 1, family)]  # a class and its neighbour
                keys.append(set_key(g))
                ends.append(ends[-1] + 2 * len(e))
            flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                                             names=["key", "sigs"])

    # copies of one class: any row files the same lists
    return texts.mapInArrow(run, "key binary, sigs array<long>").groupBy("key").agg(F.first("sigs").alias("sigs"))


def _whole_sets(df: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(rid, n, g array<long>) of the classes in wanted (rid, key): a second
    reading of the texts; a fixed-size bitmap of the wanted keys keeps the others
    in the Python worker, the join decides exactly."""
    mask = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("key").alias("m")), "m"))

    bits = 8 * len(mask.value)

    def out(keys, sets):
        ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["key", "g"])

    def run(batches):
        for b in batches:
            keys, sets, size = [], [], 0
            for g in _sets(b.column(0), shingle):
                key = set_key(g)
                # Spark's xxhash64 of a binary is XXH64 with seed 42; bits divides 2 ** 64
                at = xxhash.xxh64_intdigest(key, 42) % bits
                if not mask.value[at >> 3] >> (at & 7) & 1:
                    continue
                keys.append(key)
                sets.append(g)
                size += len(g)
                if size >= FLUSH // 4:
                    yield out(keys, sets)
                    keys, sets, size = [], [], 0
            yield out(keys, sets)

    found = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "key binary, g array<long>")
    # copies of one class: any row has the same set
    found = found.groupBy("key").agg(F.first("g").alias("g"))
    return materialize(wanted.join(found, "key").select("rid", F.size("g").cast("long").alias("n"), "g"), "whole-sets")


def _allowed(n1, n2, percent):
    """Largest symmetric difference of two linked sets of these sizes (long columns)."""
    return F.floor((n1 + n2) * (100 - percent) / F.lit(100 + percent))


def jaccard_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, th, n, component (smallest id), keeper (true for
    one row (id, th) of each component)."""
    rows = _rows(df, text_col, id_col, shingle)
    classes = rows.where("n > 0").groupBy("key").agg(
        F.min("rid").alias("rid"), F.min(F.struct("id", "th")).alias("low"), F.min("id").alias("min_id"))
    classes = materialize(classes, "classes")
    entries = _filed(df, text_col, shingle, percent).join(classes.select("key", "rid"), "key").select(F.explode("sigs").alias("sig"), "rid")
    # a list's smallest member stands for it
    lists = entries.withColumn("lo", F.min("rid").over(Window.partitionBy("sig")))
    shared = materialize(lists.where("rid != lo").select("rid", "lo").distinct(), "shared")
    comp = _resolve(df, classes, shared, text_col, shingle, percent)
    named = classes.join(comp, "rid", "left").withColumn("c", F.coalesce("c", "rid"))
    best = named.groupBy("c").agg(F.min("low").alias("first_row"), F.min("min_id").alias("component"))
    named = named.select("key", "c").join(best, "c").select("key", "component", "first_row")
    out = rows.select("id", "th", "n", "key").join(named, "key", "left")
    mine = F.struct("id", "th").eqNullSafe(F.col("first_row"))
    return out.select("id", "th", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"),
                      F.when(F.col("n") > 0, mine).otherwise(True).alias("keeper"))


def _resolve(df, classes, shared, text_col, shingle, percent) -> DataFrame:
    """(rid, c): the component of every class that shares a list (c: its smallest
    rid among those linked)."""
    clusters = materialize(components(shared.select(F.col("rid").alias("a"), F.col("lo").alias("b"))).select(
        F.col("node").alias("rid"), F.col("component").alias("p")), "clusters")
    sets = _whole_sets(df, clusters.join(classes.select("rid", "key"), "rid"), text_col, shingle)
    pivots = clusters.join(sets.select("rid", "n"), "rid").groupBy("p").agg(F.min(F.struct("n", "rid")).alias("low"))
    clusters = clusters.join(pivots, "p").select("rid", F.col("low.rid").alias("p"))
    members = _differences(clusters, sets)
    # allowed: for any partner, which has n * 100 / percent elements at most
    members = materialize(members.withColumn("allowed", _allowed(F.col("n"), F.floor(F.col("n") * 100 / percent), percent))
                          .withColumn("k", F.size("d")).withColumn("c", F.when(F.col("k") <= _allowed(F.col("n"), F.col("np"), percent), F.col("p"))
                                                                    .otherwise(F.col("rid"))), "differences")
    return _united(members, percent)


def _united(members: DataFrame, percent: int) -> DataFrame:
    """(rid, c): the components (c) of members (p, rid, n, k, d, allowed, c) after all links
    between members of a cluster.

    Where a pivot is unlike its members, their differences share its elements and all of
    them meet.  So while many pairs would be made, members that share a list form smaller
    clusters with pivots of their own.  What is left then meets a few hubs, and what no hub
    has joined is paired in full."""
    name, before, most = members.select("rid", "c"), None, None
    while True:
        el = materialize(_shown(members), "shown")
        most = PAIRS * el.count() if most is None else most
        shown, kinds, left = _unsettled(el, name)
        if left <= most or before is not None and 2 * left > before:
            break
        members = _new_pivots(members, shown, percent)
        near = members.where(F.col("k") <= _allowed(F.col("n"), F.col("np"), percent))
        name, before = _joined(name, near.select(F.col("rid").alias("x"), F.col("p").alias("y"))), left
    if left > most:
        name = _joined(name, _links(members, _met_hubs(shown, percent), percent))
        shown, kinds, left = _unsettled(el, name)
    return _joined(name, _links(members, _met(shown, kinds, percent), percent)) if left else name


def _unsettled(el: DataFrame, name: DataFrame):
    """(shown, kinds, left): the entries of lists that hold several components; these lists with
    their largest component; the number of their ordered pairs between components."""
    shown = el.join(name, "rid")
    kinds = shown.groupBy("p", "e", "c").agg(F.count("*").alias("m")).groupBy("p", "e").agg(
        F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"), F.max(F.struct("m", "c"))["c"].alias("main"))
    kinds = materialize(kinds.where(F.col("all") * F.col("all") > F.col("own")), "kinds")
    left = kinds.agg(F.sum(F.col("all") * F.col("all") - F.col("own"))).first()[0] or 0
    return shown.join(kinds.select("p", "e"), ["p", "e"]), kinds, left


def _shown(members: DataFrame) -> DataFrame:
    """(rid, p, e, pos, n, k): the rarest allowed + 1 elements of each difference, without
    those of one member only."""
    el = members.select("p", "rid", "allowed", F.explode("d").alias("e"))
    freq = el.groupBy("p", "e").agg(F.count("*").alias("m"))
    el = el.join(freq, ["p", "e"]).withColumn("pos", F.row_number().over(Window.partitionBy("rid").orderBy("m", "e")))
    el = el.where((F.col("pos") <= F.col("allowed") + 1) & (F.col("m") >= 2)).select("p", "rid", "e", "pos")
    return el.join(members.select("rid", "n", "k"), "rid")


def _new_pivots(members: DataFrame, shown: DataFrame, percent: int) -> DataFrame:
    """The members of the lists in smaller clusters: sets of sizes that may link which share
    a list, directly or through others.  A cluster's pivot is one of its commonest sizes."""
    # sets that may link are in one class or in neighbours (the thousandth is for rounding)
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.001)) if percent < 100 else F.col("n")
    lists = shown.select("p", "e", "rid", F.explode(F.array(size - 1, size)).alias("f"))
    low = lists.groupBy("p", "e", "f").agg(F.min("rid").alias("lo"))
    edges = lists.join(low, ["p", "e", "f"]).select(F.col("rid").alias("a"), F.col("lo").alias("b"))
    own = components(edges).select(F.col("node").alias("rid"), F.col("component").alias("cluster"))
    held = members.select("rid", "n", "k", "d", "allowed").join(own, "rid")
    pivots = held.groupBy("cluster", "n", "k").agg(F.count("*").alias("m"), F.min("rid").alias("p")).groupBy("cluster").agg(
        F.max(F.struct("m", "p"))["p"].alias("p"))
    p = members.select(F.col("rid").alias("p"), F.col("n").alias("np"), F.col("d").alias("dp"))
    met = held.join(pivots, "cluster").join(p, "p")
    d = F.concat(F.array_except("dp", "d"), F.array_except("d", "dp"))
    return materialize(met.select("rid", "p", "n", "np", "allowed", d.alias("d")).withColumn("k", F.size("d")), "differences")


def _side(shown: DataFrame, v: str) -> DataFrame:
    return shown.select("p", "e", F.col("rid").alias(v), *[F.col(c).alias(f"{c}{v}") for c in ("c", "n", "k", "pos")])


def _may_link(percent: int):
    """Whether x and y, which share an element at their positions, may link."""
    allowed = _allowed(F.col("nx"), F.col("ny"), percent)
    # skipping by position: if e is the first element that both share, the rest of either bounds the overlap
    most = 1 + F.least(F.col("kx") - F.col("posx"), F.col("ky") - F.col("posy"))
    enough = 2 * most >= F.col("kx") + F.col("ky") - allowed
    return (F.col("cx") != F.col("cy")) & enough & (F.abs(F.col("kx") - F.col("ky")) <= allowed)  # |x ^ y| is no less


def _met_hubs(shown: DataFrame, percent: int) -> DataFrame:
    """(x, y): members with HUBS members of each of their lists, drawn by hash.  One link
    between two components settles all pairs of their members."""
    sides = _side(shown, "y")
    drawn = [F.min(F.struct(F.xxhash64("y", F.lit(i)), *sides.columns[2:])).alias(f"h{i}") for i in range(HUBS)]
    hubs = sides.groupBy("p", "e").agg(*drawn).select("p", "e", F.array(*[f"h{i}" for i in range(HUBS)]).alias("h"))
    met = _side(shown, "x").join(hubs, ["p", "e"]).select("*", F.explode("h").alias("one"))
    met = met.select("*", *[F.col(f"one.{c}") for c in sides.columns[2:]]).where(_may_link(percent))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _met(shown: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of a list between two components that may link.  Members outside the
    list's largest component meet the whole list."""
    once = (F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))
    other = _side(shown, "x").join(kinds.select("p", "e", "main"), ["p", "e"]).where("cx != main")
    met = other.join(_side(shown, "y"), ["p", "e"]).where(once & _may_link(percent))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _links(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(x, y): the pairs that link, verified on the differences."""
    pairs = materialize(pairs.distinct(), "pairs")
    side = lambda v: members.select(F.col("rid").alias(v), F.col("n").alias(f"n{v}"), F.col("d").alias(f"d{v}"))
    met = pairs.join(side("x"), "x").join(side("y"), "y")
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    return met.where(apart <= _allowed(F.col("nx"), F.col("ny"), percent)).select("x", "y")


def _joined(name: DataFrame, links: DataFrame) -> DataFrame:
    """name (rid, c) with the components that links connect made one."""
    edges = links.join(name.select(F.col("rid").alias("x"), F.col("c").alias("a")), "x").join(
        name.select(F.col("rid").alias("y"), F.col("c").alias("b")), "y").select("a", "b")
    merged = components(edges)
    return materialize(name.join(merged, name.c == merged.node, "left").select("rid", F.coalesce("component", "c").alias("c")), "named")


def _differences(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(rid, p, n, np, d): sizes of member and pivot, and their symmetric difference."""
    p = sets.select(F.col("rid").alias("p"), F.col("n").alias("np"), F.col("g").alias("gp"))
    met = clusters.join(sets, "rid").join(p, "p")
    d = F.concat(F.array_except("gp", "g"), F.array_except("g", "gp"))
    return met.select("rid", "p", "n", "np", d.alias("d"))


def drop_near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """df with one row of each component (empty texts all stay)."""
    i, t, keep = private(df, "keep_id", "keep_th", "keep")
    c = jaccard_components(df, text_col, id_col, **kw).where("keeper")
    # several input rows may be the same (id, text): one stays, unless the text has no words
    # 0: the only row; 1: all rows of this (id, text) stay; 2: one of several rows
    kind = F.when(F.max("n") == 0, 1).when(F.count("*") > 1, 2).otherwise(0)
    c = c.groupBy(F.col("id").alias(i), F.col("th").alias(t)).agg(kind.alias(keep))
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(t))
    met = df.join(c, on)
    # only rows repeated with their id are brought together once more
    many = met.where(F.col(keep) < 2).drop(i, t, keep)
    one = met.where(F.col(keep) == 2).dropDuplicates([i, t]).drop(i, t, keep)
    return one.unionByName(many)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = jaccard_components(read(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SQL_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
cls AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT rep, n, unnest(s) AS g FROM cls),
f AS (SELECT g, count(*) AS c FROM e GROUP BY g),
pre AS (SELECT rep, n, e.g, row_number() OVER (PARTITION BY rep ORDER BY c, e.g) AS pos FROM e JOIN f ON e.g = f.g),
cand AS (
  SELECT DISTINCT a.rep AS x, b.rep AS y FROM pre a JOIN pre b ON a.g = b.g AND a.rep < b.rep
  WHERE a.pos <= a.n - CAST(ceil(a.n * 90 / 100.0) AS BIGINT) + 1 AND b.pos <= b.n - CAST(ceil(b.n * 90 / 100.0) AS BIGINT) + 1),
link AS (
  SELECT x, y FROM cand JOIN cls a ON a.rep = x JOIN cls b ON b.rep = y, LATERAL (SELECT len(list_intersect(a.s, b.s)) AS i)
  WHERE 100 * i >= 90 * (a.n + b.n - i)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT rep AS x, rep AS y FROM cls UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN cls ON list_sort(s.s) = cls.s LEFT JOIN comp ON comp.x = cls.rep
"""
