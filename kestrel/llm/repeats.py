"""Shared steps of the two repeat removers (operators 7 and 9).

Both ask of every fixed-length window of a text (bytes or words) whether its
content starts elsewhere.  A window's anchor is the smallest hash among its
k-grams (leftmost on ties), so equal windows have equal anchors, and every window has one.
A phrase is a run of windows with one anchor position; its text is the union of
its windows.  Then, as Spark jobs over the whole corpus:

1. equal texts are collapsed to one class;
2. anchors that occur once are dropped (a window there is unique);
3. phrases of the remaining anchors are counted: equal phrases settle all their
   windows at once (the dictionary of phrases);
4. only where an anchor has several different phrases, windows are compared one
   by one: the phrases of one anchor meet in one task, a bounded batch at a time
   (the operator's own resolver); the phrases of an anchor with more than `cap` of
   them are lined up by it and compared block by block, so that no group is gathered;
5. the found windows are gathered per text and cut out.

Texts are read again for steps 4 and 5; a bitmap of fixed size keeps the texts
that are not needed out of the shuffle, the join decides exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import bitmap, in_bitmap, materialize

CHUNK = 1 << 18          # bytes of text looked at together
CAP = 2000               # different phrases of one anchor that may meet in a task
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Unit:
    """What a window is made of."""

    window: int
    gram: int
    symbols: Callable   # (buf, off) -> (uint64 per symbol, first symbol of each document, context)
    kept: Callable      # (buf, off, context, keep flag per symbol) -> list of kept bytes per document
    ordered: bool       # True: only texts with a smaller id count as elsewhere
    batch: int          # symbols that the resolver gets at a time (one anchor's phrases stay together)
    ship: Callable      # (buf, symbols) -> array with one entry per symbol, as it is shuffled
    load: Callable      # its bytes -> symbols


def byte_symbols(buf, off):
    return T._CODES[buf], off, None


def byte_ship(buf, sym):
    return buf


def byte_load(raw):
    return T._CODES[np.frombuffer(raw, np.uint8)]


def byte_kept(buf, off, _, keep):
    return [buf[a:b][keep[a:b]].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]


def word_symbols(buf, off):
    s, e, first = T.words(buf, off)
    return T.word_hashes(buf, s, e), first, (s, e, first)


def word_ship(buf, sym):
    return sym


def word_load(raw):
    return np.frombuffer(raw, np.uint64)


def word_kept(buf, off, context, keep):
    """Kept words joined by one space, per document."""
    s, e, first = context
    live = np.flatnonzero(keep)
    doc = np.searchsorted(first, live, side="right") - 1
    more = np.zeros(len(live), bool)
    more[:-1] = doc[1:] == doc[:-1]  # another kept word follows in the document
    mark = np.zeros(len(buf) + 1, np.int32)
    np.add.at(mark, s[live], 1)
    np.add.at(mark, e[live], -1)
    on = np.cumsum(mark[:-1]) > 0
    text = buf.copy()
    gap = e[live[more]]
    on[gap], text[gap] = True, 32
    return [text[a:b][on[a:b]].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k neighbours (van Herk: three passes, whatever k)."""
    n = len(x) - k + 1
    pad = -len(x) % k
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, k)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[k - 1:k - 1 + n])


def phrases(sym: np.ndarray, first: np.ndarray, unit: Unit):
    """(anchor, phrase hash, lo, hi): windows [lo, hi) of one anchor position."""
    W, k = unit.window, unit.gram
    none = np.zeros(0, np.uint64)
    if len(sym) < W:
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = T.window_hashes(sym, k)
    packed = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    at = sliding_min(packed, W - k + 1) & _LOW
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    ok = doc[:len(at)] == doc[W - 1:]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    lo = np.flatnonzero(new)
    if not len(lo):
        return none, none, lo, lo
    ends = np.flatnonzero(ok & np.concatenate((~ok[1:] | new[1:], [True])))
    hi = ends + 1
    wh = T.window_hashes(sym, W)
    with np.errstate(over="ignore"):  # first and last window cover the whole phrase
        b = T.mix(wh[lo] * np.uint64(3) + T.mix(wh[hi - 1]) + (hi - lo).astype(np.uint64))
    return T.mix(g[at[lo].astype(np.int64)]), b, lo, hi


def _lists(values, ends, kind):
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_rows(df: DataFrame, text_col: str, id_col: str, unit: Unit) -> DataFrame:
    """One row per input row: id, key, n (symbols), kept_sha256 of the untouched
    text, and its phrases (a, b, lo, hi); materialised."""
    text = F.col(f"`{text_col}`").cast("string")
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), _key(text).alias("key"), text.alias("text"))

    def run(batches):
        for batch in batches:
            buf, off = T.flat(batch.column(2))
            for i, j in T.chunks(off, CHUNK):
                part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                sym, first, context = unit.symbols(part, o)
                a, b, lo, hi = phrases(sym, first, unit)
                ends = np.searchsorted(lo, first)
                base = np.repeat(first[:-1], np.diff(ends))
                kept = unit.kept(part, o, context, np.ones(len(sym), bool))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                    _lists(a.view(np.int64), ends, pa.int64()), _lists(b.view(np.int64), ends, pa.int64()),
                    _lists(lo - base, ends, pa.int32()), _lists(hi - base, ends, pa.int32())],
                    names=["id", "key", "n", "sha", "a", "b", "lo", "hi"])

    rows = src.mapInArrow(run, "id long, key binary, n long, sha string, a array<long>, b array<long>, lo array<int>, hi array<int>")
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")


def _texts(df: DataFrame, text_col: str, id_col: str, wanted: DataFrame) -> DataFrame:
    """wanted (key, first_id, ...) with the text of each, by a second reading."""
    text = F.col(f"`{text_col}`").cast("string")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    mask = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("key", "first_id").alias("m")), "m"))
    src = df.select(_key(text).alias("key"), ident.alias("first_id"), text.alias("text"))
    src = src.withColumn("m", F.xxhash64("key", "first_id"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(mask.value, batch.column(3).to_numpy(zero_copy_only=False)))).select(["key", "first_id", "text"])

    some = src.mapInArrow(run, "key binary, first_id long, text string")
    met = some.join(wanted, ["key", "first_id"])
    return met.dropDuplicates(["key", "first_id"])  # rows repeated with their id


def find_repeats(df: DataFrame, text_col: str, id_col: str, unit: Unit, resolve: Callable, cap: int = CAP):
    """(rows, classes, spans): spans(rid, spans array<struct<lo, hi>>) are the
    window starts found elsewhere, for the first text of each class."""
    rows = text_rows(df, text_col, id_col, unit)
    ident = F.coalesce("id", F.lit(-(1 << 63)))
    classes = rows.groupBy("key").agg(F.min("rid").alias("rid"), F.min(ident).alias("first_id"), F.count("*").alias("copies"),
                                      *[F.first(c).alias(c) for c in ("a", "b", "lo", "hi")])
    # ord is the id where it decides, and otherwise a column of equal values
    ord_ = F.col("first_id") if unit.ordered else F.lit(0).cast("long")
    entries = classes.select("rid", ord_.alias("ord"), F.explode(F.arrays_zip("a", "b", "lo", "hi")).alias("p"))
    entries = entries.select("p.a", "p.b", "rid", "ord", "p.lo", "p.hi")
    if unit.ordered:
        again = entries.groupBy("a").agg(F.min("ord").alias("lowest"), F.max("ord").alias("highest")).where("lowest != highest")
    else:
        again = entries.groupBy("a").agg(F.count("*").alias("n")).where("n >= 2")
    again = again.select("a")
    classes = materialize(classes.select("key", "rid", "first_id", "copies"), "classes")
    hits = materialize(entries.join(again, "a"), "hits")

    found = hits.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("ord", "rid", "lo", "hi")).alias("who"))
    found = materialize(found, "dictionary")
    if unit.ordered:
        settled = hits.join(found.where("n >= 2"), ["a", "b"]).where(F.col("ord") > F.col("who.ord"))
        needs = F.lit(True)  # the first holder of a phrase may still repeat windows of other phrases
    else:
        settled = hits.join(found.where("n >= 2").select("a", "b"), ["a", "b"])
        needs = F.col("n") == 1
    settled = settled.select(hits.rid, hits.lo, hits.hi)
    several = found.groupBy("a").agg(F.count("*").alias("kinds"), F.max(needs.cast("int")).alias("open"), F.min("who.ord").alias("lowest"))
    mixed = found.join(several.where("kinds >= 2 and open = 1").select("a", "kinds", "lowest"), "a").select(
        "a", "b", "n", "kinds", "lowest", "who.rid", "who.ord", "who.lo", "who.hi", needs.alias("needs"))
    mixed = materialize(mixed, "mixed")

    def segments(part: DataFrame) -> DataFrame:
        per = part.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "a", "needs"))).alias("parts"))
        per = per.join(classes.select("rid", "key", "first_id"), "rid")
        return _cut(_texts(df, text_col, id_col, per), unit)

    parts = [settled]
    if not mixed.isEmpty():
        cold = segments(mixed.where(F.col("kinds") <= cap)).repartition("a").sortWithinPartitions("a", "ord")
        alone = cold.mapInArrow(_batched(resolve, unit), "rid long, start int, lo int, hi int")
        hot = mixed.where(F.col("kinds") > cap)
        if not hot.isEmpty():
            alone = alone.union(settle_blocks(segments(hot), unit))
        if unit.ordered:
            alone = materialize(alone, "resolved")
            parts.append(_twins(hits, mixed, alone))
        parts.append(alone.select("rid", "lo", "hi"))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.union(p)
    spans = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    return rows, classes, materialize(spans, "spans")


def _twins(hits: DataFrame, mixed: DataFrame, alone: DataFrame) -> DataFrame:
    """(rid, lo, hi): windows found for the first holder of a phrase, in its other
    holders of the same ord.  Holders of the anchor's lowest ord have none."""
    who = mixed.where((F.col("n") >= 2) & (F.col("ord") > F.col("lowest"))).select(
        "a", "b", "ord", F.col("rid").alias("who"), F.col("lo").alias("start"))
    same = hits.join(who, ["a", "b", "ord"]).where((F.col("rid") != F.col("who")) | (F.col("lo") != F.col("start")))
    same = same.select("who", "start", "rid", (F.col("lo") - F.col("start")).alias("shift"))
    met = alone.withColumnRenamed("rid", "who").join(same, ["who", "start"])
    return met.select("rid", (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))


def _cut(texts: DataFrame, unit: Unit) -> DataFrame:
    """(a, rid, ord, lo, n windows, needs, sym): the symbols of each wanted phrase."""
    def run(batches):
        for batch in batches:
            buf, off = T.flat(batch.column(2))
            for i, j in T.chunks(off, CHUNK):
                part = buf[off[i]:off[j]]
                rid, ord_, wanted = (batch.column(c).slice(i, j - i).to_pylist() for c in (0, 1, 3))
                sym, first, _ = unit.symbols(part, off[i:j + 1] - off[i])
                sent = unit.ship(part, sym)
                out = [[], [], [], [], [], [], []]
                for r in range(j - i):
                    for p in wanted[r]:
                        at = int(first[r]) + p["lo"]
                        for col, v in zip(out, (p["a"], rid[r], ord_[r], p["lo"], p["hi"] - p["lo"], p["needs"],
                                                sent[at:at + p["hi"] - p["lo"] + unit.window - 1].tobytes()), strict=True):
                            col.append(v)
                        if len(out[0]) >= 512:
                            yield _segment_batch(out)
                            out = [[], [], [], [], [], [], []]
                yield _segment_batch(out)

    return texts.select("rid", F.col("first_id").alias("ord"), "text", "parts").mapInArrow(
        run, "a long, rid long, ord long, lo int, n int, needs boolean, sym binary")


def _segment_batch(out):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                                      names=["a", "rid", "ord", "lo", "n", "needs", "sym"])


def segment_windows(segments, unit: Unit):
    """(hash, segment number, window number) of all windows of a list of symbol arrays."""
    flat = np.concatenate(segments)
    size = np.array([len(s) for s in segments])
    first = np.concatenate(([0], np.cumsum(size)))
    wh = T.window_hashes(flat, unit.window)
    seg = np.repeat(np.arange(len(segments)), size)[:len(wh)]
    own = np.arange(len(wh)) + unit.window <= first[seg + 1]
    at = np.flatnonzero(own)
    return wh[at], seg[at], at - first[seg[at]]


_ROW = "a long, rid long, ord long, start int, lo int, o int, m int, needs boolean, sym binary"
_BLOCK = _ROW + ", j int, c long, u long"


def block_sizes(window: int) -> list[int]:
    """Windows a block: 64, 8, 1, but never a third of the window or more."""
    return [s for s in (64, 8) if 3 * s < window] + [1]


def settle_blocks(segments: DataFrame, unit: Unit) -> DataFrame:
    """(rid, start, lo, hi): runs of windows found elsewhere, for anchors of any
    number of different phrases.

    Equal windows have their anchor at the same place, so the windows of an anchor
    are lined up by it and cut into the same blocks in every phrase.  A block whose
    symbols (all of its windows') occur again is found at once, and only one holder
    of it goes on, for others to meet; a block whose core (the symbols that all of
    its windows share) occurs once has no window that is found.  Only what is left
    between the two is cut into smaller blocks, down to one window.  Groups are
    counted by partial aggregates and never gathered."""
    rows, found = segments.mapInArrow(_anchored(unit), _ROW), None
    key = ["a", "j", "c", "o", "m", "u"]
    for size in block_sizes(unit.window):
        blocks = materialize(rows.mapInArrow(_blocks(unit, size), _BLOCK), "blocks")
        kinds = blocks.groupBy(*key).agg(F.count("*").alias("same"), F.min("ord").alias("lowest"), F.max("ord").alias("highest"),
                                         F.max("needs").alias("open"), F.min(F.struct("rid", "lo")).alias("who"))
        cores = kinds.groupBy("a", "j", "c").agg(F.sum("same").alias("n"), F.min("lowest").alias("first"), F.max("highest").alias("last"),
                                                 F.max("open").alias("wanted"))
        cores = cores.where("first < last") if unit.ordered else cores.where("n >= 2 and wanted")
        kinds = kinds.join(cores.select("a", "j", "c"), ["a", "j", "c"]).select(*key, "same", "lowest", "who")
        met = blocks.join(kinds, key)
        hit = F.col("ord") > F.col("lowest") if unit.ordered else F.col("needs") & (F.col("same") >= 2)
        runs = met.where(hit).select("rid", "start", "lo", (F.col("lo") + F.col("m")).alias("hi"))
        found = runs if found is None else found.union(runs)
        on = F.col("ord") == F.col("lowest") if unit.ordered else F.struct("rid", "lo") == F.col("who")
        rows = met.where(on).withColumn("needs", F.col("needs") & (F.lit(unit.ordered) | (F.col("same") == 1))).select(
            "a", "rid", "ord", "start", "lo", "o", "m", "needs", "sym")
    return found


def _slices(batches, rows: int = 1024):
    """The batches in pieces, so that what a task holds beside them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _anchored(unit: Unit):
    """Phrases with the place `o` of their first window in the line-up: window - gram
    for a window that starts at the anchor, 0 for one that ends with it."""
    W, k = unit.window, unit.gram

    def run(batches):
        for b in _slices(batches):
            segs = [unit.load(x) for x in b.column(6).to_pylist()]
            o = [W - k - int(np.argmin(T.window_hashes(s, k) & ~_LOW)) for s in segs]  # the leftmost smallest
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(3), pa.array(o, pa.int32()),
                                              b.column(4), b.column(5), b.column(6)],
                                             names=["a", "rid", "ord", "start", "lo", "o", "m", "needs", "sym"])
    return run


def _blocks(unit: Unit, size: int):
    """Rows cut where `o` reaches a multiple of size: j (number of the block), c (hash of
    the core, at the same place in every phrase), u (hash of all symbols)."""
    W = unit.window

    def run(batches):
        for b in _slices(batches):
            raw = b.column(8).to_pylist()
            segs = [unit.load(x) for x in raw]
            n = np.array([len(s) for s in segs])
            flat, first = np.concatenate(segs), np.cumsum(n) - n
            whole, core = T.window_hashes(flat, W), T.window_hashes(flat, W - size + 1)
            o, m = (b.column(i).to_numpy().astype(np.int64) for i in (5, 6))
            row = np.repeat(np.arange(len(m)), m)
            w = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            j = (o[row] + w) // size
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (j[1:] != j[:-1])
            lo = np.flatnonzero(new)
            m = np.diff(np.append(lo, len(row)))
            row, w, j = row[lo], w[lo], j[lo]
            o, x = o[row] + w, first[row] + w
            with np.errstate(over="ignore"):  # first and last window cover the whole block
                u = T.mix(whole[x] * np.uint64(3) + T.mix(whole[x + m - 1]) + m.astype(np.uint64))
            c = core[x + (j + 1) * size - 1 - o]
            width = [len(r) // len(s) for r, s in zip(raw, segs, strict=True)]
            sym = [raw[r][i * width[r]:(i + k + W - 1) * width[r]] for r, i, k in zip(row, w, m, strict=True)]
            old = [b.column(i).take(pa.array(row)) for i in (0, 1, 2, 3, 7)]
            yield pa.RecordBatch.from_arrays(
                [*old[:4], pa.array(b.column(4).to_numpy()[row] + w, pa.int32()), pa.array(o, pa.int32()), pa.array(m, pa.int32()), old[4],
                 pa.array(sym, pa.binary()), pa.array(j, pa.int32()), pa.array(c.view(np.int64)), pa.array(u.view(np.int64))],
                names=["a", "rid", "ord", "start", "lo", "o", "m", "needs", "sym", "j", "c", "u"])
    return run


def _batched(resolve: Callable, unit: Unit):
    """Feed whole anchors to resolve(segments, anchors, ords, needs, unit), which
    returns (segment number, window number) of windows found elsewhere."""
    def settle(group):
        a, rid, ord_, lo, needs, segs = (list(c) for c in zip(*group, strict=True))
        s, w = resolve(segs, a, np.array(ord_, np.int64), np.array(needs, bool), unit)
        start = np.array(lo, np.int64)[s]
        return pa.RecordBatch.from_arrays([pa.array(np.array(rid, np.int64)[s]), pa.array(start, pa.int32()), pa.array(start + w, pa.int32()),
                                           pa.array(start + w + 1, pa.int32())], names=["rid", "start", "lo", "hi"])

    def run(batches):
        group, size = [], 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
            for a, rid, ord_, lo, needs, raw in zip(*cols, strict=True):
                if size >= unit.batch and group[-1][0] != a:
                    yield settle(group)
                    group, size = [], 0
                seg = unit.load(raw)
                group.append((a, rid, ord_, lo, needs, seg))
                size += len(seg)
        if group:
            yield settle(group)
    return run


def remove_repeats(df: DataFrame, text_col: str, id_col: str, unit: Unit, resolve: Callable, cap: int = CAP,
                   with_text: bool = False) -> DataFrame:
    """One row per input row: id, key, n, n_removed, n_spans, kept_sha256 (and
    kept text with with_text)."""
    rows, classes, spans = find_repeats(df, text_col, id_col, unit, resolve, cap)
    cut = spans.join(classes.select("rid", "key", "first_id"), "rid")

    def run(batches):
        for batch in batches:
            buf, off = T.flat(batch.column(1))
            found = batch.column(2)
            for i, j in T.chunks(off, CHUNK):
                part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                sym, first, context = unit.symbols(part, o)
                delta = np.zeros(len(sym) + 1, np.int32)
                for r in range(i, j):
                    lohi = found[r].values
                    lo = first[r - i] + lohi.field("lo").to_numpy().astype(np.int64)
                    hi = first[r - i] + lohi.field("hi").to_numpy().astype(np.int64) - 1 + unit.window
                    np.add.at(delta, lo, 1)
                    np.add.at(delta, hi, -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = unit.kept(part, o, context, ~gone)
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = first[(first < len(sym))]
                edge[inner] = gone[inner]
                total, runs = np.cumsum(np.r_[0, gone]), np.cumsum(np.r_[0, edge])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(total[first]), pa.int64()), pa.array(np.diff(runs[first]), pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                     pa.array([x.decode("utf-8", "replace") if with_text else None for x in kept], pa.string())],
                    names=["rid", "n_removed", "n_spans", "cut_sha", "kept"])

    texts = _texts(df, text_col, id_col, cut).select("rid", "text", "spans")
    done = texts.mapInArrow(run, "rid long, n_removed long, n_spans long, cut_sha string, kept string")
    per = classes.select("key", "rid", "first_id", "copies").join(done, "rid", "left").drop("rid")
    out = rows.select("id", "key", "n", "sha").join(per, "key")
    if unit.ordered:
        copy = F.coalesce("id", F.lit(-(1 << 63))) > F.col("first_id")
    else:
        copy = F.col("copies") > 1
    whole = copy & (F.col("n") >= unit.window)
    empty = hashlib.sha256(b"").hexdigest()
    out = out.select(
        "id", "key", "n",
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out if with_text else out.drop("kept")
