"""Operator 5, benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised inside a sentence) and
units after a number turn into typed placeholders, all else is lower-cased
without edge punctuation.  Windows of WINDOW tokens (whole items if shorter) of
documents and benchmark items are hash-joined; in a matching window each slot
value of the item must map to one value of the document, so a re-parameterised
question is caught and a chance match of placeholders is not.  Windows are judged
one by one: a clash in one does not void the others.  Each window is also joined by
its exact tokens (no placeholders), which finds copies of windows with few literals
and items whose first word is capitalised inside a sentence of the document.

Before the join a bitmap of BITMAP_BITS bits over the benchmark's window hashes
(fixed size, built by Spark) drops document windows that cannot match.

Defined cases: null and empty texts and items have no tokens and match nothing;
items of fewer than MIN_ITEM tokens match nothing; windows with fewer than
MIN_LITERALS literal tokens match by their exact tokens only;
windows never cross documents; documents with equal (id, text) share one
verdict; without benchmark every document is kept; an empty table gives no
rows; columns named like the outputs are replaced by them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import bitmap, in_bitmap, materialize, private, read

WINDOW = 10
MIN_LITERALS = 6   # literal tokens that a window needs (short items: all but 4 of 10, in proportion)
MIN_ITEM = 5       # items with fewer tokens match nothing
BITMAP_BITS = 1 << 22

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
#: fixed values: unit words that become a placeholder after a number
UNITS = frozenset("""mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec secs second seconds min mins minute
minutes h hr hrs hour hours day days week weeks month months year years km/h mph m/s % percent dollar dollars euro
euros usd eur degree degrees""".split())
_EDGE = "\"'`´’‘“”«»()[]{}<>.,;:!?¡¿…-–—*_"
NUM, NAME, UNIT, EXACT = (int(x) for x in T.mix(np.arange(7001, 7005, dtype=np.uint64)))

_SCHEMA = "hash long, pos int, slots array<string>"


def _features(word: str) -> tuple[str, int]:
    """(stripped word, flags): 1 number, 2 unit word, 4 capitalised, 8 ends a sentence."""
    core = word.strip(_EDGE) or word
    flags = 0
    if NUMBER.fullmatch(core) or NUMBER.fullmatch(word):
        flags |= 1
    if core.lower() in UNITS:
        flags |= 2
    if core[:1].isupper():
        flags |= 4
    if word.rstrip("\"')]}’”»")[-1:] in (".", "!", "?", ":", "…"):
        flags |= 8
    return core, flags


#: Bytes after which a word needs a closer look: upper case, digits, punctuation, non-ASCII.
_CLOSER = np.array([not (97 <= b <= 122) for b in range(256)])


def _hash_texts(texts: list[bytes]) -> np.ndarray:
    end = np.cumsum([len(t) for t in texts])
    return T.word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, end[:-1]], end)


_UNIT_HASHES = np.sort(_hash_texts([u.encode() for u in UNITS]))


class _Canon:
    """Template tokens of whole batches.  Plain lower-case words are their own
    token; other words are looked at once each and remembered (bounded)."""

    def __init__(self, limit: int = 100_000):
        self.known: dict[int, tuple[int, int]] = {}
        self.limit = limit

    def _look(self, raw, keys, s, e):
        """(token hash, flags) of distinct words that need a closer look."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        if new:
            cores, flags = zip(*(_features(raw[s[k]:e[k]].decode("utf-8", "replace")) for k in new), strict=True)
            for k, h, f in zip(new, _hash_texts([c.lower().encode() for c in cores]).tolist(), flags, strict=True):
                self.known[keys[k]] = h, f
        got = [self.known[key] for key in keys]
        return np.array([g[0] for g in got], np.uint64), np.array([g[1] for g in got], np.uint8)

    def tokens(self, buf, off):
        """(token hash, the same without placeholders, literal flag, word spans, first word of each document)."""
        s, e, first = T.words(buf, off)
        tok = T.word_hashes(buf, s, e)
        n = len(tok)
        f = np.where(np.isin(tok, _UNIT_HASHES), 2, 0).astype(np.uint8)
        odd = np.concatenate(([0], np.cumsum(_CLOSER[buf], dtype=np.int32)))
        odd = np.flatnonzero(odd[e] > odd[s])
        if len(odd):
            keys, at, code = np.unique(tok[odd], return_index=True, return_inverse=True)
            at = odd[at]
            canon, flags = self._look(buf.tobytes(), keys.tolist(), s[at].tolist(), e[at].tolist())
            tok[odd], f[odd] = canon[code], flags[code]
        prev = np.zeros(n, np.uint8)
        prev[1:] = f[:-1]
        start = np.zeros(n, bool)
        start[first[:-1][first[:-1] < n]] = True
        # a line break before a word starts a sentence
        breaks = np.concatenate(([0], np.cumsum(buf == 10, dtype=np.int32)))
        after_break = np.zeros(n, bool)
        after_break[1:] = breaks[s[1:]] > breaks[e[:-1]]
        prev[start] = 0
        num = f & 1 > 0
        unit = (f & 2 > 0) & (prev & 1 > 0) & ~num
        name = (f & 4 > 0) & ~num & ~unit & ~start & ~after_break & (prev & 8 == 0)
        slotted = np.where(num, np.uint64(NUM), np.where(unit, np.uint64(UNIT), np.where(name, np.uint64(NAME), tok)))
        return slotted, tok, ~(num | unit | name), (s, e), first

    def core(self, buf, s, e) -> str:
        return _features(buf[s:e].tobytes().decode("utf-8", "replace"))[0].lower()


def _literals_needed(n: int) -> int:
    return -(-MIN_LITERALS * n // WINDOW)


def _windows(canon: _Canon, texts: pa.Array, lengths, keep):
    """Per window: (row, hash, pos, slots); keep(hashes) filters before slots are
    read.  A window counts as template, if it has enough literals, and as exact tokens (no slots)."""
    buf, off = T.flat(texts)
    for lo, hi in T.chunks(off, 1 << 20):
        part, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        tok, exact, lit, (s, e), first = canon.tokens(part, o)
        slot = ~lit
        ahead = np.cumsum(np.r_[0, lit])
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n in lengths:
            g = T.gram_hashes(tok, n)
            if not len(g):
                continue
            own_doc = doc[:len(g)] == doc[n - 1:]
            x = T.mix(T.gram_hashes(exact, n) ^ np.uint64(EXACT))
            for i in np.flatnonzero(own_doc & keep(x)).tolist():
                d = doc[i]
                yield lo + int(d), int(x[i].view(np.int64)), int(i - first[d]), []
            ok = own_doc & (ahead[n:] - ahead[:-n] >= _literals_needed(n))
            ok &= keep(g)
            for i in np.flatnonzero(ok).tolist():
                d = doc[i]
                own = np.flatnonzero(slot[i:i + n]) + i
                yield lo + int(d), int(g[i].view(np.int64)), int(i - first[d]), [canon.core(part, s[k], e[k]) for k in own]


def benchmark_windows(bench: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """(item, length, hash, pos, slots) of all benchmark windows."""
    def run(batches):
        canon = _Canon()
        for b in batches:
            texts = b.column(1)
            buf, off = T.flat(texts)
            s, _, first = T.words(buf, off)
            sizes = np.diff(first)
            for n in sorted({min(WINDOW, int(x)) for x in sizes if x >= MIN_ITEM}):
                for r, h, p, slots in _windows(canon, texts, [n], lambda g: np.ones(len(g), bool)):
                    if min(WINDOW, int(sizes[r])) == n:
                        yield b.column(0)[r].as_py(), n, h, p, slots
    def out(batches):
        rows = list(run(batches))
        for i in range(0, len(rows), 4096):
            yield _batch(rows[i:i + 4096], ["item", "length", "hash", "pos", "slots"],
                         [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())])
    src = bench.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    return src.mapInArrow(out, f"item string, length int, {_SCHEMA}")


def _batch(rows, names, types):
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def find_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, text_hash, item, windows): documents that hold a benchmark item with
    consistent slots; doc is the id as string, text_hash xxhash64 of the text."""
    spark = docs.sparkSession
    items = materialize(benchmark_windows(bench), "bench-windows")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most WINDOW values
    mask = spark.sparkContext.broadcast(bitmap(items, "hash", BITMAP_BITS))  # BITMAP_BITS / 8 bytes

    def run(batches):
        canon = _Canon()
        keep = lambda g: in_bitmap(mask.value, g.view(np.int64))
        for b in batches:
            rows = [(b.column(0)[r].as_py(), b.column(1)[r].as_py(), h, p, slots)
                    for r, h, p, slots in _windows(canon, b.column(2), lengths, keep)]
            yield _batch(rows, ["doc", "text_hash", "hash", "pos", "slots"],
                         [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())])

    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").cast("string"), F.xxhash64(text), text)
    cand = src.mapInArrow(run, f"doc string, text_hash long, {_SCHEMA}").distinct()
    theirs = items.select("hash", "item", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    met = cand.join(theirs, "hash").where(F.size("slots") == F.size("item_slots"))
    # one item value maps to one value of the document; equal slots always do
    pairs = F.arrays_zip("item_slots", "slots")
    met = met.where(F.size(F.array_distinct(pairs)) == F.size(F.array_distinct("item_slots")))
    met = met.select("doc", "text_hash", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "pos").distinct()
    return met.groupBy("doc", "text_hash", "item").agg(F.count("*").alias("windows"))


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with items (ids found, as strings), n_windows and contaminated."""
    docs = docs.drop(*[c for c in ("items", "n_windows", "contaminated") if c not in (text_col, id_col)])
    leaks = find_leaks(docs, bench, text_col, id_col).groupBy("doc", "text_hash").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.sum("windows").alias("n_windows"))
    d, t, own_d, own_t = private(docs, "leak_doc", "leak_text", "own_doc", "own_text")
    leaks = leaks.withColumnsRenamed({"doc": d, "text_hash": t})
    # the hash is a column of its own, so the join moves the text only if the caller wants it
    docs = docs.withColumns({own_d: F.col(f"`{id_col}`").cast("string"), own_t: F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    out = docs.join(leaks, F.col(own_d).eqNullSafe(F.col(d)) & (F.col(own_t) == F.col(t)), "left").drop(d, t, own_d, own_t)
    return out.withColumns({"items": F.coalesce("items", F.array().cast("array<string>")),
                            "n_windows": F.coalesce("n_windows", F.lit(0)).cast("long"),
                            "contaminated": F.col("n_windows").isNotNull()})


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.transform("items", lambda x: x.cast("long"))
    return d.select("doc_id", F.array_sort(ids).alias("item_ids"), "n_windows", "contaminated", (~F.col("contaminated")).alias("kept"))
