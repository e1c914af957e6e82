"""Operator 12, ranked lexical search of many queries with shared sub-expressions.

The items (queries) are turned into a sharing DAG by Spark jobs over the item
table.  A leaf is a term with its number of repeats in an item; an item is the
list of its leaves, those in most items first.  In each round neighbours that
stand together in two items or more, and in more than the pairs beside them, are
replaced by a node, so a node stands for a term set shared by several items and
may be built from smaller shared sets.

Documents become slim postings once: length, and occurrences of the items' terms.
Then each task works on some documents at a time: the accumulators of all leaves,
then of the shared nodes level by level (each once, whatever the number of items
that use it), then of the items, which add up what is left of their lists.  The
best TOP documents of a task go to one last ranking per item.

Bounds: items are dealt to blocks of at most BLOCK_TERMS leaves (a longer item is
a block of its own); a block's DAG and weights are what is broadcast, and
each block makes one pass over the postings.  The filter that keeps other terms
out of the postings has a fixed size and only saves work.

Weights: w = floor(1000 ln((2 N + 2) / (2 df + 1))), N documents with a term, df
those that hold this one.  With n terms in the document and L in all,
m = 75 + (25 n N) div L; a term that occurs tf times adds
w * ((1000000000 tf) div (1000 tf + 12 m)) for each of its repeats in the item.

Defined cases: null and empty texts have no terms and are never found; items
without a known term find nothing; repeated document rows are ranked each; equal
scores come by ascending id (null first); repeated item ids are one item with all
their terms; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import bitmap, in_bitmap, materialize, read

TOP = 20
ROUNDS = 5                 # of sharing: a node holds up to 2 ** ROUNDS leaves
BLOCK_TERMS = 1 << 18      # leaves of a block of items
CELLS = 1 << 21            # accumulators (symbols x documents) of a task at a time
SECTION = 1 << 20          # bytes of text looked at together
_NO_ID = -(1 << 63)

_TERM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_lo:_hi] = True


def term_rows(df: DataFrame, text_col: str, id_col: str, mask=None) -> DataFrame:
    """(id, n, terms array<long>, tf array<long>): number of terms of each text,
    and its different terms (64-bit hashes) with their occurrences; with mask (a
    broadcast bitmap) only the terms in it."""
    text, kind = F.col(f"`{text_col}`").cast("string"), df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            buf, off = T.flat(batch.column(1))
            for i, j in T.chunks(off, SECTION):
                part, o = T.lower_ascii(buf[off[i]:off[j]]), off[i:j + 1] - off[i]
                s, e, first = T.runs(_TERM[part], o)
                h = T.word_hashes(part, s, e)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                if mask is not None:
                    on = in_bitmap(mask.value, h.view(np.int64))
                    h, doc = h[on], doc[on]
                terms, code = np.unique(h, return_inverse=True)
                pairs, tf = np.unique(doc * np.int64(max(1, len(terms))) + code, return_counts=True)
                doc, code = np.divmod(pairs, max(1, len(terms)))
                ends = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms[code].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], names=["id", "n", "terms", "tf"])

    src = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    return src.mapInArrow(run, f"id {kind}, n long, terms array<long>, tf array<long>")


def item_leaves(items: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(item, term, qtf, leaf, block) of all items that have a term."""
    rows = term_rows(items, text_col, id_col).select("id", F.explode(F.arrays_zip("terms", "tf")).alias("t"))
    rows = rows.groupBy(F.col("id").alias("item"), F.col("t.terms").alias("term")).agg(F.sum("t.tf").alias("qtf"))
    rows = materialize(rows.withColumn("leaf", F.xxhash64("term", "qtf")), "search-items")
    blocks = max(1, -(-rows.count() // BLOCK_TERMS))
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))


def share(leaves: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[DataFrame]]:
    """(symbols, nodes): symbols (item, block, pos, sym) is what is left of each
    item's list; nodes[r] (block, node, a, b) are the shared sets made in round r."""
    holders = leaves.groupBy("block", "leaf").agg(F.count("*").alias("holders"))
    of_item = Window.partitionBy("block", "item")
    symbols = leaves.join(holders, ["block", "leaf"]).select(
        "item", "block", F.row_number().over(of_item.orderBy(F.desc("holders"), "leaf")).alias("pos"), F.col("leaf").alias("sym"))
    in_order = of_item.orderBy("pos")
    nodes = []
    for _ in range(rounds):
        pairs = symbols.withColumn("b", F.lead("sym").over(in_order))
        pairs = materialize(pairs.withColumn("node", F.when(F.col("b").isNotNull(), F.xxhash64("sym", "b"))), "search-pairs")
        support = pairs.where("node IS NOT NULL").groupBy("block", "node").agg(F.count("*").alias("support")).where("support >= 2")
        rank = F.when(F.col("support").isNotNull(), F.struct("support", "node"))
        met = pairs.join(support, ["block", "node"], "left").withColumn("rank", rank)
        met = met.withColumn("before", F.lag("rank").over(in_order)).withColumn("after", F.lead("rank").over(in_order))
        best = F.col("rank").isNotNull() & (F.col("before").isNull() | (F.col("rank") > F.col("before"))) & (
            F.col("after").isNull() | (F.col("rank") > F.col("after")))
        met = met.withColumn("best", best)
        met = materialize(met.withColumn("gone", F.coalesce(F.lag("best").over(in_order), F.lit(False))), "search-shared")
        nodes.append(met.where("best").select("block", "node", F.col("sym").alias("a"), "b").distinct())
        symbols = met.where("NOT gone").select("item", "block", "pos", F.when(F.col("best"), F.col("node")).otherwise(F.col("sym")).alias("sym"))
    return symbols, nodes


class Plan:
    """One block of items as arrays: leaves, levels of nodes, and the items' lists."""

    def __init__(self, leaves, levels, lists):
        """leaves: rows (leaf, term, qtf * w); levels: lists of rows (node, a, b);
        lists: rows (item number, symbol) by item."""
        symbol = {}
        for leaf, _, _ in leaves:
            symbol[leaf] = len(symbol)
        self.levels = []
        for level in levels:
            level = [row for row in level if row[0] not in symbol]  # a later round may make an earlier node again
            kids = [(symbol[a], symbol[b]) for _, a, b in level]
            self.levels.append((len(symbol), np.array(kids, np.int64).reshape(-1, 2)))
            for node, _, _ in level:
                symbol[node] = len(symbol)
        self.size = len(symbol)
        by_term = sorted(((t, w, symbol[leaf]) for leaf, t, w in leaves))
        self.terms = np.array([t for t, _, _ in by_term], np.int64)
        self.weights = np.array([w for _, w, _ in by_term], np.int64)
        self.rows = np.array([r for _, _, r in by_term], np.int64)
        self.at = np.array([symbol[s] for _, s in lists], np.int64)
        self.items, self.first = np.unique(np.array([k for k, _ in lists], np.int64), return_index=True)

    def scores(self, doc, term, tf, m, n_docs):
        """(items x documents) scores from postings (doc, term, tf); m per document."""
        acc = np.zeros((self.size, n_docs), np.int64)
        # leaves of one term with different repeats stand side by side
        lo, hi = np.searchsorted(self.terms, term), np.searchsorted(self.terms, term, side="right")
        k = hi - lo
        post = np.repeat(np.arange(len(term)), k)
        leaf = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(len(post))
        value = (1_000_000_000 * tf[post]) // (1000 * tf[post] + 12 * m[doc[post]])
        acc[self.rows[leaf], doc[post]] = self.weights[leaf] * value
        for start, kids in self.levels:
            acc[start:start + len(kids)] = acc[kids[:, 0]] + acc[kids[:, 1]]
        return np.add.reduceat(acc[self.at], self.first, axis=0)


class Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(3)]  # item, score, id

    def add(self, scores, ids) -> None:
        item, d = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        item, score, ident = (np.concatenate(x) for x in zip(self.held, (item, scores[item, d], ids[d]), strict=True))
        order = np.lexsort((ident, -score, item))
        item, score, ident = item[order], score[order], ident[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        on = place < self.top
        self.held = [item[on], score[on], ident[on]]
        last = place == self.top - 1
        self.floor[item[last]] = score[last]  # as good as the last one: the id decides


def _search_block(postings: DataFrame, plan: Plan, names: list, kind: str, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item_no, score, id) candidates: the best of each task."""
    shared = postings.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        p = shared.value
        best, step = Best(len(p.items), top), max(1, CELLS // max(1, p.size + len(p.at)))
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            m = 75 + (25 * batch.column(1).to_numpy() * n_docs) // n_terms
            terms = batch.column(2)
            for i in range(0, batch.num_rows, step):
                j = min(batch.num_rows, i + step)
                some, tf = terms.slice(i, j - i), batch.column(3).slice(i, j - i).flatten().to_numpy()
                doc = np.repeat(np.arange(j - i), some.value_lengths().to_numpy())
                best.add(p.scores(doc, some.flatten().to_numpy(), tf, m[i:j], j - i), ids[i:j])
        item, score, ident = best.held
        yield pa.RecordBatch.from_arrays([pa.array(p.items[item], pa.int64()), pa.array(score, pa.int64()), pa.array(ident, pa.int64())],
                                         names=["item_no", "score", "id"])

    found = postings.mapInArrow(run, "item_no long, score long, id long")
    items = postings.sparkSession.createDataFrame(names, f"item_no long, item {kind}")
    return found.join(items, "item_no").select("item", "score", "id")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text_col: str = "text", id_col: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, rank, id, score): the `top` best documents of every item; ids are long."""
    spark = docs.sparkSession
    leaves = item_leaves(items, item_text, item_id)
    kind = leaves.schema["item"].dataType.simpleString()
    empty = spark.createDataFrame([], f"item {kind}, rank int, id long, score long")
    vocabulary = leaves.select("term").distinct()
    mask = spark.sparkContext.broadcast(bitmap(vocabulary, "term"))
    postings = term_rows(docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), text_col, id_col, mask)
    postings = materialize(postings.where("n > 0"), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return empty
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.coalesce("df", F.lit(0)) + 1))).cast("long")
    leaves = materialize(leaves.join(df, "term", "left").withColumn("w", weight * F.col("qtf")), "search-leaves")
    symbols, nodes = share(leaves)
    symbols = materialize(symbols, "search-lists")
    nodes = [materialize(x, "search-nodes") for x in nodes]
    found = None
    for (block,) in sorted(leaves.select("block").distinct().collect()):
        own = F.col("block") == block  # at most BLOCK_TERMS leaves or one item: small enough for the driver
        rows = symbols.where(own).orderBy("item", "pos").select("item", "sym").collect()
        number, lists = {}, []
        for item, sym in rows:
            lists.append((number.setdefault(item, len(number)), sym))
        plan = Plan([tuple(r) for r in leaves.where(own).select("leaf", "term", "w").distinct().collect()],
                    [[tuple(r) for r in x.where(own).select("node", "a", "b").collect()] for x in nodes], lists)
        part = _search_block(postings, plan, [(k, v) for v, k in number.items()], kind, n_docs, n_terms, top)
        found = part if found is None else found.union(part)
    if found is None:
        return empty
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    ident = F.when(F.col("id") != _NO_ID, F.col("id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item", "rank", ident.alias("id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


SQL_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS qtf FROM i GROUP BY item_id, t),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * s.n) // s.l AS m FROM d, s WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) x SEMI JOIN q ON x.t = q.t GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
sc AS (
  SELECT q.item_id, m.r, any_value(m.doc_id) AS doc_id, CAST(sum(q.qtf * wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.t = q.t JOIN wt ON wt.t = q.t JOIN m ON m.r = tf.r GROUP BY q.item_id, m.r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 20
"""
