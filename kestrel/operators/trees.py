"""Grid searches of forests and boosted trees on cells (L1, L2).

A tree sees a row only through its bins (MAX_BINS values of a feature at most, as in Spark
ML).  Rows of the same bins are one *cell* with a count for each fold and class, and the
draws are made on the counts: Poisson(n) is the sum of n draws of Poisson(1), Binomial(n, p)
that of n draws with p.  So a fit sees every row, whether rows share cells or not.

Each task grows some trees of one fold, or one chain of boosted trees, on all cells of the
fold; a task's memory grows with the cells (about 100 bytes each), and above MAX_CELLS the
callers fit Spark's estimators, which deal the rows out.  The rules are Spark ML's: Gini
or variance gain, Poisson bags, features drawn for each node, subtrees of one prediction
merged in forests, logistic loss with means of the residuals as leaves in boosted trees.

Points of a grid share what is the same in them.  Trees, bags and drawn features depend on
the seed, the tree's number and the node's path only, so the trees of 50 are the first 50 of
200, trees of depth 10 are those of depth 30 cut at 10, and 100 rounds of boosting are the
first 100 of 300: they are grown once and scored at each point.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

MAX_BINS = 32
MAX_CELLS = 4_000_000
MAX_CLASSES = 100
#: trees of a forest that a task grows at most; cells whose votes are added up together
TASK_TREES, CHUNK = 8, 1 << 15
#: entries of a histogram of nodes and bins; joint bins of features counted in one go
HISTOGRAM, JOINT = 1 << 21, 512
LEAST_GAIN = 1e-12

# ---------------------------------------------------------------- bins and cells


def _matrix(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a contiguous matrix of bytes as binary values."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def fit_edges(rows: DataFrame, features: str) -> list[list[float]]:
    """For each feature the ascending edges of its bins (bin i: above i edges): midpoints of
    neighbouring values, or quantiles where there are more than MAX_BINS values.  Values of
    all rows count, whatever their fold; labels do not.  The driver gets MAX_BINS values a feature."""
    x = rows.select(vector_to_array(features).alias("x"))

    def run(batches):
        for b in batches:
            for f, column in enumerate(_matrix(b.column(0)).T if b.num_rows else ()):
                v = np.unique(column)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(v)], names=["f", "v"])

    values = checkpointed(x.mapInArrow(run, "f int, v double").distinct())
    wide = {r["f"]: r["n"] > MAX_BINS for r in values.groupBy("f").agg(F.count("*").alias("n")).collect()}
    if not wide:
        raise ValueError("no rows to fit trees on")
    found = {f: [] for f in wide}
    for f, v in values.where(F.col("f").isin([f for f in wide if not wide[f]])).collect():
        found[f].append(v)
    edges = [[(a + b) / 2 for a, b in zip(v, v[1:])] for _, v in sorted((f, sorted(v)) for f, v in found.items())]
    cuts = [i / MAX_BINS for i in range(1, MAX_BINS)]
    if any(wide.values()):
        got = x.agg(*[F.percentile_approx(F.col("x")[f], cuts, 10_000).alias(f"q{f}") for f in wide if wide[f]]).first()
        top = x.agg(*[F.max(F.col("x")[f]).alias(f"q{f}") for f in wide if wide[f]]).first()
        for f in wide:
            if wide[f]:
                edges[f] = sorted({q for q in got[f"q{f}"] if q < top[f"q{f}"]})
    return edges


def with_key(rows: DataFrame, features: str, edges: list[list[float]], out: str = "_key") -> DataFrame:
    """``out``: a byte for each feature, its bin."""
    steps = [np.array(e, float) for e in edges]

    @F.arrow_udf("binary")
    def key(x: pa.Array) -> pa.Array:
        m = _matrix(x)
        return _binary(np.column_stack([np.searchsorted(e, m[:, f]) for f, e in enumerate(steps)]).astype(np.uint8))

    return rows.withColumn(out, key(vector_to_array(features)))


@dataclass
class Cells:
    """``table``: key and n_<slot>_<class>, a row for each cell; a row's slot is its fold."""
    table: DataFrame
    edges: list[list[float]]
    slots: int
    classes: int


def count_classes(rows: DataFrame, label: str) -> int:
    """One more than the highest label, 2 at least; labels are whole numbers from 0 on."""
    y = F.col(label).cast("double")
    n, known, least, most, whole = rows.agg(F.count(F.lit(1)), F.count(y), F.min(y), F.max(y), F.min((y == F.floor(y)).cast("int"))).first()
    if n != known or n and (least < 0 or most >= MAX_CLASSES or not whole):
        raise ValueError(f"labels in {label} must be whole numbers from 0 to {MAX_CLASSES - 1}, without nulls")
    return max(2, int(most or 0) + 1)


def cells(rows: DataFrame, features: str, label: str, slot: str, slots: int) -> Cells | None:
    """The cells of ``rows``, whose column ``slot`` is 0 .. slots - 1; None if they are more than MAX_CELLS."""
    classes, edges = count_classes(rows, label), fit_edges(rows, features)
    keyed = with_key(rows, features, edges).select("_key", F.col(slot).alias("s"), F.col(label).cast("int").alias("y"))
    count = [F.count(F.when((F.col("s") == s) & (F.col("y") == c), 1)).cast("int").alias(f"n_{s}_{c}") for s in range(slots) for c in range(classes)]
    table = checkpointed(keyed.groupBy("_key").agg(*count))
    return Cells(table, edges, slots, classes) if table.count() <= MAX_CELLS else None


def _tasks(spark, n: int) -> list[int]:
    """n numbers whose hashes fall into n partitions, one into each."""
    ids = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).orderBy("p")
    found = [r["id"] for r in ids.collect()]
    return (found + [i for i in range(40 * n) if i not in set(found)])[:n]


def _dealt(c: Cells, work: list[tuple]) -> tuple[DataFrame, dict]:
    """Blocks of cells for each task, one partition a task, and {task: its entry of ``work``}.
    An entry begins with the fold that is held out (None: no fold).  A block has keys,
    counts of the training side and those of the fold, cells without rows in them aside."""
    spark, slots, classes = c.table.sparkSession, c.slots, c.classes
    folds = sorted({w[0] for w in work}, key=str)
    ids = _tasks(spark, len(work))

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            n = np.column_stack([col.to_numpy(zero_copy_only=False) for col in b.columns[1:]]).astype(np.int32).reshape(-1, slots, classes)
            for i, fold in enumerate(folds):
                held = n[:, fold] if fold is not None else np.zeros_like(n[:, 0])
                train = n.sum(axis=1, dtype=np.int32) - held
                some = (train + held).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([np.ascontiguousarray(v[some]).tobytes()], pa.binary()) for v in (keys, train, held)]],
                                                 names=["f", "keys", "train", "held"])

    blocks = c.table.mapInArrow(pack, "f int, keys binary, train binary, held binary")
    deal = spark.createDataFrame([(folds.index(w[0]), t) for t, w in zip(ids, work, strict=True)], "f int, task long")
    # a small table: an entry for each task
    return blocks.join(F.broadcast(deal), "f").repartition(len(work), "task"), dict(zip(ids, work, strict=True))


def _loaded(table: pa.Table, features: int, classes: int):
    """(bins, training counts, held counts) in the order of the keys, however they were dealt."""
    def of(name, kind, width):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(-1, width)

    x = of("keys", np.uint8, features)
    order = np.argsort(x.view(f"S{features}").ravel(), kind="stable")
    return x[order], of("train", np.int32, classes)[order], of("held", np.int32, classes)[order]


# ---------------------------------------------------------------- forests


#: Spark's values of what a grid does not name
FOREST_DEFAULTS = {"maxDepth": 5, "numTrees": 20}


def subset_size(strategy: str, features: int, trees: int = 1) -> int:
    """Features drawn for a node by Spark's ``featureSubsetStrategy``."""
    s = str(strategy).lower()
    if s == "auto":
        s = "all" if trees == 1 else "sqrt"
    if s in ("all", "sqrt", "log2", "onethird"):
        return {"all": features, "sqrt": ceil(sqrt(features)), "log2": max(1, ceil(log2(features))), "onethird": ceil(features / 3)}[s]
    if s.isdigit():
        return min(features, max(1, int(s)))
    return max(1, min(features, ceil(float(s) * features)))


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _drawn(paths: np.ndarray, seed: int, tree: int, features: int, m: int) -> np.ndarray:
    """m of the features for each node, by hashes of its path."""
    if m >= features:
        return np.broadcast_to(np.arange(features), (len(paths), features))
    with np.errstate(over="ignore"):
        h = _mix(paths * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) & (2**64 - 1)))
        h = _mix(h[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.sort(np.argpartition(h, m - 1, axis=1)[:, :m], axis=1)


@dataclass
class Level:
    """The nodes of a depth: feature (-1: a leaf), the last bin that goes left, number of the
    left child on the next level (the right one follows), class weights, gain of the split."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    weight: np.ndarray
    gain: np.ndarray


def _best_splits(flat, width, row, node, w, total, drawn, bins):
    """(gain, feature, cut, left weights) of the best split of each node; rows in any order."""
    k, classes = total.shape
    size = total.sum(axis=1)
    top, feature, cut, left = np.full(k, -np.inf), np.zeros(k, np.int16), np.zeros(k, np.uint8), np.zeros((k, classes))
    every = np.arange(k)
    for j in range(drawn.shape[1]):
        at = node * bins + flat[row * width + drawn[node, j]]
        lefts = [np.cumsum(np.bincount(at, w[:, c], k * bins).reshape(k, bins), axis=1)[:, :-1] for c in range(classes)]
        lw = sum(lefts)
        rw = size[:, None] - lw
        with np.errstate(divide="ignore", invalid="ignore"):
            score = sum(v * v for v in lefts) / lw + sum((total[:, c, None] - v) ** 2 for c, v in enumerate(lefts)) / rw
        score[(lw < 1) | (rw < 1)] = -np.inf
        b = score.argmax(axis=1)
        s = score[every, b]
        new = s > top
        top[new], feature[new], cut[new] = s[new], drawn[new, j], b[new]
        for c in range(classes):
            left[new, c] = lefts[c][new, b[new]]
    with np.errstate(invalid="ignore"):
        return top / size - (total * total).sum(axis=1) / size ** 2, feature, cut, left


def grow(x: np.ndarray, w: np.ndarray, bins: int, depth: int, m: int, seed: int, tree: int) -> list[Level]:
    """A tree on cells of bins ``x`` with class weights ``w``."""
    some = w.any(axis=1)
    x, w = x[some], w[some].astype(float)
    flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    row, node, paths, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(1, np.uint64), w.sum(axis=0)[None]
    levels = []
    for level in range(depth + 1):
        k = len(total)
        here = Level(np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.zeros(k, np.int64), total, np.zeros(k))
        levels.append(here)
        mixed = total.max(axis=1) < total.sum(axis=1)
        if level == depth or not mixed.any():
            break
        keep = mixed[node]
        row, node, open_ = row[keep], (np.cumsum(mixed) - 1)[node[keep]], np.flatnonzero(mixed)
        drawn, step = _drawn(paths[open_], seed, tree, width, m), max(1, HISTOGRAM // bins)
        if len(open_) <= step:
            gain, feature, cut, left = _best_splits(flat, width, row, node, w[row], total[open_], drawn, bins)
        else:
            order = np.argsort(node, kind="stable")
            row, node = row[order], node[order]
            parts = []
            for a in range(0, len(open_), step):
                lo, hi = np.searchsorted(node, [a, a + step])
                parts.append(_best_splits(flat, width, row[lo:hi], node[lo:hi] - a, w[row[lo:hi]], total[open_[a:a + step]], drawn[a:a + step], bins))
            gain, feature, cut, left = (np.concatenate(p) for p in zip(*parts, strict=True))
        split = gain > LEAST_GAIN
        if not split.any():
            break
        at, child = open_[split], 2 * (np.cumsum(split) - 1)
        here.feature[at], here.cut[at], here.left[at], here.gain[at] = feature[split], cut[split], child[split], gain[split]
        keep = split[node]
        row, node = row[keep], node[keep]
        node = child[node] + (flat[row * width + feature[node]] > cut[node])
        total = np.stack([left[split], total[at] - left[split]], axis=1).reshape(-1, w.shape[1])
        paths = np.stack([2 * paths[at], 2 * paths[at] + np.uint64(1)], axis=1).ravel()
    return levels


def leaves(levels: list[Level], depth: int) -> list[np.ndarray]:
    """For each level down to ``depth`` which nodes are leaves of the tree cut there: those that
    were not split, and those whose children are leaves of the same prediction."""
    out: list = []
    for k in range(min(depth, len(levels) - 1), -1, -1):
        here = levels[k]
        leaf = here.feature < 0
        if k == depth:
            leaf = np.ones_like(leaf)
        elif out:
            inner = np.flatnonzero(~leaf)
            a = here.left[inner]
            said, below = levels[k + 1].weight.argmax(axis=1), out[-1]
            leaf[inner] = below[a] & below[a + 1] & (said[a] == said[a + 1])
        out.append(leaf)
    return out[::-1]


def _answers(levels: list[Level], depth: int) -> list[np.ndarray]:
    """For each level what a row that is there gets: the class shares of its leaf in the tree cut at ``depth``."""
    leaf, out = leaves(levels, depth), []
    for k in range(len(leaf)):
        own = levels[k].weight / levels[k].weight.sum(axis=1, keepdims=True)
        if k:
            inner = np.repeat(np.flatnonzero(levels[k - 1].feature >= 0), 2)
            done = resolved[inner]
            own[done], done_here = out[-1][inner][done], done
        else:
            done_here = np.zeros(len(own), bool)
        resolved = leaf[k] | done_here
        out.append(own)
    return out


def votes(levels: list[Level], x: np.ndarray, depths: list[int]) -> dict[int, np.ndarray]:
    """{depth: class shares of the leaf that each row of ``x`` reaches in the tree cut there}."""
    answers = {d: _answers(levels, d) for d in depths}
    out = {d: np.empty((len(x), levels[0].weight.shape[1])) for d in depths}
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, here in enumerate(levels):
        end = here.feature[node] < 0
        for d in depths:
            if d == k:
                out[d][row] = answers[d][k][node]
            elif d > k:
                out[d][row[end]] = answers[d][k][node[end]]
        row, node = row[~end], node[~end]
        if not len(row):
            break
        node = here.left[node] + (x[row, here.feature[node]] > here.cut[node])
    return out


def _bag(n: np.ndarray, seed: int, tree: int) -> np.ndarray:
    return np.random.default_rng([seed & 0xFFFFFFFF, tree]).poisson(n)


def _ranges(trees: int) -> list[tuple[int, int]]:
    return [(a, min(trees, a + TASK_TREES)) for a in range(0, trees, TASK_TREES)]


def _groups(points: list[dict], features: int) -> dict:
    """{features drawn for a node: (depths, numbers of trees)} of the points."""
    out: dict = {}
    for p in points:
        m = subset_size("auto", features, p["numTrees"])
        d, s = out.setdefault(m, (set(), set()))
        d.add(p["maxDepth"])
        s.add(p["numTrees"])
    return {m: (sorted(d), sorted(s)) for m, (d, s) in out.items()}


def forest_scores(c: Cells, points: list[dict], folds: list[int], seed: int) -> dict:
    """{(maxDepth, numTrees, fold): (rows, hits)} of forests fitted on the other folds."""
    out: dict = {}
    for m, (depths, sizes) in _groups(points, len(c.edges)).items():
        got = _nested_scores(c, m, depths, sizes, folds, seed)
        out |= {(d, size, k): got.get((k, d, size), (0, 0)) for d in depths for size in sizes for k in folds}
    return out


def _nested_scores(c: Cells, m: int, depths: list[int], sizes: list[int], folds: list[int], seed: int) -> dict:
    """{(fold, depth, number of trees): (rows, hits)}: the largest forest of each fold is grown
    once, its votes are added up by depth and by the numbers of trees."""
    features, classes, bins = len(c.edges), c.classes, max(len(e) + 1 for e in c.edges)
    jobs, where = _dealt(c, [(fold, a, b) for fold in folds for a, b in _ranges(sizes[-1])])

    def run(table):
        fold, start, end = where[table.column("task")[0].as_py()]
        x, train, held = _loaded(table, features, classes)
        seen = held.any(axis=1)
        tested, held = x[seen], held[seen]
        sums = {}
        for t in range(start, end):
            part = bisect_right(sizes, t)
            for d, v in votes(grow(x, _bag(train, seed, t), bins, depths[-1], m, seed, t), tested, depths).items():
                sums[part, d] = sums[part, d] + v if (part, d) in sums else v
        if start == 0:
            sums[-1, 0] = held.astype(float)
        got = [{"fold": fold, "chunk": i, "part": part, "depth": d, "sums": np.ascontiguousarray(v[i * CHUNK:(i + 1) * CHUNK]).tobytes()}
               for (part, d), v in sums.items() for i in range(-(-len(v) // CHUNK))]
        return pa.Table.from_pylist(got, schema=pa.schema([*[(n, pa.int32()) for n in ("fold", "chunk", "part", "depth")], ("sums", pa.binary())]))

    def add(table):
        sums = {}
        for part, d, v in zip(*(table.column(n).to_pylist() for n in ("part", "depth", "sums")), strict=True):
            v = np.frombuffer(v).reshape(-1, classes)
            sums[part, d] = sums[part, d] + v if (part, d) in sums else v
        held, rows = sums[-1, 0], []
        for d in depths:
            total = np.zeros_like(held)
            for part, size in enumerate(sizes):
                total = total + sums[part, d]
                said = np.round(total, 9).argmax(axis=1)
                rows.append({"fold": table.column("fold")[0].as_py(), "depth": d, "trees": size, "n": int(held.sum()),
                             "correct": int(held[np.arange(len(held)), said].sum())})
        return pa.Table.from_pylist(rows, schema=pa.schema([*[(n, pa.int32()) for n in ("fold", "depth", "trees")], ("n", pa.int64()), ("correct", pa.int64())]))

    grown = jobs.groupBy("task").applyInArrow(run, "fold int, chunk int, part int, depth int, sums binary")
    scored = grown.groupBy("fold", "chunk").applyInArrow(add, "fold int, depth int, trees int, n long, correct long")
    total = scored.groupBy("fold", "depth", "trees").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    return {(r["fold"], r["depth"], r["trees"]): (r["n"], r["correct"]) for r in total.collect()}


def _flat(levels: list[Level], depth: int, width: int):
    """(feature, cut, left child, class shares) of the tree cut at ``depth``, its nodes level by
    level, and each feature's share of the tree's gain (gain times rows, summed over its nodes)."""
    leaf = leaves(levels, depth)
    feature, cut, left, share, reached, base, worth = [], [], [], [], np.ones(1, bool), 0, np.zeros(width)
    for k, ends in enumerate(leaf):
        here = levels[k]
        at = np.flatnonzero(reached)
        split = ~ends[at]
        feature.append(np.where(split, here.feature[at], -1))
        cut.append(here.cut[at])
        left.append(np.where(split, base + len(at) + 2 * (np.cumsum(split) - 1), 0))
        share.append(here.weight[at] / here.weight[at].sum(axis=1, keepdims=True))
        worth += np.bincount(here.feature[at[split]], here.gain[at[split]] * here.weight[at[split]].sum(axis=1), width)
        base += len(at)
        if k + 1 < len(leaf):
            reached = np.repeat(reached[here.feature >= 0] & ~ends[here.feature >= 0], 2)
    return (np.concatenate(feature).astype(np.int16), np.concatenate(cut).astype(np.uint8),
            np.concatenate(left).astype(np.int32), np.concatenate(share).astype(np.float64), worth / (worth.sum() or 1.0))


class _Model:
    """What was fitted, with Spark's ``transform`` and ``getOrDefault``."""
    edges: list[list[float]]
    features: str
    params: dict

    def getOrDefault(self, name: str):  # noqa: N802 - as in Spark ML
        return self.params[name]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (an array) and ``prediction``; equal rows are scored once."""
        rows = with_key(df, self.features, self.edges)
        return rows.join(self._scored(rows.select("_key").distinct()), "_key", "left").drop("_key")


class ForestModel(_Model):
    """``trees``: a stored table with a row for each tree.  Nodes of all rows are kept from
    level to level while a tree grows (``cacheNodeIds``)."""

    def __init__(self, trees: DataFrame, c: Cells, features: str, params: dict):
        self.trees, self.edges, self.classes, self.features = trees, c.edges, c.classes, features
        self.params = {"cacheNodeIds": True, **params}

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as in Spark ML
        """The trees' shares of gain, summed and made to sum to 1 (a row for each tree reaches the driver)."""
        worth = sum(np.frombuffer(r["worth"]) for r in self.trees.orderBy("tree").select("worth").collect())
        return DenseVector(worth / (worth.sum() or 1.0))

    def _scored(self, keys: DataFrame) -> DataFrame:
        width, classes, parts = len(self.edges), self.classes, len(_ranges(self.params["numTrees"]))
        deal = self.trees.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))

        def pack(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(b.column(0).to_pylist())], pa.binary())], names=["keys"])

        blocks = checkpointed(keys.mapInArrow(pack, "keys binary").withColumn("block", F.monotonically_increasing_id()))
        blocks = blocks.crossJoin(F.broadcast(deal)).repartition(parts, "part")  # as many numbers as tasks of trees

        def run(trees, blocks):
            trees = [[np.frombuffer(v, kind) for v, kind in zip(t, (np.int16, np.uint8, np.int32, np.float64), strict=True)]
                     for t in zip(*(trees.column(n).to_pylist() for n in ("feature", "cut", "left", "share")), strict=True)]
            out = []
            for block, keys in zip(blocks.column("block").to_pylist(), blocks.column("keys").to_pylist(), strict=True):
                x = np.frombuffer(keys, np.uint8).reshape(-1, width)
                total = np.zeros((len(x), classes))
                for feature, cut, left, share in trees:
                    node, row = np.zeros(len(x), np.int64), np.arange(len(x))
                    while len(row := row[feature[node[row]] >= 0]):
                        at = node[row]
                        node[row] = left[at] + (x[row, feature[at]] > cut[at])
                    total += share.reshape(-1, classes)[node]
                out.append({"block": block, "keys": keys, "sums": total.tobytes()})
            return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("sums", pa.binary())]))

        def add(table):
            keys = table.column("keys")[0].as_py()
            total = sum(np.frombuffer(v).reshape(-1, classes) for v in table.column("sums").to_pylist())
            said = np.round(total, 9).argmax(axis=1).astype(float)
            return pa.Table.from_arrays([_binary(np.frombuffer(keys, np.uint8).reshape(-1, width)),
                                         pa.array(list(total / total.sum(axis=1, keepdims=True)), pa.list_(pa.float64())), pa.array(said)],
                                        names=["_key", "probability", "prediction"])

        dealt = self.trees.repartition(parts, "part").groupBy("part")
        voted = dealt.cogroup(blocks.groupBy("part")).applyInArrow(run, "block long, keys binary, sums binary")
        return voted.groupBy("block").applyInArrow(add, "_key binary, probability array<double>, prediction double")


def fit_forest(c: Cells, features: str, seed: int, maxDepth: int, numTrees: int) -> ForestModel:  # noqa: N803 - Spark's names
    """The forest of one point on the rows of all folds."""
    width, classes, bins = len(c.edges), c.classes, max(len(e) + 1 for e in c.edges)
    m, names = subset_size("auto", width, numTrees), ("feature", "cut", "left", "share", "worth")
    jobs, where = _dealt(c, [(None, a, b) for a, b in _ranges(numTrees)])

    def run(table):
        _, start, end = where[table.column("task")[0].as_py()]
        x, train, _ = _loaded(table, width, classes)
        rows = []
        for t in range(start, end):
            parts = _flat(grow(x, _bag(train, seed, t), bins, maxDepth, m, seed, t), maxDepth, width)
            rows.append({"tree": t, "part": t // TASK_TREES, **dict(zip(names, (p.tobytes() for p in parts), strict=True))})
        return pa.Table.from_pylist(rows, schema=pa.schema([("tree", pa.int32()), ("part", pa.int32()), *[(n, pa.binary()) for n in names]]))

    trees = jobs.groupBy("task").applyInArrow(run, "tree int, part int, " + ", ".join(f"{n} binary" for n in names))
    return ForestModel(checkpointed(trees), c, features, {"maxDepth": maxDepth, "numTrees": numTrees})


# ---------------------------------------------------------------- boosted trees


class _Joint:
    """Features in groups of at most JOINT joint bins: a group's rows are counted once, and the
    left sides of all its splits are sums over its joint bins."""

    def __init__(self, x: np.ndarray, bins: list[int]):
        groups: list = []
        for f in sorted((f for f in range(len(bins)) if bins[f] > 1), key=lambda f: -bins[f]):
            g = next((g for g in groups if g[1] * bins[f] <= JOINT), None)
            if g is None:
                groups.append(g := [[], 1])
            g[0].append(f)
            g[1] *= bins[f]
        self.code, self.size, self.left, self.right, self.first, feature, cut = [], [], [], [], [], [], []
        for members, size in groups:
            code, each, stride = np.zeros(len(x), np.int64), np.arange(size), 1
            left = []
            for f in members:
                code += x[:, f].astype(np.int64) * stride
                own = each // stride % bins[f]
                for b in range(bins[f] - 1):
                    left.append(own <= b)
                    feature.append(f)
                    cut.append(b)
                stride *= bins[f]
            self.code.append(code)
            self.size.append(size)
            self.first.append(len(feature) - len(left))
            self.left.append(np.array(left, float).T.copy())
            # one row more, for nodes that this group does not split
            self.right.append(np.vstack([~np.array(left), np.zeros((1, size), bool)]).astype(np.int64))
        self.feature, self.cut = np.array(feature, np.int64), np.array(cut, np.int64)


def _thinned(n: np.ndarray, rate: float, rng) -> np.ndarray:
    if rate >= 1:
        return n.astype(float)
    out = (rng.random(len(n)) < rate) * (n == 1).astype(float)
    many = np.flatnonzero(n > 1)
    out[many] = rng.binomial(n[many], rate)
    return out


def boost(joint: _Joint, n: np.ndarray, width: int, depth: int, step: float, rate: float, m: int, rounds: int, seed: int):
    """Rounds of boosting on cells with counts ``n`` of the classes 0 and 1.  Yields after each
    the margins of all cells and the tree: split features (-1: none), cuts, values of the leaves."""
    margin = np.zeros(len(n))
    for t in range(rounds):
        rng = np.random.default_rng([seed & 0xFFFFFFFF, t])
        zeros, ones = _thinned(n[:, 0], rate, rng), _thinned(n[:, 1], rate, rng)
        weight = zeros + ones
        # the first tree fits the labels -1 and 1, the others what 2 log(1 + exp(-2 y F)) leaves
        rest = weight * (4 / (1 + np.exp(2 * margin))) - 4 * zeros if t else ones - zeros
        pos, live = np.zeros(len(n), np.int64), np.ones(1, bool)
        w, s = np.array([weight.sum()]), np.array([rest.sum()])
        features, cuts = [], []
        for level in range(depth):
            k = 1 << level
            at = [pos * size + code for size, code in zip(joint.size, joint.code, strict=True)]
            both = [(np.bincount(a, weight, k * size).reshape(k, size) @ left, np.bincount(a, rest, k * size).reshape(k, size) @ left)
                    for a, size, left in zip(at, joint.size, joint.left, strict=True)]
            if not both:
                features.append(np.full(k, -1))
                cuts.append(np.zeros(k, np.int64))
                pos, w, s = 2 * pos, np.stack([w, 0 * w], 1).ravel(), np.stack([s, 0 * s], 1).ravel()
                continue
            lw, ls = np.hstack([b[0] for b in both]), np.hstack([b[1] for b in both])
            rw, rs = w[:, None] - lw, s[:, None] - ls
            ok = live[:, None] & (lw >= 1) & (rw >= 1)
            if m < width:
                drawn = rng.random((k, width)).argsort(axis=1).argsort(axis=1) < m
                ok &= drawn[:, joint.feature]
            score = np.where(ok, ls * ls / np.where(ok, lw, 1) + rs * rs / np.where(ok, rw, 1), -np.inf)
            best, every = score.argmax(axis=1), np.arange(k)
            live = score[every, best] - s * s / np.maximum(w, 1) > LEAST_GAIN * np.maximum(w, 1)
            features.append(np.where(live, joint.feature[best], -1))
            cuts.append(joint.cut[best])
            right = 0
            for a, first, table in zip(at, joint.first, joint.right, strict=True):
                own = np.where(live & (best >= first) & (best < first + len(table) - 1), best - first, len(table) - 1)
                right = right + table[own].ravel()[a]
            pos = 2 * pos + right
            w = np.stack([np.where(live, lw[every, best], w), np.where(live, rw[every, best], 0)], 1).ravel()
            s = np.stack([np.where(live, ls[every, best], s), np.where(live, rs[every, best], 0)], 1).ravel()
            live = np.repeat(live, 2)
        value = s / np.maximum(w, 1) * (step if t else 1.0)
        margin = margin + value[pos]
        yield margin, (np.concatenate(features) if features else np.zeros(0, np.int64), np.concatenate(cuts) if cuts else np.zeros(0, np.int64), value)


GBT_DEFAULTS = {"maxDepth": 5, "maxIter": 20, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def _chain(p: dict) -> tuple:
    return tuple(p[n] for n in ("maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy"))


def boosted_scores(c: Cells, points: list[dict], folds: list[int], seed: int) -> dict:
    """{(number of the point, fold): (rows, hits)} of boosted trees fitted on the other folds."""
    if c.classes != 2:
        raise ValueError("boosted trees take the labels 0 and 1")
    full = [{**GBT_DEFAULTS, **p} for p in points]
    chains: dict = {}
    for p in full:
        chains.setdefault(_chain(p), set()).add(p["maxIter"])
    width, bins = len(c.edges), [len(e) + 1 for e in c.edges]
    jobs, where = _dealt(c, [(fold, chain) for chain in sorted(chains, reverse=True, key=lambda v: v[0]) for fold in folds])

    def run(table):
        fold, (depth, step, rate, strategy) = where[table.column("task")[0].as_py()]
        ends = chains[depth, step, rate, strategy]
        x, train, held = _loaded(table, width, 2)
        rows = []
        for t, (margin, _) in enumerate(boost(_Joint(x, bins), train, width, depth, step, rate, subset_size(strategy, width), max(ends), seed), 1):
            if t in ends:
                rows.append({"fold": fold, "depth": depth, "step": step, "rate": rate, "strategy": str(strategy), "rounds": t,
                             "n": int(held.sum()), "correct": int(held[np.arange(len(held)), (margin > 0).astype(int)].sum())})
        return pa.Table.from_pylist(rows, schema=pa.schema([("fold", pa.int32()), ("depth", pa.int32()), ("step", pa.float64()), ("rate", pa.float64()),
                                                            ("strategy", pa.string()), ("rounds", pa.int32()), ("n", pa.int64()), ("correct", pa.int64())]))

    got = jobs.groupBy("task").applyInArrow(run, "fold int, depth int, step double, rate double, strategy string, rounds int, n long, correct long")
    found = {(r["fold"], r["depth"], r["step"], r["rate"], r["strategy"], r["rounds"]): (r["n"], r["correct"]) for r in got.collect()}
    return {(i, k): found[k, p["maxDepth"], p["stepSize"], p["subsamplingRate"], str(p["featureSubsetStrategy"]), p["maxIter"]]
            for i, p in enumerate(full) for k in folds}


class BoostedModel(_Model):
    """Trees as arrays on the driver: 2^depth values a tree."""

    def __init__(self, trees: list, c: Cells, features: str, params: dict):
        self.trees, self.edges, self.features, self.params = trees, c.edges, features, params

    def _scored(self, keys: DataFrame) -> DataFrame:
        width, trees, depth = len(self.edges), self.trees, self.params["maxDepth"]

        def run(batches):
            for b in batches:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, width)
                row, margin = np.arange(len(x)), np.zeros(len(x))
                for feature, cut, value in trees:
                    pos = np.zeros(len(x), np.int64)
                    for level in range(depth):
                        at = pos + (1 << level) - 1
                        f = feature[at]
                        pos = 2 * pos + ((f >= 0) & (x[row, f] > cut[at]))
                    margin += value[pos]
                p = 1 / (1 + np.exp(-2 * margin))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.column_stack([1 - p, p])), pa.list_(pa.float64())), pa.array((margin > 0).astype(float))],
                                                 names=["_key", "probability", "prediction"])

        return keys.mapInArrow(run, "_key binary, probability array<double>, prediction double")


def fit_boosted(c: Cells, features: str, seed: int, **params) -> BoostedModel:
    """Boosted trees of one point on the rows of all folds (one chain, so one task)."""
    p = {**GBT_DEFAULTS, **params}
    width, bins = len(c.edges), [len(e) + 1 for e in c.edges]
    jobs, _ = _dealt(c, [(None,)])

    def run(table):
        x, train, _ = _loaded(table, width, 2)
        m = subset_size(p["featureSubsetStrategy"], width)
        rows = [{"t": t, **dict(zip(("feature", "cut", "value"), (v.tobytes() for v in tree), strict=True))}
                for t, (_, tree) in enumerate(boost(_Joint(x, bins), train, width, p["maxDepth"], p["stepSize"], p["subsamplingRate"], m, p["maxIter"], seed))]
        return pa.Table.from_pylist(rows, schema=pa.schema([("t", pa.int32()), *[(n, pa.binary()) for n in ("feature", "cut", "value")]]))

    got = jobs.groupBy("task").applyInArrow(run, "t int, feature binary, cut binary, value binary").collect()
    trees = [(np.frombuffer(r["feature"], np.int64), np.frombuffer(r["cut"], np.int64), np.frombuffer(r["value"])) for r in sorted(got, key=lambda r: r["t"])]
    return BoostedModel(trees, c, features, p)


# ---------------------------------------------------------------- searches


@dataclass
class Searched:
    """As Spark's CrossValidatorModel: the best model, refitted on all rows, and the mean accuracy of each point."""
    bestModel: object  # noqa: N815 - as in Spark ML
    avgMetrics: list[float]  # noqa: N815
    points: list[dict]


def mean_accuracy(folds: list[tuple[int, int]]) -> float:
    """Mean of the folds' accuracies, empty folds aside."""
    some = [hits / n for n, hits in folds if n]
    return sum(some) / len(some) if some else -1.0
