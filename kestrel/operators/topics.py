"""Topics (T8, T9): latent Dirichlet allocation by online variational Bayes, with the
weights of words by topics in a table.

The steps are those of Spark ML's online optimizer (minibatches of 5 % drawn with
replacement, learning rate (1024 + i) ^ -0.51, priors 1 / k, the documents' prior learned).
There the vocabulary and the matrix are held by the driver and sent whole by every task;
here a word's weights are a row, joined to the blocks of documents that hold the word.
The driver gets k sums, k means and a count for each step, whatever the vocabulary (no
table of words is broadcast, hence the hints).

The words' first weights and the documents' first proportions are drawn by hashes of the
words and numbers of the blocks, not by one stream over the matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .ranking import argmax_position
from .text import token_blocks

SHAPE = 100.0            # of the gamma distribution of first values (mean 1)
TAU, KAPPA, FRACTION = 1024, 0.51, 0.05
CHANGE = 1e-3            # mean change of a document's proportions at which it is done
BLOCK_TOKENS = 1 << 20   # tokens of the documents that meet in a task


@dataclass
class TopicModel:
    """``weights`` (token, l0, l1, ...) has a row for each word, ``total`` the sums of its
    columns, ``prior`` the documents' prior."""
    weights: DataFrame
    total: np.ndarray
    prior: np.ndarray
    seed: int

    @property
    def k(self) -> int:
        return len(self.prior)


def digamma(x) -> np.ndarray:
    """For positive x: recurrence up to 8, then the asymptotic series."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out -= np.where(low, 1 / x, 0)
        x += low
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x) -> np.ndarray:
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out += np.where(low, 1 / (x * x), 0)
        x += low
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66))))


def _uniform(h: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes (splitmix)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(draw + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2 ** 53


def hashed_gamma(h: np.ndarray, shape: float = SHAPE) -> np.ndarray:
    """One draw of mean 1 for each hash, by the method of Marsaglia and Tsang."""
    d = shape - 1 / 3
    out, left, draw = np.zeros(len(h)), np.arange(len(h)), 0
    while len(left):
        a, b, u = (_uniform(h[left], draw + i) for i in range(3))
        z = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = np.maximum(1 + z / np.sqrt(9 * d), 1e-300) ** 3
        ok = np.log(u) < 0.5 * z * z + d - d * v + d * np.log(v)
        out[left[ok]] = d * v[ok] / shape
        left, draw = left[~ok], draw + 3
    return out


def _columns(letter: str, k: int) -> list[str]:
    return [f"{letter}{i}" for i in range(k)]


def _first_weights(words: DataFrame, k: int, seed: int) -> DataFrame:
    """A gamma draw for each word and topic, the same however the words are dealt."""
    def run(batches):
        for b in batches:
            h = b.column(1).to_numpy().astype(np.int64).view(np.uint64)
            draws = [hashed_gamma(h ^ np.uint64((i + 1) << 56)) for i in range(k)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, draws)], names=["token", *_columns("l", k)])

    fields = ", ".join(f"{c} double" for c in _columns("l", k))
    return words.select("token", F.xxhash64("token", F.lit(seed)).alias("h")).mapInArrow(run, f"token string, {fields}")


def _expectation(x: np.ndarray) -> np.ndarray:
    """E log of Dirichlet rows."""
    return digamma(x) - digamma(x.sum(axis=1))[:, None]


def infer(doc: np.ndarray, count: np.ndarray, beta: np.ndarray, prior: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Proportions of documents, from the first ones in ``gamma``: entry i is ``count[i]``
    times a word of exp E log weights ``beta[i]`` in document ``doc[i]`` (ascending, every
    number from 0 on occurs).  A document that has settled takes no further part."""
    out, live = gamma.copy(), np.arange(len(gamma))
    while len(live):
        theta = np.exp(_expectation(gamma))
        rate = count / (np.einsum("ij,ij->i", beta, theta[doc]) + 1e-100)
        starts = np.searchsorted(doc, np.arange(len(live)))
        new = theta * np.add.reduceat(beta * rate[:, None], starts) + prior
        going = np.abs(new - gamma).mean(axis=1) > CHANGE
        out[live], gamma = new, new
        if not going.all():
            rows = going[doc]
            beta, count, doc = beta[rows], count[rows], (np.cumsum(going) - 1)[doc[rows]]
            live, gamma = live[going], gamma[going]
    return out


def _entries(table: pa.Table, k: int, total: np.ndarray):
    """(ids of the documents, doc, word, count, exp E log weights by word) of a block,
    entries by document."""
    table = table.combine_chunks()
    ids, ns = (table.column(c).combine_chunks() for c in ("ids", "ns"))
    ids, ns = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, ns))
    size = ids.value_lengths().to_numpy()
    who, count = ids.flatten().to_numpy(), ns.flatten().to_numpy().astype(np.float64)
    word = np.repeat(np.arange(len(size)), size)
    found, doc = np.unique(who, return_inverse=True)
    order = np.argsort(doc, kind="stable")
    lam = np.column_stack([table.column(c).to_numpy() for c in _columns("l", k)])
    return found, doc[order], word[order], count[order], np.exp(digamma(lam) - digamma(total))


def _step(batch: DataFrame, tokens: str, model: TopicModel, step: int) -> DataFrame:
    """(token, s0, s1, ..., n): what a minibatch adds to the words' weights; the row of a
    null token has the sum of the documents' E log proportions and their number."""
    k, total, prior, seed = model.k, model.total, model.prior, model.seed

    def run(table):
        found, doc, word, count, beta = _entries(table, k, total)
        rng = np.random.default_rng([seed & 0xFFFFFFFF, step, table.column("block")[0].as_py()])
        gamma = infer(doc, count, beta[word], prior, rng.gamma(SHAPE, 1 / SHAPE, (len(found), k)))
        log_theta = _expectation(gamma)
        theta = np.exp(log_theta)[doc]
        rate = count / (np.einsum("ij,ij->i", beta[word], theta) + 1e-100)
        sums = [np.bincount(word, theta[:, i] * rate, len(beta)) * beta[:, i] for i in range(k)]
        token = pa.concat_arrays([*table.column("token").chunks, pa.nulls(1, pa.string())])
        n = np.append(np.zeros(len(beta), np.int64), len(found))
        return pa.Table.from_arrays([token, *[pa.array(np.append(s, log_theta[:, i].sum())) for i, s in enumerate(sums)], pa.array(n)],
                                    names=["token", *_columns("s", k), "n"])

    fields = ", ".join(f"{c} double" for c in _columns("s", k))
    rows = batch.withColumn("_row", F.monotonically_increasing_id())  # a document drawn twice is two
    met = token_blocks(rows, "_row", tokens, BLOCK_TOKENS).join(model.weights.hint("merge"), "token")
    parts = met.groupBy("block").applyInArrow(run, f"token string, {fields}, n long")
    return parts.groupBy("token").agg(*[F.sum(c).alias(c) for c in _columns("s", k)], F.sum("n").alias("n"))


def _sums(weights: DataFrame, k: int) -> np.ndarray:
    return np.array([x or 0.0 for x in weights.agg(*[F.sum(c) for c in _columns("l", k)]).first()])


def fit_topics(df: DataFrame, tokens: str, k: int = 3, seed: int = 10, vocab_size: int | None = None,
               max_iter: int = 20) -> TopicModel:
    """Online LDA; the vocabulary is every token unless ``vocab_size`` says otherwise
    (then the most frequent ones).  No token at all gives a model without words."""
    docs = checkpointed(df.select(tokens))
    words = docs.select(F.explode(tokens).alias("token")).where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"))
    if vocab_size:
        words = words.orderBy(F.col("n").desc(), F.col("token").desc()).limit(vocab_size)
    weights = checkpointed(_first_weights(words, k, seed))
    model = TopicModel(weights, _sums(weights, k), np.full(k, 1 / k), seed)
    size = docs.count()
    for step in range(1, max_iter + 1):
        batch = docs.sample(True, FRACTION, seed * 1_000_003 + step)
        found = checkpointed(_step(batch, tokens, model, step))
        about = found.where("token IS NULL").select(*_columns("s", k), "n").first()
        if about is None:  # the minibatch has no word
            continue
        rho = (TAU + step) ** -KAPPA
        share = size / np.ceil(FRACTION * size)
        new = [((1 - rho) * F.col(f"l{i}") + rho * (F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * float(share) + 1 / k)).alias(f"l{i}")
               for i in range(k)]
        weights = checkpointed(model.weights.join(found.where("token IS NOT NULL").hint("merge"), "token", "left").select("token", *new))
        model = TopicModel(weights, _sums(weights, k), learned_prior(model.prior, np.array(about[:k]) / about[k], about[k], rho), seed)
    return model


def learned_prior(prior: np.ndarray, log_theta: np.ndarray, n: int, rho: float) -> np.ndarray:
    """One Newton step of the documents' prior towards the mean E log proportions of n
    documents; left as it is if the step would leave the positive numbers."""
    grad = n * (log_theta - (digamma(prior) - digamma(prior.sum())))
    c, q = n * trigamma(prior.sum()), -n * trigamma(prior)
    b = (grad / q).sum() / (1 / c + (1 / q).sum())
    new = prior - rho * (grad - b) / q
    return new if (new > 0).all() else prior


def top_terms(model: TopicModel, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight) for the n heaviest terms of each topic (equal
    weights: by term)."""
    out = None
    for i in range(model.k):
        one = model.weights.select(F.lit(i).alias("topic"), F.col("token").alias("term"), (F.col(f"l{i}") / F.lit(float(model.total[i]))).alias("weight"))
        one = one.orderBy(F.col("weight").desc(), "term").limit(n)
        out = one if out is None else out.union(one)
    # k x n rows: a topic's few heaviest are numbered in one array
    ranked = out.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))).alias("t"))
    ranked = ranked.select("topic", F.posexplode("t").alias("rank", "t"))
    return ranked.select("topic", (F.col("rank") + 1).alias("rank"), F.col("t.term").alias("term"), (-F.col("t.w")).alias("weight"))


def assign_topics(model: TopicModel, df: DataFrame, tokens: str = "tokens", out: str = "dominant_topic") -> DataFrame:
    """Per-document topic distribution (``topicDistribution``) and its argmax (first
    wins ties; both null when the document has no known term).  Repeated rows stay rows of
    their own."""
    k, total, prior, seed = model.k, model.total, model.prior, model.seed

    def run(table):
        found, doc, word, count, beta = _entries(table, k, total)
        rng = np.random.default_rng([seed & 0xFFFFFFFF, 0, table.column("block")[0].as_py()])
        gamma = infer(doc, count, beta[word], prior, rng.gamma(SHAPE, 1 / SHAPE, (len(found), k)))
        share = gamma / gamma.sum(axis=1)[:, None]
        return pa.Table.from_arrays([pa.array(found), pa.array(list(share), pa.list_(pa.float64()))], names=["_row", "topicDistribution"])

    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    met = token_blocks(rows, "_row", tokens, BLOCK_TOKENS).join(model.weights.hint("merge"), "token")
    shares = met.groupBy("block").applyInArrow(run, "_row long, topicDistribution array<double>")
    best = argmax_position([F.col("topicDistribution")[i] for i in range(k)])
    return rows.join(shares, "_row", "left").withColumn(out, F.when(F.col("topicDistribution").isNotNull(), best)).drop("_row")
