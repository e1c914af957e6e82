"""Word-level models: scores of unknown words (T5, C8) and dictionary
segmentation of unspaced text (T2).

Both learn from a table of words and work on distinct words or distinct runs of
characters, so that a frequent word or phrase costs once, however often it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.tables import checkpointed
from .text import lexicon_sentiment

# ---------------------------------------------------------------- unknown words

#: lengths of the character n-grams, over the word between its two end marks
GRAM_SIZES = (1, 2, 3)


def char_grams(word, sizes: tuple = GRAM_SIZES) -> Column:
    """Array of the n-grams of ``<word>``, repeats included (sizes 1 to 3: a word of
    one character has all of them)."""
    w = F.concat(F.lit("<"), word if isinstance(word, Column) else F.col(word), F.lit(">"))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))

    return F.flatten(F.array(*[of(n) for n in sizes]))


@dataclass
class WordScorer:
    """Naive Bayes over character n-grams: ``grams`` (gram, weight) holds the log
    odds of the n-grams of the lexicon, ``unseen`` those of any other n-gram, ``prior``
    those of the classes."""
    grams: DataFrame
    unseen: float
    prior: float


def fit_word_scorer(lexicon: DataFrame, sizes: tuple = GRAM_SIZES) -> WordScorer:
    """Fit on a lexicon (word, score): words above 0 are positive, below 0 negative;
    words of score 0, null and empty words teach nothing.  Add-one smoothing.

    N-grams are counted by one partial aggregation; only the five totals reach the
    driver.  An empty lexicon gives a scorer that answers 0 to everything."""
    known = (lexicon.where("word IS NOT NULL AND word != '' AND score != 0")
             .select("word", (F.col("score") > 0).cast("long").alias("pos")))
    grams = known.select("pos", F.explode(char_grams("word", sizes)).alias("gram")).groupBy("gram").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    grams = checkpointed(grams)
    n_pos, n_neg, v = grams.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0)), F.count("*")).first()
    good, bad = known.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum(1 - F.col("pos")), F.lit(0))).first()
    base = F.log(F.lit((n_neg + v) / (n_pos + v)) if v else F.lit(1.0))
    unseen, prior = lexicon.sparkSession.range(1).select(base, F.log(F.lit((good + 1) / (bad + 1)))).first()
    weight = F.log((F.col("pos") + 1) / (F.col("neg") + 1)) + F.lit(unseen)
    return WordScorer(grams.select("gram", weight.alias("weight")), unseen, prior)


def score_words(words: DataFrame, scorer: WordScorer, sizes: tuple = GRAM_SIZES) -> DataFrame:
    """(word, score): 2p - 1 for each distinct word, p the probability of the positive
    class.  Null and empty words have no row."""
    d = words.where("word IS NOT NULL AND word != ''").select("word").distinct()
    g = d.select("word", F.explode(char_grams("word", sizes)).alias("gram")).groupBy("word", "gram").agg(F.count("*").alias("n"))
    odds = g.join(scorer.grams, "gram", "left").groupBy("word").agg(
        F.sum(F.col("n") * F.coalesce("weight", F.lit(scorer.unseen))).alias("odds"))
    return odds.select("word", (2 * S.sigmoid(F.col("odds") + scorer.prior) - 1).alias("score"))


def complete_lexicon(lexicon: DataFrame, df: DataFrame, tokens: str) -> DataFrame:
    """The lexicon, one row per word (mean of repeats), and a row for each token of
    ``df`` that it lacks, scored once by a model fitted on the lexicon."""
    lex = (lexicon.where("word IS NOT NULL AND score IS NOT NULL").groupBy("word")
           .agg(F.avg("score").alias("score")))
    lex = checkpointed(lex)
    unknown = df.select(F.explode(tokens).alias("word")).distinct().join(lex, "word", "left_anti")
    return lex.unionByName(score_words(unknown, fit_word_scorer(lex)))


def modelled_sentiment(df: DataFrame, id_col: str, tokens: str, lexicon: DataFrame,
                       out: str = "sentiment_score") -> DataFrame:
    """T5 as the study has it: mean over the tokens of the lexicon's score, or of the
    model's for a token that the lexicon lacks; a text without tokens scores 0."""
    return lexicon_sentiment(df, id_col, tokens, complete_lexicon(lexicon, df, tokens), 0.0, out)


# ---------------------------------------------------------------- segmentation

#: longer words are no dictionary words
MAX_WORD = 24
UNIT = 1_000_000
#: characters of the distinct runs that are cut together, with the words found in them
BLOCK = 1 << 18
MAX_TASKS = 4096
#: size limit of the filter of words (16 MB), which only saves work
FILTER_BITS = 1 << 27
_PAGE = 32768
NO_WORD = -(1 << 31)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _part_hashes(codes: np.ndarray, longest: int = MAX_WORD):
    """(n, hash of the n characters from each place on) for n = 1, 2, ... longest."""
    h = np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, min(longest, len(codes)) + 1):
        h = h[:len(codes) - n + 1] * _BASE + codes[n - 1:] + np.uint64(1)
        x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        yield n, x ^ (x >> np.uint64(27))


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of ``bits`` (a power of two)."""
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _word_filter(words: DataFrame) -> bytes:
    """Two bits for each word, in 16 to 32 bits a word up to FILTER_BITS; the driver gets
    FILTER_BITS / 32768 rows of 4 kB at most."""
    bits = min(FILTER_BITS, max(_PAGE, 1 << (16 * words.count()).bit_length()))

    def run(frames):
        for f in frames:
            hashes = np.zeros(len(f), np.uint64)
            for k, word in enumerate(f["word"]):
                for _, h in _part_hashes(_codes(word)):
                    pass
                hashes[k] = h[0]  # of all its characters
            yield pd.DataFrame({"b": np.concatenate(_probes(hashes, bits))})

    pages = words.select("word").mapInPandas(run, "b long").groupBy(F.floor(F.col("b") / _PAGE).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod("b", F.lit(_PAGE)) + 1)).alias("m"))
    out = bytearray(bits // 8)
    for k, m in pages.collect():
        out[k * _PAGE // 8:(k + 1) * _PAGE // 8] = m
    return bytes(out)


def _passed(runs: list, mask: bytes):
    """(number of the first run, sizes, characters, [(n, places, hashes)]) for BLOCK characters or
    one run at a time: the parts of n characters that pass the filter, all dictionary words among them."""
    on, bits, i = np.frombuffer(mask, np.uint8), len(mask) * 8, 0
    while i < len(runs):
        j, size = i + 1, len(runs[i])
        while j < len(runs) and size + len(runs[j]) <= BLOCK:
            size, j = size + len(runs[j]), j + 1
        sizes = np.array([len(r) for r in runs[i:j]], np.int64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(size)  # characters up to the end of the run
        codes, found = _codes("".join(runs[i:j])), []
        for n, h in _part_hashes(codes):
            at = np.flatnonzero(left[:len(h)] >= n)
            a, b = _probes(h[at], bits)
            at = at[(on[a >> 3] >> (a & 7).astype(np.uint8) & on[b >> 3] >> (b & 7).astype(np.uint8) & 1) > 0]
            found.append((n, at, h[at]))
        yield i, sizes, codes, found
        i = j


def _candidates(runs: list, mask: bytes):
    """(run number, start, length) of the parts of ``runs`` that pass the filter."""
    for i, sizes, _, found in _passed(runs, mask):
        run, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        for n, at, _ in found:
            for k, s in zip((i + run[at]).tolist(), (at - start[run[at]]).tolist(), strict=True):
                yield k, s, n


def _unlike(codes: np.ndarray, at: np.ndarray, others: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Whether the n characters from ``at`` are others than those from ``to``, for parts of equal hash."""
    out = np.zeros(len(at), bool)
    for j in range(n):
        out |= codes[at + j] != others[to + j]
    return out


def _distinct_parts(runs: list, mask: bytes) -> list:
    """The different parts of ``runs`` that pass the filter."""
    parts = set()
    for i, sizes, codes, found in _passed(runs, mask):
        text = "".join(runs[i:i + len(sizes)])
        for n, at, h in found:
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            parts.update(text[s:s + n] for s in at[first].tolist())
            parts.update(text[s:s + n] for s in at[_unlike(codes, at, codes, at[first][back], n)].tolist())
    return list(parts)


def _weights(runs_text: str, codes: np.ndarray, found: list, words: dict) -> np.ndarray:
    """(place, n - 1): weight of the word of n characters that begins there, NO_WORD where none does."""
    out = np.full((len(codes), MAX_WORD), NO_WORD, np.int32)
    for n, at, h in found:
        own = words.get(n)
        if own is None:
            continue
        hashes, chars, to, weight, plain = own
        if plain is None:
            p = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[p] == h)
            hit = hit[~_unlike(codes, at[hit], chars, to[p[hit]], n)]
            out[at[hit], n - 1] = weight[p[hit]]
        else:  # two words of one hash
            for s in at.tolist():
                out[s, n - 1] = plain.get(runs_text[s:s + n], NO_WORD)
    return out


def _by_length(words: list, weights: list) -> dict:
    """{n: (hashes in order, characters of all words, where each begins, weights, None or {word: weight})}."""
    size = np.array([len(w) for w in words], np.int64)
    start, codes, weight, out = np.cumsum(size) - size, _codes("".join(words)), np.array(weights, np.int64), {}
    for n, h in _part_hashes(codes):
        own = np.flatnonzero(size == n)
        if len(own):
            own = own[np.argsort(h[start[own]], kind="stable")]
            hashes = h[start[own]]
            plain = {words[k]: weights[k] for k in own.tolist()} if (hashes[1:] == hashes[:-1]).any() else None
            out[n] = hashes, codes, start[own], weight[own], plain
    return out


def _best_steps(sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``best_path`` of all runs beside each other, from their ends on: the length of the word that
    begins at each place."""
    ends, order = np.cumsum(sizes), np.argsort(-sizes, kind="stable")
    runs = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")
    reach = np.arange(MAX_WORD, 0, -1)  # the longest word first, which wins among equals
    best, step = np.zeros(len(weights) + len(sizes) + MAX_WORD, np.int64), np.ones(len(weights), np.int64)
    for d, k in enumerate(runs.tolist(), 1):
        at = ends[order[:k]] - d
        slot = at + order[:k]  # a run has one place more, its end
        w = weights[at][:, ::-1]
        sums = np.where(w == NO_WORD, -(1 << 62), w + best[slot[:, None] + reach])
        top = sums.argmax(axis=1)
        best[slot], step[at] = sums[np.arange(k), top], MAX_WORD - top
    return step


def best_path(n: int, edges: list, unknown: int) -> list:
    """Lengths of the words of the heaviest path over ``n`` characters.  ``edges`` are
    (start, length, weight); every character is also a word of weight ``unknown`` unless
    an edge says otherwise.  Equal weights: the longer word, from the left."""
    at: list = [[] for _ in range(n)]
    for i, size, w in edges:
        at[i].append((size, w))
    best, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        top = None
        for size, w in at[i] if any(s == 1 for s, _ in at[i]) else [(1, unknown), *at[i]]:
            here = (w + best[i + size], size)
            if top is None or here > top:
                top = here
        best[i], step[i] = top
    out, i = [], 0
    while i < n:
        out.append(step[i])
        i += step[i]
    return out


def segment(df: DataFrame, col: str, dictionary: DataFrame, out: str = "words") -> DataFrame:
    """The words of texts written without blanks, by the likeliest path through the
    lattice of dictionary words (word, n); ``out`` is an array in text order.

    A text's blanks are removed, letters lower-cased, and its runs of word characters
    are cut each by itself.  A word weighs floor(10^6 ln(n / total)); a character that
    is no word weighs as one that occurred once.  Equal weights: the longer word first.
    Null text gives null, a text without a run an empty array; repeated rows stay rows of
    their own, an empty dictionary cuts into characters.  Words above MAX_WORD
    characters, null words and counts below 1 are left out of the dictionary.

    Each distinct run is cut once.  The runs are dealt to blocks of about BLOCK characters;
    a block's distinct parts that pass a filter of the words (of a fixed size at most,
    whatever the dictionary's) are joined with the dictionary, and the block is cut with
    the words it met.  So a word travels once to a block, however often it occurs there,
    the dictionary is never collected, and a task holds one block (a longer run is held whole)."""
    words = (dictionary.where(f"word IS NOT NULL AND length(word) BETWEEN 1 AND {MAX_WORD} AND n >= 1")
             .groupBy("word").agg(F.sum("n").alias("n")))
    words = checkpointed(words)
    total = words.agg(F.sum("n")).first()[0] or 1
    weighed = words.select("word", F.floor(UNIT * F.log(F.col("n") / F.lit(float(total)))).cast("long").alias("w"))
    unknown = df.sparkSession.range(1).select(F.floor(UNIT * F.log(F.lit(1 / total))).cast("long")).first()[0]
    mask = df.sparkSession.sparkContext.broadcast(_word_filter(words))

    runs = F.regexp_extract_all(F.lower(F.regexp_replace(F.col(col), S.SPACE + "+", "")), F.lit(S.TOKEN_RE), 0)
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_runs", runs))
    placed = rows.select("_row", F.posexplode("_runs").alias("_pos", "_run"))
    distinct = checkpointed(placed.select("_run").distinct())
    blocks = -(-(distinct.agg(F.sum(F.length("_run"))).first()[0] or 1) // BLOCK)
    # a number of partitions of its own: by its bytes alone, a block's work would look small
    dealt = distinct.withColumn("_block", F.pmod(F.xxhash64("_run"), F.lit(blocks))).repartition(min(blocks, MAX_TASKS), "_block")

    def find(f):
        parts = _distinct_parts(f["_run"].tolist(), mask.value)
        # object: Arrow takes no empty column of pandas' own string type
        return pd.DataFrame({"_block": np.full(len(parts), f["_block"].iloc[0], np.int64), "word": pd.Series(parts, dtype=object)})

    met = dealt.groupBy("_block").applyInPandas(find, "_block long, word string").join(weighed, "word")

    def cut(known, f):
        own, words, cuts = f["_run"].tolist(), _by_length(known["word"].tolist(), known["w"].tolist()), []
        for i, sizes, codes, found in _passed(own, mask.value):
            text = "".join(own[i:i + len(sizes)])
            weights = _weights(text, codes, found, words)
            weights[weights[:, 0] == NO_WORD, 0] = unknown
            step, start = _best_steps(sizes, weights).tolist(), 0
            for end in np.cumsum(sizes).tolist():
                spans = []
                while start < end:
                    spans.append(text[start:start + step[start]])
                    start += step[start]
                cuts.append(spans)
        return pd.DataFrame({"_run": pd.Series(own, dtype=object), "_cut": pd.Series(cuts, dtype=object)})

    done = met.groupBy("_block").cogroup(dealt.groupBy("_block")).applyInPandas(cut, "_run string, _cut array<string>")
    back = placed.join(done, "_run").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_cut"))).alias("_c"))
    back = back.select("_row", F.flatten(F.transform("_c", lambda x: x["_cut"])).alias("_words"))
    empty = F.when(F.col("_runs").isNotNull(), F.array().cast("array<string>"))
    return rows.join(back, "_row", "left").withColumn(out, F.coalesce("_words", empty)).drop("_row", "_runs", "_words")
