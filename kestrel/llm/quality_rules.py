"""Operator 4, quality rules (DataFrame functions only).

Words and word pairs are hashed into BINS cells.  Two smoothed multinomials are
counted over the cells: the raw corpus (every document) and the trusted target
(documents labelled good).  A document's score is the mean over its n-grams of
log(target share / raw share); the verdict is a fixed threshold on that score
after the base rules (too few words, too many words in repeated windows).

The cell table has BINS entries whatever the corpus, so it travels as one array
constant.  The trusted sample is bounded by TRUSTED_LIMIT labelled ids
(smallest hashes), which bounds its broadcast; the raw counts cover everything.

Defined cases: null text has no words (base_failed); a document without
n-grams scores 0; without trusted documents both multinomials agree and only
the base rules decide; an empty table gives no rows; repeated ids are judged
row by row; columns named like the outputs are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, private, read, word_array

BINS = 1 << 16
TRUSTED_LIMIT = 20_000
THRESHOLD = -0.27  # mean log ratio below which a document goes
SMOOTHING = 1.0   # added to each cell of the target, in raw proportion
MIN_WORDS = 10
MAX_REPEATED_PCT = 20
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_bins(hashes: Column, bins: int = BINS) -> Column:
    """Cells of all words (lower half of the table), then of all neighbouring
    pairs (upper half): pairs, whose number grows with the corpus, don't blur words."""
    half = bins // 2
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(half)).cast("int"))
    two = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
                      lambda h, i: (F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(half)) + half).cast("int"))
    return F.concat(one, two)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by WINDOW-word windows that occur at least twice in the text."""
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
                          lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))

    def cover(h):
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def flagged(r):
            pos = F.transform(r, lambda x, k: F.when((x["h"] == F.get(r, k - 1)["h"]) | (x["h"] == F.get(r, k + 1)["h"]), x["i"]))
            return F.array_sort(F.filter(pos, lambda p: p.isNotNull()))
        starts = let(ranked, flagged)
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end"))
        total = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)

    return let(windows, cover)


def base_features(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    """The base counts (long) of one text, its words and their hashes."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": _repeat_words(hashes).cast("long"),
    }


def log_ratios(df: DataFrame, trusted: DataFrame, text_col: str, id_col: str, bins: int = BINS) -> list[float]:
    """Log ratio (target share over raw share) of every cell.

    The target is smoothed with SMOOTHING * bins counts spread like the raw
    corpus, so an unseen cell leans to 0 and the log stays finite.  The driver
    gets one (cell, raw, good) row per cell: bounded by `bins`.
    """
    tid, flag, g, ident = private(df, "tid", "flag", "g", "ident")
    ids = F.broadcast(trusted.select(F.col("doc_id").alias(tid), F.lit(1).alias(flag)))
    src = df.select(F.col(f"`{id_col}`").alias(ident), let(word_hashes(word_array(F.col(f"`{text_col}`").cast("string"))), lambda h: gram_bins(h, bins)).alias(g))
    src = src.join(ids, F.col(ident) == F.col(tid), "left")
    grams = src.select(F.coalesce(F.col(flag), F.lit(0)).alias("t"), F.explode_outer(g).alias("b"))
    rows = grams.where("b is not null").groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good")).collect()
    raw, good = [0] * bins, [0] * bins
    for b, r, g in rows:
        raw[b], good[b] = r, g
    raw_all, good_all, prior = sum(raw), sum(good), SMOOTHING * bins
    out = []
    for r, g in zip(raw, good, strict=True):
        q = (r + 1.0) / (raw_all + bins)
        out.append(math.log((g + prior * q) / (good_all + prior) / q))
    return out


def _literal(values: list[float]) -> Column:
    """values (to 6 decimals) as one constant array: a string literal that the
    optimiser folds, so the table travels with the plan and joins nothing."""
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """At most `limit` distinct ids labelled good and not toxic (smallest hashes)."""
    good = labels.where((F.col("quality") == 1) & F.coalesce(F.col("toxic") != 1, F.lit(True)) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def judge_quality(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  threshold: float = THRESHOLD, bins: int = BINS) -> DataFrame:
    """df with the base counts, base_failed, score and kept."""
    new = [*BASE, "base_failed", "score", "kept"]
    df = df.drop(*[c for c in new if c not in (text_col, id_col)])
    table = _literal(log_ratios(df, trusted_ids(labels), text_col, id_col, bins))
    text = F.col(f"`{text_col}`").cast("string")

    def features(words, hashes):
        total = F.aggregate(gram_bins(hashes, bins), F.lit(0.0), lambda a, b: a + F.get(table, b))
        grams = F.greatest(2 * F.size(words) - 1, F.lit(0))
        score = F.when(grams > 0, total / grams).otherwise(0.0)
        return F.struct(*[c.alias(n) for n, c in base_features(text, words, hashes).items()], score.alias("score"))

    each = let(word_array(text), lambda w: let(word_hashes(w), lambda h: features(w, h)))
    # a one-row generator: filters on its columns stay above it, so the texts are split and hashed once
    d = df.select("*", F.inline(F.array(each)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return d.select("doc_id", *BASE, "base_failed", "kept", "score")
