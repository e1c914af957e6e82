"""Operator 8, quality classifier from weak labels.

Eight overlapping heuristic labellers vote good, bad or abstain on every
document.  Expectation-maximisation over the vote patterns (at most 2**8 = 256
rows, counted over the whole corpus) estimates each labeller's accuracy without any
gold label; the posteriors of a bounded sample of documents
(FIT_LIMIT rows, smallest hashes) train a hashed linear scorer, which scores
every whole text.  A document is kept when its score is at least THRESHOLD.

Defined cases: null or empty text has no words (every labeller abstains) and
is scored by the model's intercept; repeated
rows are judged row by row; an empty table gives no rows; if the label
model sees one class only, the score is the posterior; input
columns named like the outputs are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, private, read, word_array

FIT_LIMIT = 12_000   # rows of the training sample
FEATURES = 1 << 15
THRESHOLD = 0.33  # a document goes only when it leans clearly to bad
GOOD, BAD, ABSTAIN = "g", "b", "-"
N_LABELLERS = 8
BALANCE = 0.5          # class prior of the label model
START_ACCURACY = 0.9   # prior accuracy of a labeller
PRIOR_SHARE = 0.05     # weight of that prior, as a share of the labeller's votes


def votes(text: Column, words: Column) -> Column:
    """The votes of all labellers as one string: bad for symbols, shouting,
    stutter, repeated lines, line ends, word length, few distinct words; good
    for what reads like prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.size(words)
    chars = F.length(F.array_join(words, ""))
    share = lambda test: F.size(F.filter(words, test))
    # whole-text counts are cheaper than a test per word
    marked = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    shouts = F.floor((F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2)
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    loud = F.greatest(shouts, F.floor(capitals / 5))
    stutter = share(lambda w, i: w == F.get(words, i - 1))
    kinds = F.size(F.array_distinct(words))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ended = lambda x: F.size(F.filter(x, lambda s: s.rlike(r"[.!?][\x20\x09-\x0D]*$")))
    some = n > 0

    bad = lambda test: F.when(some & test, BAD).otherwise(ABSTAIN)
    counts = F.struct(marked.alias("m"), loud.alias("l"), stutter.alias("s"), kinds.alias("k"), chars.alias("c"),
                      let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"),
                                                    ended(x).alias("ended"))).alias("x"))

    def cast(v):
        m, l, s, k, c, x = (v[f] for f in ("m", "l", "s", "k", "c", "x"))
        prose = ((n >= 20) & (m * 20 <= n) & (l * 10 <= n) & (s * 20 <= n) & (c >= 3.5 * n) & (c <= 10 * n)
                 & (x["ended"] * 2 > x["n"]) & (x["kinds"] * 10 > x["n"] * 9))
        return F.concat(
            bad(m * 5 > n), bad(l * 5 > n), bad(s * 10 > n), bad((x["n"] - x["kinds"]) * 3 > x["n"]),
            bad((n >= 20) & (x["ended"] * 3 < x["n"])), bad((c < 2 * n) | (c > 14 * n)),
            bad((n >= 50) & (k * 4 < n)), F.when(prose, GOOD).otherwise(ABSTAIN))

    return let(counts, cast)


def fit_label_model(patterns: dict[str, int], balance: float = BALANCE, rounds: int = 200, tol: float = 1e-9) -> dict:
    """EM for two classes and labellers that err independently when they vote.

    patterns: votes -> documents.  An abstention tells nothing.  balance is the
    class prior P(good); each accuracy has a Beta prior around START_ACCURACY
    worth PRIOR_SHARE of its labeller's votes.  Returns accuracy (per labeller:
    probability that a vote is right) and posterior (votes -> P(good)).
    """
    m = len(next(iter(patterns), "")) or N_LABELLERS
    accuracy = [START_ACCURACY] * m
    cast = [sum(c for p, c in patterns.items() if p[k] != ABSTAIN) for k in range(m)]
    post: dict[str, float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(balance / (1 - balance))
            for a, v in zip(accuracy, p, strict=True):
                odds += 0.0 if v == ABSTAIN else math.log(a / (1 - a)) * (1 if v == GOOD else -1)
            post[p] = 1 / (1 + math.exp(-odds))
        new = []
        for k in range(m):
            right = sum(c * (post[p] if p[k] == GOOD else 1 - post[p]) for p, c in patterns.items() if p[k] != ABSTAIN)
            prior = 1 + PRIOR_SHARE * cast[k]
            new.append(min((right + prior * START_ACCURACY) / (cast[k] + prior), 1 - 1e-6))
        moved = max(abs(a - b) for a, b in zip(accuracy, new, strict=True))
        accuracy = new
        if moved < tol:
            break
    return {"accuracy": accuracy, "posterior": post}


def _features(df: DataFrame, words: str, out: str, tf: str) -> DataFrame:
    """Hashed words, present or not, scaled to length 1 whatever the text's length."""
    df = HashingTF(inputCol=words, outputCol=tf, numFeatures=FEATURES, binary=True).transform(df)
    return Normalizer(inputCol=tf, outputCol=out, p=2.0).transform(df)


def classify_quality(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD,
                     fit_limit: int = FIT_LIMIT, seed: str = "weak-1") -> DataFrame:
    """df with votes, posterior (label model), score (linear scorer), kept."""
    df = df.drop(*[c for c in ("votes", "posterior", "score", "kept") if c not in (text_col, id_col)])
    w, x, tf, raw, prob, pred = private(df, "words", "x", "tf", "raw_score", "prob", "pred")
    text = F.col(f"`{text_col}`").cast("string")
    def read_text(t):
        """(words, votes) of a text, as a one-row generator: evaluated once, whatever filters follow."""
        return F.inline(F.array(let(word_array(t), lambda v: F.struct(v.alias(w), votes(t, v).alias("votes")))))

    d = df.select("*", read_text(text))
    # pass 1: vote patterns (256 rows at most) and the sample's ids
    patterns = {r["votes"]: r["n"] for r in d.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_label_model(patterns)
    pairs = [F.lit(v) for p, q in model["posterior"].items() for v in (p, float(q))]
    posterior = F.try_element_at(F.create_map(*pairs), F.col("votes")) if pairs else F.lit(None).cast("double")
    d = d.withColumn("posterior", posterior)
    ident = F.concat_ws("|", F.lit(seed), F.col(f"`{id_col}`").cast("string"))
    sample = df.select(F.xxhash64(ident).alias("h"), text.alias("t")).orderBy("h", F.xxhash64("t")).limit(fit_limit)
    sample = sample.repartition(16).select(read_text(F.col("t"))).withColumn("posterior", posterior)
    # where every labeller abstains there is nothing to learn from
    sample = sample.where(F.col("votes") != ABSTAIN * N_LABELLERS)
    sample = materialize(sample.select(w, "posterior"), "weak-sample")
    both = _features(sample, w, "x", tf).select("x", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))).alias("y"))
    both = materialize(both.select("x", "y.label", "y.weight").where("weight > 0"), "weak-train")
    mass = {r["label"]: r["w"] for r in both.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    if min(mass.get(0.0, 0.0), mass.get(1.0, 0.0)) < 1e-6:  # one class only: the posterior is all there is
        return d.withColumn("score", F.col("posterior")).withColumn("kept", F.col("score") >= threshold).drop(w)
    scorer = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=40, regParam=0.0002,
                                standardization=False, rawPredictionCol=raw, probabilityCol=prob,
                                predictionCol=pred).fit(both)
    d = _features(d, w, x, tf)
    d = scorer.setFeaturesCol(x).transform(d).withColumn("score", F.get(vector_to_array(prob), F.lit(1)))
    return d.withColumn("kept", F.col("score") >= threshold).drop(w, x, tf, raw, prob, pred)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents")).select("doc_id", "votes", "posterior", "score", "kept")
