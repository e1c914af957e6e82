"""Text analytics.

Every step runs on whole texts.  Token-level work is relational: tokens are
exploded, pre-aggregated per (document, token) — a document lives in one
partition, so the map-side combine already collapses repeats — and only then
joined with dictionaries (stopwords, lexicon, vocabulary); scores of a lexicon
are joined to the tokens of a block of documents.  Dictionaries with
a bound by construction (top-50 stopwords) are broadcast; corpus-derived
ones are left to Catalyst/AQE (broadcast under the size threshold, shuffle
with skew splitting above it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.hashing import hash_int
from ..sources.tables import checkpointed
from .ranking import global_row_number


def clean_text(df: DataFrame, col: str, out: str | None = None, digits: bool = True,
               spaces: bool = False) -> DataFrame:
    """T1."""
    return df.withColumn(out or col, S.strip_punct(F.col(col), digits, spaces))


def tokenize(df: DataFrame, col: str, out: str = "tokens", mode: str = "word", n: int = 2) -> DataFrame:
    """T2 (re-aimed segmentation): lower-cased word tokens, or character
    n-grams of each word for unspaced scripts."""
    words = F.regexp_extract_all(F.lower(F.col(col)), F.lit(S.TOKEN_RE), 0)
    if mode == "word":
        return df.withColumn(out, words)
    grams = F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))),
        lambda i: F.substring(w, i, n))))
    return df.withColumn(out, grams)


def explode_tokens(df: DataFrame, id_col: str, tokens: str, with_pos: bool = False) -> DataFrame:
    if with_pos:
        return df.select(id_col, F.posexplode(tokens).alias("pos", "token"))
    return df.select(id_col, F.explode(tokens).alias("token"))


def token_counts(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, token, n): per-document term counts (bag of words, relational form)."""
    return (explode_tokens(df, id_col, tokens).groupBy(id_col, "token")
              .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def token_blocks(df: DataFrame, id_col: str, tokens: str, most: int | None = None) -> DataFrame:
    """(block, token, ids, ns): ``token_counts`` packed by batches of rows.  A token travels
    once for all texts of its block, which are listed with their counts.  With ``most``, a
    block ends where its texts reach so many tokens."""
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist()] if most else [0]
            for at, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                yield from packed(batch.slice(at, end - at))

    def packed(batch):
        ids, lists = batch.column(1), batch.column(2)
        found = lists.flatten().dictionary_encode(null_encoding="encode")
        if not len(found):
            return
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, n = np.unique(code * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
        ends = pa.array(np.searchsorted(pair // len(ids), np.arange(len(found.dictionary) + 1)).astype(np.int32))
        who = ids.take(pa.array(pair % len(ids)))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(found.dictionary), batch.column(0)[0].as_py(), np.int64)), found.dictionary,
            pa.ListArray.from_arrays(ends, who), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))],
            names=["block", "token", "ids", "ns"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("block"), F.col(id_col).alias("id"), F.col(tokens).alias("tokens"))
    return rows.mapInArrow(run, f"block long, token string, ids array<{kind}>, ns array<int>")


def top_words(df: DataFrame, tokens: str, n: int = 50, letters_only: bool = True) -> DataFrame:
    """The n most frequent tokens (ties by token); ``letters_only``
    keeps tokens made of letters only.  Counting is a partial aggregation;
    the top-n is the feature."""
    t = df.select(F.explode(tokens).alias("token"))
    if letters_only:
        t = t.filter(S.is_alpha(F.col("token")))
    return (t.groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
             .orderBy(F.col("n").desc(), F.col("token")).limit(n))


def stopwords_from_corpus(df: DataFrame, tokens: str, n: int = 50) -> DataFrame:
    """The n most frequent tokens of the corpus, as a stopword table (word)."""
    return top_words(df, tokens, n, letters_only=False).select(F.col("token").alias("word"))


def remove_stopwords(df: DataFrame, tokens: str, words: DataFrame, out: str | None = None) -> DataFrame:
    """Drop stopwords from a token array, keeping order; repeated rows and ids are
    rows of their own, a null array stays null.

    One way at every size: each row gets a number, its tokens are joined with the
    stopwords, and the kept positions come back to the row.  Only numbers,
    positions and tokens are shuffled; the stored numbered rows are read twice."""
    out = out or tokens
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    stop = words.select(F.col("word").alias("_token")).distinct()
    gone = rows.select("_row", F.posexplode(tokens).alias("_pos", "_token")).join(stop, "_token", "left_semi")
    gone = gone.groupBy("_row").agg(F.collect_set("_pos").alias("_gone"))
    met = rows.join(gone, "_row", "left")
    # a set difference of positions: its cost grows with the text, not with text times positions
    places = F.array_except(F.sequence(F.lit(0), F.size(tokens) - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col(tokens)).otherwise(F.transform(places, lambda i: F.get(F.col(tokens), i)))
    return met.withColumn(out, kept).drop("_row", "_gone")


def lexicon_from_corpus(df: DataFrame, tokens: str, min_len: int = 4) -> DataFrame:
    """Deterministic lexicon over the corpus vocabulary: tokens of at least
    ``min_len`` characters scored (first two md5 hex digits − 128) / 128."""
    v = df.select(F.explode(tokens).alias("word")).filter(F.length("word") >= min_len).distinct()
    score = (F.conv(F.substring(F.md5(F.col("word")), 1, 2), 16, 10).cast("int") - 128) / F.lit(128.0)
    return v.select("word", score.alias("score"))


def lexicon_sentiment(df: DataFrame, id_col: str, tokens: str, lexicon: DataFrame,
                      fallback=0.0, out: str = "sentiment_score") -> DataFrame:
    """T5: Σ score(token) / number of tokens; a token missing from the lexicon
    scores ``fallback`` (a number or a Column over ``token``); a text without
    tokens scores 0."""
    fb = fallback if hasattr(fallback, "_jc") else F.lit(float(fallback))
    lex = lexicon.select(F.col("word").alias("token"), "score")
    # what a token of a block scores comes back to the block once, for all of its texts
    met = token_blocks(df, id_col, tokens).join(lex, "token", "left").select(
        "block", F.arrays_zip("ids", "ns").alias("_z"), F.coalesce(F.col("score"), fb).alias("_s")).repartition("block")
    scored = (met.select("_s", F.explode("_z").alias("_z")).groupBy(F.col("_z.ids").alias(id_col))
                 .agg((F.sum(F.col("_s") * F.col("_z.ns")) / F.sum("_z.ns")).alias(out)))
    return (df.select(id_col).join(scored, id_col, "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(0.0))))


def vocabulary(df: DataFrame, tokens: str, base: int = 1) -> DataFrame:
    """(token, id): sorted vocabulary numbered from ``base`` (0 is kept for padding)."""
    v = df.select(F.explode(tokens).alias("token")).distinct()
    r = global_row_number(v, [("token", True)], "_rn")
    return r.select("token", (F.col("_rn") - 1 + base).cast("bigint").alias("id"))


def bag_of_words(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, term_id, n) with term ids from the sorted vocabulary (0-based)."""
    vocab = vocabulary(df, tokens, base=0)
    return token_counts(df, id_col, tokens).join(vocab, "token").select(id_col, F.col("id").alias("term_id"), "n")


def encode_tokens(df: DataFrame, id_col: str, tokens: str, vocab: DataFrame, length: int = 32,
                  out_ids: str = "input_ids", out_mask: str = "attention_mask") -> DataFrame:
    """Token ids (vocabulary ids, 0 = padding) at fixed ``length`` plus
    the mask.  Only positions < length can reach the output, so later
    positions are dropped before the vocabulary join."""
    head = df.select(id_col, F.slice(F.col(tokens), 1, length).alias("_head"))
    pos = explode_tokens(head, id_col, "_head", with_pos=True)
    v = vocab.select("token", F.col("id").alias("_vid"))
    ids = (pos.join(v, "token", "left")
              .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_vid", F.lit(0)).alias("_vid"))))
                                   .alias("_p")))
    ids = ids.select(id_col, F.transform("_p", lambda x: x["_vid"]).alias("_ids"))
    j = df.select(id_col).join(ids, id_col, "left").withColumn(
        "_ids", F.coalesce(F.col("_ids"), F.array().cast("array<bigint>")))
    return j.select(id_col, S.pad_truncate(F.col("_ids"), length).alias(out_ids)).withColumn(
        out_mask, S.mask(F.col(out_ids)))


def topic_mix(df: DataFrame, date_col: str, topic_col: str, topics: list, unit: str = "quarter") -> DataFrame:
    """Rows per (period, topic) with one column per topic, 0 when absent."""
    from .relational import pivot_counts
    p = df.withColumn("period", S.period(F.col(date_col), unit))
    return pivot_counts(p, "period", topic_col, topics)


def sample_pairs_for_review(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """G5 helper used for the side-by-side comparison of two scores."""
    return df.withColumn("_h", hash_int(F.lit(seed), F.col(id_col))).orderBy("_h", id_col).limit(n).drop("_h")
