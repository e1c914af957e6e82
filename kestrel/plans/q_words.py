"""Word models, batch inference and delimited files."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from .. import config as C
from ..operators import models as ML
from ..operators import periods as P
from ..operators import text as T
from ..operators import words as W
from ..operators.splits import chrono_split
from ..session import shared_path
from ..sources import adapters as A
from ..sources.tables import checkpointed, read_delimited, save_model, write_delimited
from .q_encode_metrics import rounded
from .q_text import TOKS, tokenized
from .registry import query
from .sql import TEXTS, with_


def _labelled_lexicon(spark, sf, tok):
    """(word, score): share of good minus share of bad among a word's occurrences in
    labelled texts.  Words of other texts only are the unknown ones."""
    lab = A.labelled_titles(spark, sf).where("viral IS NOT NULL").select("post_id", "viral")
    # tokens hold no blanks: one string takes less of a shuffle than an array of them
    text = tok.select("post_id", F.array_join("tokens", " ").alias("_t")).join(lab, "post_id")
    rows = text.select("viral", F.explode(F.split("_t", " ")).alias("word")).where("word != ''")
    return rows.groupBy("word").agg((2 * F.avg("viral") - 1).alias("score"))


def _grams_sql(cols: str, word: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {cols}, unnest(list_transform(range(1, length({word}) - {n} + 2), lambda i: substr({word}, i, {n}))) AS gram FROM {source}"
        for n in W.GRAM_SIZES)


MODEL = TOKS + f""",
llex AS (SELECT token AS word, 2 * avg(l.quality) - 1 AS score FROM tok_rows r JOIN labels l ON r.post_id = l.doc_id
  WHERE l.quality IS NOT NULL GROUP BY token),
known AS (SELECT '<' || word || '>' AS w, CAST(score > 0 AS BIGINT) AS pos FROM llex WHERE score != 0),
kg AS ({_grams_sql("pos", "w", "known")}),
grams AS (SELECT gram, sum(pos) AS pos, sum(1 - pos) AS neg FROM kg GROUP BY gram),
tot AS (SELECT coalesce(sum(pos), 0) AS np, coalesce(sum(neg), 0) AS nn, count(*) AS v FROM grams),
cls AS (SELECT coalesce(sum(pos), 0) AS good, coalesce(sum(1 - pos), 0) AS bad FROM known),
unk AS (SELECT DISTINCT token AS word, '<' || token || '>' AS w FROM tok_rows WHERE token NOT IN (SELECT word FROM llex)),
ug AS ({_grams_sql("word", "w", "unk")}),
odds AS (SELECT word, sum(ln((coalesce(g.pos, 0) + 1) / (coalesce(g.neg, 0) + 1) * ((nn + v) / (np + v)))) AS o
  FROM ug LEFT JOIN grams g ON ug.gram = g.gram, tot GROUP BY word),
scored_words AS (SELECT word, 2 / (1 + exp(-(o + ln((good + 1) / (bad + 1))))) - 1 AS score FROM odds, cls)"""


@query("unknown_word_scores", with_(MODEL) + "SELECT word, round(score, 6) AS score FROM scored_words")
def unknown_word_scores(spark, sf):
    """Each token that no labelled text holds, scored once by its characters."""
    t = tokenized(spark, sf, reused=True)
    lex = _labelled_lexicon(spark, sf, t)
    full = W.complete_lexicon(lex, t, "tokens")
    return rounded(full.join(lex, "word", "left_anti").select("word", "score"))


@query("modelled_sentiment", with_(MODEL) + """, full_lex AS (
  SELECT word, score FROM llex UNION ALL SELECT word, score FROM scored_words),
s AS (SELECT r.post_id, sum(coalesce(l.score, 0.0)) / count(*) AS v FROM tok_rows r
  LEFT JOIN full_lex l ON r.token = l.word GROUP BY r.post_id)
SELECT t.post_id, round(coalesce(s.v, 0.0), 6) AS sentiment_score FROM toks t LEFT JOIN s ON t.post_id = s.post_id""")
def modelled_sentiment(spark, sf):
    """T5: lexicon scores, unknown words by the fitted model."""
    t = tokenized(spark, sf, reused=True)
    return rounded(W.modelled_sentiment(t, "post_id", "tokens", _labelled_lexicon(spark, sf, t)))


@query("segment_texts")
def segment_texts(spark, sf):
    """Whole texts without their blanks, cut by the words of the corpus."""
    t = A.titles(spark, sf).select("post_id", "item_title")
    tok = T.tokenize(t, "item_title")
    words = tok.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    s = W.segment(t, "item_title", words)
    return s.select("post_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("words_joined"))


DIM, LENGTH = 8, 32


@query("embed_batches", with_(TOKS) + """, vocab AS (
  SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT token FROM tok_rows)),
places AS (SELECT t.post_id, p.pos FROM toks t, range(0, 32) p(pos)),
ids AS (SELECT p.post_id, p.pos, coalesce(v.id, 0) AS id FROM places p
  LEFT JOIN tok_rows r ON r.post_id = p.post_id AND r.pos = p.pos + 1 LEFT JOIN vocab v ON r.token = v.token)
SELECT post_id, """ + ", ".join(
    f"round(avg(((31 * id + 17 * pos + 1) * {2 * d + 1} % 1009) / CAST(1009 AS DOUBLE)), 6) AS e{d}" for d in range(DIM))
    + " FROM ids GROUP BY post_id")
def embed_batches(spark, sf):
    """Token ids through ``predict_batch_udf``, mean over all 32 positions."""
    t = tokenized(spark, sf, reused=True)
    ids = T.encode_tokens(t, "post_id", "tokens", T.vocabulary(t, "tokens", 1), LENGTH)
    e = ML.embed_tokens(ids, "input_ids", ML.hashed_encoder(DIM), LENGTH)
    return rounded(e.select("post_id", *[F.col("embedding")[d].alias(f"e{d}") for d in range(DIM)]))


@query("delimited_round_trip", with_(TEXTS) + "SELECT post_id, item_title, article_source, CAST(NULL AS VARCHAR) AS malformed FROM texts")
def delimited_round_trip(spark, sf):
    """Whole texts, with their separators, quotes and line breaks, written as
    delimited files and read back."""
    path = shared_path(spark, f"delimited-{uuid.uuid4().hex}")
    write_delimited(A.titles(spark, sf).select("post_id", "item_title", "article_source"), path, ",", max_records=100_000)
    return read_delimited(spark, path, "post_id long, item_title string, article_source string", ",", malformed="malformed")


@query("classify_periods")
def classify_periods(spark, sf):
    """A classifier of the label fitted on the labelled texts of the first period and
    stored; each later period is read, embedded, classified and written by itself."""
    t = chrono_split(A.texts(spark, sf).select("post_id", "item_title", "viral", "year_month"), "year_month", C.SPLITS)
    t = checkpointed(T.tokenize(t, "item_title").select("post_id", "viral", "split", "tokens"))
    ids = T.encode_tokens(t, "post_id", "tokens", T.vocabulary(t, "tokens", 1), LENGTH)
    posts = checkpointed(ids.join(t.select("post_id", "viral", "split"), "post_id"))
    encoder, path = ML.hashed_encoder(DIM), shared_path(spark, f"periods-{uuid.uuid4().hex}")
    train = P.embedded(posts.where("split = 'train' AND viral IS NOT NULL").withColumn("label", F.col("viral").cast("double")),
                       "input_ids", encoder, LENGTH)
    model = ML.fit_topic_classifier(checkpointed(train.select("features", "label")), "features", "label", DIM, 2, hidden=(16,), max_iter=20)
    save_model(PipelineModel(stages=[model]), f"{path}/model")
    for period in [name for name, _, _ in C.SPLITS if name != "train"]:
        P.classify_period(spark, posts, "post_id", "split", period, "input_ids", encoder, LENGTH, f"{path}/model", f"{path}/topics")
    return P.read_periods(spark, f"{path}/topics")
