"""Text analytics and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as Rel
from ..operators import text as T
from ..sources import adapters as A
from ..sources.tables import checkpointed, parse_lexicon, table
from .q_encode_metrics import rounded
from .registry import query
from .sql import POSTS, TEXTS, h, with_

TOK = r"[\p{L}\p{N}_]+"


def tokenized(spark, sf, reused: bool = False):
    """Token arrays of the whole texts; ``reused`` materialises them once in
    the shared checkpoint folder when a query derives several tables
    (stopwords, lexicon, vocabulary) from them."""
    t = T.tokenize(A.titles(spark, sf).select("post_id", "item_title"), "item_title").select("post_id", "tokens")
    return checkpointed(t) if reused else t


def token_lists(spark, sf):
    """Tokens of the raw and of the cleaned texts in one reading, stored once."""
    t = T.tokenize(A.titles(spark, sf).select("post_id", "item_title"), "item_title")
    t = T.tokenize(T.clean_text(t, "item_title", "clean"), "clean", "ctoks")
    return checkpointed(t.select("post_id", "tokens", "ctoks"))


def _stopwords(tok):
    return T.stopwords_from_corpus(tok, "tokens", 50)


TOKS = TEXTS + f""",
toks AS (SELECT post_id, regexp_extract_all(lower(item_title), '{TOK}') AS toks FROM texts),
tok_rows AS (SELECT post_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM toks),
sw AS (SELECT token AS word FROM tok_rows GROUP BY token ORDER BY count(*) DESC, token LIMIT 50),
lex AS (SELECT DISTINCT token AS word,
  (CAST(('0x' || substr(md5(token), 1, 2)) AS INTEGER) - 128) / 128.0 AS score
  FROM tok_rows WHERE length(token) >= 4)"""

CLEAN_SQL = (r"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\n\f\r\x0B]+', ' ', 'g'), "
             r"'[^\p{{L}}\p{{N}}_ \t\n\f\r\x0B]', '', 'g'), '\p{{Nd}}+', '', 'g')")


@query("clean_text", with_(TEXTS) + f"SELECT post_id, {CLEAN_SQL.format(x='item_title')} AS clean_title FROM texts")
def clean_text(spark, sf):
    t = A.titles(spark, sf).select("post_id", "item_title")
    return T.clean_text(t, "item_title", "clean_title").select("post_id", "clean_title")


@query("tokenize", with_(TOKS) + """SELECT post_id, CAST(len(toks) AS BIGINT) AS n_tokens,
  array_to_string(toks, ' ') AS tokens_joined FROM toks""")
def tokenize_q(spark, sf):
    t = tokenized(spark, sf)
    return t.select("post_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    S.join_tokens("tokens").alias("tokens_joined"))


@query("top_words", with_(TOKS) + r"""SELECT token, CAST(count(*) AS BIGINT) AS n FROM tok_rows
WHERE regexp_full_match(token, '\p{L}+') GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def top_words_q(spark, sf):
    return T.top_words(tokenized(spark, sf), "tokens", 50)


@query("remove_stopwords", with_(TOKS) + """, kept AS (
  SELECT post_id, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS s FROM tok_rows
  WHERE token NOT IN (SELECT word FROM sw) GROUP BY post_id)
SELECT t.post_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_kept, coalesce(k.s, '') AS kept_joined
FROM toks t LEFT JOIN kept k ON t.post_id = k.post_id""")
def remove_stopwords_q(spark, sf):
    t = tokenized(spark, sf, reused=True)
    r = T.remove_stopwords(t, "tokens", _stopwords(t), out="kept")
    return r.select("post_id", F.size("kept").cast("bigint").alias("n_kept"),
                    S.join_tokens("kept").alias("kept_joined"))


@query("lexicon_sentiment", with_(TOKS) + """, s AS (
  SELECT r.post_id, sum(coalesce(l.score, 0.0)) / count(*) AS v FROM tok_rows r
  LEFT JOIN lex l ON r.token = l.word GROUP BY r.post_id)
SELECT t.post_id, round(coalesce(s.v, 0.0), 6) AS sentiment_score FROM toks t LEFT JOIN s ON t.post_id = s.post_id""")
def lexicon_sentiment_q(spark, sf):
    t = tokenized(spark, sf, reused=True)
    lex = T.lexicon_from_corpus(t, "tokens", 4)
    return rounded(T.lexicon_sentiment(t, "post_id", "tokens", lex, 0.0))


@query("lexicon_sentiment_clean", with_(TOKS) + f""", ctoks AS (
  SELECT post_id, regexp_extract_all(lower({CLEAN_SQL.format(x='item_title')}), '{TOK}') AS toks FROM texts),
crow AS (SELECT post_id, unnest(toks) AS token FROM ctoks),
s AS (SELECT r.post_id, sum(coalesce(l.score, 0.0)) / count(*) AS v FROM crow r
  LEFT JOIN lex l ON r.token = l.word WHERE r.token NOT IN (SELECT word FROM sw) GROUP BY r.post_id)
SELECT t.post_id, round(coalesce(s.v, 0.0), 6) AS drop_sentiment_score FROM ctoks t LEFT JOIN s ON t.post_id = s.post_id""")
def lexicon_sentiment_clean_q(spark, sf):
    t = token_lists(spark, sf)
    sw, lex = _stopwords(t), T.lexicon_from_corpus(t, "tokens", 4)
    c = checkpointed(T.remove_stopwords(t.select("post_id", "ctoks"), "ctoks", sw, out="ctoks"))  # read twice
    return rounded(T.lexicon_sentiment(c, "post_id", "ctoks", lex, 0.0, out="drop_sentiment_score"))


@query("sentiment_comparison", with_(TOKS) + f""", ctoks AS (
  SELECT post_id, regexp_extract_all(lower({CLEAN_SQL.format(x='item_title')}), '{TOK}') AS toks FROM texts),
crow AS (SELECT post_id, unnest(toks) AS token FROM ctoks),
a AS (SELECT r.post_id, sum(coalesce(l.score, 0.0)) / count(*) AS v FROM tok_rows r LEFT JOIN lex l ON r.token = l.word GROUP BY r.post_id),
b AS (SELECT r.post_id, sum(coalesce(l.score, 0.0)) / count(*) AS v FROM crow r
  LEFT JOIN lex l ON r.token = l.word WHERE r.token NOT IN (SELECT word FROM sw) GROUP BY r.post_id)
SELECT t.post_id, round(coalesce(a.v, 0.0), 6) AS sentiment_score, round(coalesce(b.v, 0.0), 6) AS drop_sentiment_score
FROM toks t LEFT JOIN a ON t.post_id = a.post_id LEFT JOIN b ON t.post_id = b.post_id
ORDER BY {h("'5|' || CAST(t.post_id AS VARCHAR)")}, t.post_id LIMIT 20""")
def sentiment_comparison(spark, sf):
    """Both scores side by side for 20 texts drawn for review."""
    t = token_lists(spark, sf)
    sw, lex = _stopwords(t), T.lexicon_from_corpus(t, "tokens", 4)
    c = T.remove_stopwords(t, "ctoks", sw, out="ctoks")
    few, lex = checkpointed(T.sample_pairs_for_review(c, 20, 5, "post_id")), checkpointed(lex)  # both scores read them
    raw = T.lexicon_sentiment(few, "post_id", "tokens", lex, 0.0)
    return rounded(raw.join(T.lexicon_sentiment(few, "post_id", "ctoks", lex, 0.0, out="drop_sentiment_score"), "post_id"))


@query("bag_of_words", with_(TOKS) + """, vocab AS (
  SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_id FROM (SELECT DISTINCT token FROM tok_rows))
SELECT r.post_id, CAST(v.term_id AS BIGINT) AS term_id, CAST(count(*) AS BIGINT) AS n
FROM tok_rows r JOIN vocab v ON r.token = v.token GROUP BY r.post_id, v.term_id""")
def bag_of_words_q(spark, sf):
    return T.bag_of_words(tokenized(spark, sf, reused=True), "post_id", "tokens")


@query("encode_tokens", with_(TOKS) + """, vocab AS (
  SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT token FROM tok_rows)),
ids AS (SELECT r.post_id, list(v.id ORDER BY r.pos) AS ids FROM tok_rows r JOIN vocab v ON r.token = v.token
  WHERE r.pos <= 32 GROUP BY r.post_id),
full_ids AS (SELECT t.post_id, list_concat(coalesce(i.ids, []), list_transform(range(32 - len(coalesce(i.ids, []))), lambda x: 0)) AS l
  FROM toks t LEFT JOIN ids i ON t.post_id = i.post_id)
SELECT post_id, array_to_string(l, ',') AS input_ids,
  array_to_string(list_transform(l, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), ',') AS attention_mask FROM full_ids""")
def encode_tokens_q(spark, sf):
    t = tokenized(spark, sf, reused=True)
    e = T.encode_tokens(t, "post_id", "tokens", T.vocabulary(t, "tokens", 1), 32)
    return e.select("post_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("input_ids"),
                    F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), ",").alias("attention_mask"))


@query("punct_flags", with_(TEXTS) + """SELECT post_id, CAST(contains(item_title, '!') AS INTEGER) AS exclamation_mark,
  CAST(contains(item_title, '?') AS INTEGER) AS question_mark, CAST(contains(item_title, ':') AS INTEGER) AS colon_mark
FROM texts""")
def punct_flags(spark, sf):
    t = A.titles(spark, sf).select("post_id", "item_title")
    return Rel.flag_contains(t, "item_title", {"exclamation_mark": "!", "question_mark": "?",
                                               "colon_mark": ":"}).drop("item_title")


@query("punct_totals", with_(TEXTS) + """SELECT CAST(sum(CAST(contains(item_title, '!') AS INTEGER)) AS BIGINT) AS exclamation_count,
  CAST(sum(CAST(contains(item_title, '?') AS INTEGER)) AS BIGINT) AS question_count,
  CAST(sum(CAST(contains(item_title, ':') AS INTEGER)) AS BIGINT) AS colon_count FROM texts""")
def punct_totals(spark, sf):
    f = punct_flags(spark, sf)
    return f.agg(F.sum("exclamation_mark").cast("bigint").alias("exclamation_count"),
                 F.sum("question_mark").cast("bigint").alias("question_count"),
                 F.sum("colon_mark").cast("bigint").alias("colon_count"))


@query("topic_mix_by_period", with_(POSTS) + """SELECT CAST(year AS VARCHAR) || 'Q' || CAST(quarter(year_month) AS VARCHAR) AS period,
  CAST(sum(CAST(topic = 0 AS INTEGER)) AS BIGINT) AS topic_0, CAST(sum(CAST(topic = 1 AS INTEGER)) AS BIGINT) AS topic_1,
  CAST(sum(CAST(topic = 2 AS INTEGER)) AS BIGINT) AS topic_2 FROM posts GROUP BY 1""")
def topic_mix_by_period(spark, sf):
    from ..operators.splits import union_all
    p = A.posts_base(spark, sf).select("year_month", "topic")
    # periods classified separately are combined first (G1), then pivoted
    early = p.filter(F.col("year_month") < F.lit("2000-01-01").cast("date"))
    late = p.filter(F.col("year_month") >= F.lit("2000-01-01").cast("date"))
    m = T.topic_mix(union_all([early, late]), "year_month", "topic", [0, 1, 2])
    return m.select("period", *[F.col(str(k)).alias(f"topic_{k}") for k in (0, 1, 2)])


@query("histogram", """WITH b AS (SELECT CAST(least(floor((l_discount + 1.0) / 0.01), 199) AS INTEGER) AS bin, count(*) AS n
  FROM lineitem WHERE l_discount BETWEEN -1.0 AND 1.0 GROUP BY 1)
SELECT r.bin, round(CAST(-1.0 AS DOUBLE) + r.bin * CAST(0.01 AS DOUBLE), 6) AS lo,
  round(CAST(-1.0 AS DOUBLE) + (r.bin + 1) * CAST(0.01 AS DOUBLE), 6) AS hi,
  CAST(coalesce(b.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(200)) r LEFT JOIN b ON r.bin = b.bin""")
def histogram_q(spark, sf):
    li = table(spark, sf, "lineitem", ["l_discount"])
    return rounded(Rel.histogram(li, "l_discount", -1.0, 1.0, 200))


# ---------------------------------------------------------------- topic strings

def _topic_text_spark(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    d = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    s = F.concat(F.lit("[("), (F.col("o_custkey") % 3).cast("string"), F.lit(", 0."), d, F.lit("), ("),
                 ((F.col("o_custkey") + 1) % 3).cast("string"), F.lit(", 1e-05), ("),
                 ((F.col("o_custkey") + 2) % 3).cast("string"), F.lit(", 0."), d, F.lit(")]"))
    return o.select(F.col("o_orderkey").alias("post_id"), s.alias("topics_text"))


_TOPIC_TEXT_SQL = """tt AS (SELECT o_orderkey AS post_id, '[(' || CAST(o_custkey % 3 AS VARCHAR) || ', 0.'
  || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '), (' || CAST((o_custkey + 1) % 3 AS VARCHAR)
  || ', 1e-05), (' || CAST((o_custkey + 2) % 3 AS VARCHAR) || ', 0.'
  || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || ')]' AS topics_text FROM orders),
tp AS (SELECT post_id, unnest(regexp_extract_all(topics_text, '\\(\\s*(\\d+)\\s*,\\s*([-+0-9.eE]+)\\s*\\)', 1)) AS t,
  unnest(regexp_extract_all(topics_text, '\\(\\s*(\\d+)\\s*,\\s*([-+0-9.eE]+)\\s*\\)', 2)) AS p,
  generate_subscripts(regexp_extract_all(topics_text, '\\(\\s*(\\d+)\\s*,\\s*([-+0-9.eE]+)\\s*\\)', 1), 1) AS i FROM tt),
tcols AS (SELECT post_id, sum(CASE WHEN CAST(t AS INTEGER) = 0 THEN CAST(p AS DOUBLE) ELSE 0.0 END) AS topic_0,
  sum(CASE WHEN CAST(t AS INTEGER) = 1 THEN CAST(p AS DOUBLE) ELSE 0.0 END) AS topic_1,
  sum(CASE WHEN CAST(t AS INTEGER) = 2 THEN CAST(p AS DOUBLE) ELSE 0.0 END) AS topic_2,
  arg_min(CAST(t AS INTEGER), (-CAST(p AS DOUBLE), i)) AS best FROM tp GROUP BY post_id)"""


def parsed_topics(spark, sf):
    t = _topic_text_spark(spark, sf).withColumn("topics", S.parse_topics("topics_text"))
    return t.select("post_id", "topics", *[S.topic_prob("topics", k).alias(f"topic_{k}") for k in (0, 1, 2)])


@query("parse_topics", "WITH " + _TOPIC_TEXT_SQL + """
SELECT post_id, round(topic_0, 6) AS topic_0, round(topic_1, 6) AS topic_1, round(topic_2, 6) AS topic_2,
  CAST(best AS INTEGER) AS dominant_topic FROM tcols""")
def parse_topics_q(spark, sf):
    t = parsed_topics(spark, sf)
    return rounded(t.select("post_id", "topic_0", "topic_1", "topic_2",
                            S.best_topic("topics").alias("dominant_topic")))


@query("dominant_topic_cols", "WITH " + _TOPIC_TEXT_SQL + """
SELECT post_id, CAST(CASE WHEN topic_0 >= topic_1 AND topic_0 >= topic_2 THEN 0
  WHEN topic_1 >= topic_2 THEN 1 ELSE 2 END AS INTEGER) AS dominant_topic FROM tcols""")
def dominant_topic_cols(spark, sf):
    from ..operators.ranking import dominant_topic
    t = parsed_topics(spark, sf)
    return dominant_topic(t, ["topic_0", "topic_1", "topic_2"]).select("post_id", "dominant_topic")


# ---------------------------------------------------------------- scalar functions


@query("log_clip", """SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN greatest(log10(c_acctbal), 0.0)
  WHEN c_acctbal = 0 THEN 0.0 END, 6) AS acctbal_log FROM customer""")
def log_clip_q(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    return rounded(c.select("c_custkey", S.log_clip("c_acctbal").alias("acctbal_log")))


@query("year_month", with_(POSTS) + """SELECT post_id, year_month,
  CAST(year(year_month - INTERVAL 1 MONTH) AS INTEGER) AS prev_year,
  CAST(month(year_month - INTERVAL 1 MONTH) AS INTEGER) AS prev_month FROM posts""")
def year_month_q(spark, sf):
    p = A.posts_base(spark, sf).select("post_id", "year", "month")
    ym = S.month_start("year", "month")
    pm = S.prev_month(ym)
    return p.select("post_id", ym.alias("year_month"), F.year(pm).alias("prev_year"), F.month(pm).alias("prev_month"))


@query("extract_digits", r"SELECT page_id, regexp_extract(url, '(\d+)', 1) AS url_digits FROM pages")
def extract_digits_q(spark, sf):
    p = table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", S.extract_digits("url").alias("url_digits"))


@query("clean_token", "SELECT event_id, trim(split_part(trim(props), ':', 2)) AS prop_value FROM events")
def clean_token_q(spark, sf):
    e = table(spark, sf, "events", ["event_id", "props"])
    return e.select("event_id", S.clean_token("props", ":", 1).alias("prop_value"))


@query("dot_score", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY label, i)
SELECT e.vec_id, e.label, round(sum(CAST(e.x AS DOUBLE) * c.m), 6) AS score
FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY e.vec_id, e.label""")
def dot_score(spark, sf):
    v = A.vectors(spark, sf)
    comp = v.select("label", F.posexplode("embedding").alias("i", "x"))
    cent = (comp.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
                .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_c")))
    cent = cent.select("label", F.transform("_c", lambda s: s["m"]).alias("centroid"))
    return rounded(v.join(cent, "label").select("vec_id", "label", S.dot("embedding", "centroid").alias("score")))


@query("parse_lexicon", r"""WITH lines AS (
  SELECT p_name || ' ' || CAST(p_size AS VARCHAR) AS line FROM part
  UNION ALL SELECT split_part(p_name, ' ', 2) || ' ' || CAST(p_size - 25 AS VARCHAR) FROM part
  UNION ALL SELECT split_part(p_name, ' ', 1) || ' x' || CAST(p_size AS VARCHAR) FROM part),
parts AS (SELECT string_split_regex(trim(line), '\s+') AS p FROM lines)
SELECT p[1] AS word, TRY_CAST(p[2] AS DOUBLE) AS score FROM parts
WHERE len(p) = 2 AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL""")
def parse_lexicon_q(spark, sf):
    p = table(spark, sf, "part", ["p_name", "p_size"])
    lines = p.select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("value")).unionByName(
        p.select(F.concat_ws(" ", F.get(F.split("p_name", " "), 1), (F.col("p_size") - 25).cast("string")).alias("value"))
    ).unionByName(
        p.select(F.concat(F.get(F.split("p_name", " "), 0), F.lit(" x"), F.col("p_size").cast("string")).alias("value")))
    return parse_lexicon(lines)
