"""Operator 3, URL filters by association rules.

Each bad labelled page is a transaction of URL tokens (host suffixes, path words,
query names, digits as #).  FP-growth (Spark ML, distributed) mines the token sets
of MIN_BAD bad pages or more; counted over all labelled pages they give rules
"tokens -> bad", pruned by support, by confidence, by lift over the share of bad
pages, and by dropping a rule that contains a smaller kept rule.  Rules match
pages by an inverted index: a rule is filed under its rarest token, a page looks
up its tokens and the other tokens of the rule are checked on the page itself.

FP-growth gives sets of every length, 2 ** n of them for n tokens that come
together, so a transaction of more than PIECE tokens is dealt to pieces in which any
MAX_TOKENS of its tokens meet; what comes out is counted afresh, page by page.

Fixed host/path rules (longest wins) come before the mined ones.

Sizes: a rule has MIN_BAD bad pages of its own kind and at most MAX_TOKENS tokens,
each in MIN_BAD bad pages; the index has one row per kept rule and the join is left
to Spark's size check.

Defined cases: a null url or one without :// has empty host and path, no tokens
and is allowed; pages without a label are judged but don't train; a page whose
label is repeated trains once, bad if any label is bad; repeated pages are
judged row by row; without labels no rule is mined; an empty table gives no
rows; other input columns are kept out of the result; a very long url is a
transaction of its frequent tokens like any other, and is judged whole.
Labels are keyed by doc_id: the label of a page is the one with doc_id = page_id.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: host/path rules of the contract: (rule, verdict)
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
              ("com/fr/", "allow"), ("com/de/", "block")]

MIN_BAD = 5            # bad labelled pages that a rule needs
MIN_CONFIDENCE = 0.5
MIN_LIFT = 2.0         # confidence over the share of bad pages
MAX_TOKENS = 3
PIECE = 12             # tokens of a transaction that FP-growth gets together


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, path).otherwise("")


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later wins
        h, p = text.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: h:<host suffix>, l:<first host label>, p:<path word>, q:<query name>."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    plain = F.transform(F.split(F.regexp_replace(path, r"[0-9]+", "#"), r"[^\p{L}\p{N}#]+"), lambda x: F.when(x != "", F.concat(F.lit("p:"), x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.when(x != "", F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1)))))
    every = F.filter(F.concat(suffixes, F.array(F.concat(F.lit("l:"), F.get(labels, F.lit(0)))), plain, names), lambda x: x.isNotNull() & (x != "h:"))
    return F.when(host != "", F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def _pieces(tokens: Column, most: int) -> Column:
    """Arrays of at most PIECE tokens that together hold every set of `most` tokens:
    the tokens in groups of PIECE / most, and the unions of `most` groups."""
    size = PIECE // most
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(tokens) / size).cast("int") - 1),
                         lambda g: F.slice(tokens, g * size + 1, F.lit(size)))

    def unions(left: Column, start: Column, depth: int) -> Column:
        rest = F.when(start < F.size(groups), F.sequence(start, F.size(groups) - 1)).otherwise(F.array().cast("array<int>"))
        if depth == 1:
            return F.transform(rest, lambda g: F.concat(left, F.get(groups, g)))
        return F.flatten(F.transform(rest, lambda g: unions(F.concat(left, F.get(groups, g)), g + 1, depth - 1)))

    return F.when(F.size(tokens) <= PIECE, F.array(tokens)).otherwise(unions(F.array().cast("array<string>"), F.lit(0), most))


def mine_rules(labelled: DataFrame, min_bad: int = MIN_BAD, min_confidence: float = MIN_CONFIDENCE,
               max_tokens: int = MAX_TOKENS, min_lift: float = MIN_LIFT) -> DataFrame:
    """labelled: (tokens array<string>, bad boolean) -> (tokens, hits, confidence)."""
    labelled = labelled.where(F.size("tokens") > 0)
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0))).first()
    empty = labelled.sparkSession.createDataFrame([], "tokens array<string>, hits long, confidence double")
    if bad < min_bad:
        return empty
    rows = materialize(labelled.withColumn("key", F.monotonically_increasing_id()), "labelled")
    one = rows.where("bad").select("key", F.explode("tokens").alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_bad).select("token")
    held = one.join(often, "token").groupBy("key").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    items = materialize(held.select(F.explode(_pieces(F.col("tokens"), max_tokens)).alias("items")), "transactions")
    pieces = items.count()
    if not pieces:
        return empty
    sets = FPGrowth(itemsCol="items", minSupport=min_bad / (pieces + 0.5)).fit(items).freqItemsets
    sets = sets.where(F.size("items") <= max_tokens).select(F.array_sort("items").alias("tokens"))
    sets = materialize(sets.distinct(), "itemsets")
    # pieces count a page more than once, and good pages count too
    met = _matches(rows.select("key", "tokens", "bad"), sets)
    rules = met.groupBy(F.col("rule_tokens").alias("tokens")).agg(
        F.sum(F.col("bad").cast("long")).alias("hits"), F.avg(F.col("bad").cast("double")).alias("confidence"))
    rules = rules.where((F.col("hits") >= min_bad) & (F.col("confidence") >= min_confidence)
                        & (F.col("confidence") * n >= F.lit(min_lift) * bad))
    rules = materialize(rules, "rules")
    # drop rules that contain a smaller kept rule: look up every proper subset
    part = F.filter(_subsets(F.col("tokens"), max_tokens), lambda s: (F.size(s) > 0) & (F.size(s) < F.size("tokens")))
    subs = rules.select(F.col("tokens").alias("whole"), F.explode(part).alias("tokens"))
    wider = subs.join(rules.select("tokens"), "tokens", "left_semi").select(F.col("whole").alias("tokens")).distinct()
    return rules.join(wider, "tokens", "left_anti")


def _subsets(a: Column, n: int) -> Column:
    """All subsets of an array of at most n elements (2**n arrays)."""
    def take(bits):
        chosen = [F.when(F.size(a) > k, F.get(a, F.lit(k))) for k in range(n) if bits >> k & 1]
        return F.filter(F.array(*chosen), lambda x: x.isNotNull()) if chosen else F.array().cast("array<string>")
    return F.array(*[take(b) for b in range(2 ** n)])


def _matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (key, tokens, ...) with rule_tokens of every rule that they satisfy.

    Inverted index: rules are filed under their least frequent token, so a
    token on every page files no rule that has a rarer one.
    """
    counts = pages.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("tokens", F.explode("tokens").alias("token")).join(counts, "token")
    index = filed.groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token")).withColumnRenamed("tokens", "rule_tokens")
    probes = pages.select("*", F.explode("tokens").alias("token"))
    return probes.join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, n_rules) for pages (key, tokens) that satisfy a rule."""
    return _matches(pages, rules).groupBy("key").agg(F.count("*").alias("n_rules"))


def filter_urls(pages: DataFrame, labels: DataFrame, min_bad: int = MIN_BAD,
                min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, n_rules (mined rules that match)."""
    url = F.col("url")
    p = pages.select("page_id", F.col("url").cast("string").alias("url"))
    p = p.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), url_tokens(url).alias("tokens"))
    p = materialize(p, "urls")
    lab = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(((F.col("toxic") == 1) | (F.col("quality") == 0)), F.lit(False))).alias("bad"))
    train = p.dropDuplicates(["page_id"]).join(lab, F.col("page_id") == F.col("doc_id")).select("tokens", "bad")
    rules = mine_rules(train, min_bad, min_confidence)
    # pages with equal token sets get equal verdicts: match each set once
    sets = p.select("tokens").where(F.size("tokens") > 0).distinct().withColumn("key", F.array_join("tokens", "\x01"))
    hits = match_rules(sets, rules)
    rule, verdict = host_rule(F.col("host"), F.col("path"))
    out = p.withColumn("key", F.array_join("tokens", "\x01")).join(hits, "key", "left")
    mined = F.when(F.col("n_rules").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"),
                      F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


_RULE_ROWS = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in HOST_RULES)

SQL_OP3 = rf"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT r, page_id, url,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
toks AS (
  SELECT *, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'h:' || array_to_string(string_split(host, '.')[i:], '.'))
    || ['l:' || string_split(host, '.')[1]]
    || list_transform(list_filter(regexp_split_to_array(regexp_replace(path, '[0-9]+', '#', 'g'), '[^\p{{L}}\p{{N}}#]+'), lambda x: x <> ''), lambda x: 'p:' || x)
    || list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'q:' || split_part(x, '=', 1)),
    lambda x: x <> 'h:'))) END AS tokens FROM parts),
lab AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
train AS (SELECT page_id, tokens, bad FROM (SELECT page_id, any_value(tokens) AS tokens FROM toks GROUP BY page_id) t JOIN lab ON page_id = doc_id),
n AS (SELECT count(*) AS n, count(*) FILTER (bad) AS nb FROM train WHERE len(tokens) > 0),
one AS (SELECT page_id, bad, unnest(tokens) AS t FROM train),
sets AS (
  SELECT [t] AS s, count(*) AS c, count(*) FILTER (bad) AS b FROM one GROUP BY t
  UNION ALL SELECT [x.t, y.t], count(*), count(*) FILTER (x.bad) FROM one x JOIN one y ON x.page_id = y.page_id AND x.t < y.t GROUP BY x.t, y.t
  UNION ALL SELECT [x.t, y.t, z.t], count(*), count(*) FILTER (x.bad) FROM one x JOIN one y ON x.page_id = y.page_id AND x.t < y.t
    JOIN one z ON x.page_id = z.page_id AND y.t < z.t GROUP BY x.t, y.t, z.t),
good AS (SELECT s FROM sets, n WHERE b >= {MIN_BAD} AND CAST(b AS DOUBLE) / c >= {MIN_CONFIDENCE} AND CAST(b AS DOUBLE) / c * n >= {MIN_LIFT} * nb),
rules AS (SELECT s FROM good g WHERE NOT EXISTS (SELECT 1 FROM good o WHERE len(o.s) < len(g.s) AND list_has_all(g.s, o.s))),
hits AS (SELECT tokens, count(*) AS n_rules FROM (SELECT DISTINCT tokens FROM toks) t JOIN rules ON list_has_all(t.tokens, rules.s) GROUP BY tokens),
fixed(rule, h, p, verdict) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT toks.r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM toks JOIN fixed ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY toks.r)
SELECT page_id, host, path, fits.rule AS rule,
  coalesce(fits.verdict, CASE WHEN hits.n_rules IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(hits.n_rules, 0) AS BIGINT) AS n_rules
FROM toks LEFT JOIN fits ON fits.r = toks.r LEFT JOIN hits ON hits.tokens = toks.tokens
"""
