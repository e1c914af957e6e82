"""Fixed values and configuration tables.

Fixed values that define results (kept together, in natural order):
- sentiment codes: Negative = 0, Neutral = 1, Positive = 2
- chronological split, on first-of-month dates, inclusive both ends (the
  original 2017-2023 calendar shifted 22 years back to the test tables' dates):
    train  1995-01-01 .. 1999-12-31
    valid  2000-01-01 .. 2000-06-30
    test1  2000-07-01 .. 2000-09-30
    test2  2000-10-01 .. 2000-12-31
    test3  2001-01-01 .. 2001-03-31
    test4  2001-04-01 .. 2001-08-31
- negatives per positive: 3 (ladder sampler), 10 (fallback sampler)
- rank cap: 10 (ranks above become 11)
- top-N reduction: 10 most frequent values, the rest 'Others'
- share of positives when labelling scores: top 1 %
- canonical-source rule: longer than 40 characters, or canonical + '■'
"""

from __future__ import annotations

SENTIMENT_CODES = {"Negative": 0, "Neutral": 1, "Positive": 2}

SPLITS = [
    ("train", "1995-01-01", "1999-12-31"),
    ("valid", "2000-01-01", "2000-06-30"),
    ("test1", "2000-07-01", "2000-09-30"),
    ("test2", "2000-10-01", "2000-12-31"),
    ("test3", "2001-01-01", "2001-03-31"),
    ("test4", "2001-04-01", "2001-08-31"),
]

# Walk-forward rounds: (round, role, split).  Round r trains on one period and
# tests on the next; auxiliary negatives for sampling come from earlier periods.
ROUNDS = [
    (1, "train", "train"), (1, "valid", "valid"), (1, "test", "test1"),
    (2, "train", "test1"), (2, "test", "test2"),
    (3, "train", "test2"), (3, "test", "test3"),
    (4, "train", "test3"), (4, "test", "test4"),
]
# Auxiliary negative pools per (round, role).  Default: every earlier period.
ROUND_AUX = {
    (1, "train"): [],
    (1, "valid"): ["train"],
    (2, "train"): ["train", "valid"],
    (3, "train"): ["train", "valid", "test1"],
    (4, "train"): ["train", "valid", "test1", "test2"],
}
# The original leaves test2 out of round 4's pool; ``strict_history=False``
# reproduces that.
ROUND_AUX_AS_ORIGINAL = {**ROUND_AUX, (4, "train"): ["train", "valid", "test1"]}

NEG_PER_POS_LADDER = 3
NEG_PER_POS_FALLBACK = 10
MAX_RANK = 10
TOP_N = 10
TOP_FRACTION = 0.01
SOURCE_MAX_LEN = 40

# Parameter grids of the study, in Spark's parameter names.
GBT_GRID = {"maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2], "maxIter": [100, 200, 300],
            "subsamplingRate": [0.8, 0.9, 1.0], "featureSubsetStrategy": ["0.3", "0.5", "0.7"]}
FOREST_GRID = {"maxDepth": [10, 20, 30], "numTrees": [50, 80, 100, 150, 200]}
LOGISTIC_CS = [10.0 ** (-4 + 8 * i / 9) for i in range(10)]

# Names and sums of the match-statistics summary.
SUMMARY_COMBOS = [
    ("n1", ["neg_count1"]), ("n1+n21", ["neg_count1", "neg_count21"]),
    ("n1+n22", ["neg_count1", "neg_count22"]), ("n1+n23", ["neg_count1", "neg_count23"]),
    ("n2", ["neg_count2"]), ("n3", ["neg_count3"]), ("n1+n3", ["neg_count1", "neg_count3"]),
    ("n21+n3", ["neg_count21", "neg_count3"]), ("n22+n3", ["neg_count22", "neg_count3"]),
    ("n23+n3", ["neg_count23", "neg_count3"]),
]

# Model feature lists.
POST_FEATURES = ["month", "ind_code1_index", "ind_code2_index", "sentiment", "topic"]
AUTHOR_FEATURES = ["robo_site", "robo_media", "robo_sma",
                   "item_author_rank", "article_author_rank", "article_source_rank"]
FEATURE_ROLES = {**{f: "post" for f in POST_FEATURES}, **{f: "author" for f in AUTHOR_FEATURES}}
