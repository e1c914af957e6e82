"""Streaming query."""

from __future__ import annotations

import uuid

from ..session import shared_path
from ..sources.tables import table_path
from ..streaming.scorer import arrival_scorer, fit_arrival_model, score_new_arrivals
from .registry import query


@query("stream_score_arrivals", """WITH m AS (
  SELECT regr_slope(o_totalprice, CAST(o_custkey % 200 AS DOUBLE)) AS slope,
    regr_intercept(o_totalprice, CAST(o_custkey % 200 AS DOUBLE)) AS intercept
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
SELECT o_orderkey AS post_id,
  CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period,
  round(m.intercept + m.slope * (o_custkey % 200), 4) AS score FROM orders, m""")
def stream_score_arrivals(spark, sf):
    """A model fitted on the posts before 2000 and stored, then all posts streamed through it."""
    path = table_path(sf, "orders")
    orders = spark.read.parquet(path)
    history = orders.where("o_orderdate < TIMESTAMP_NTZ '2000-01-01'")
    model = fit_arrival_model(history, shared_path(spark, f"arrival-model-{uuid.uuid4().hex}"))
    return score_new_arrivals(spark, path, orders.schema, arrival_scorer(model))
