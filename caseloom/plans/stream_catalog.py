"""Registered queries that replay the events table as a stream, and the SQL of the batch rows they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import kept
from ..operators import conformance, relations
from ..streaming import conformance as streamed
from ..streaming.replay import replayed, time_slices
from .catalog import PAIRS, QUERIES, SQL, E, log_of, query
from .feature_catalog import BROKEN, PAIRED, _model

SLICES, IDLE, LATE, AHEAD_S = 3, "60 days", "1 hour", 61 * 86400.0


def replay(name: str, sql: str, models: Callable[[DataFrame], tuple[DataFrame, ...]], transform: Callable[..., DataFrame]) -> None:
    """transform(stream, *models(log)) over the events table in slices of time; the models are made once, not for every slice."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = log_of(spark, sf_dir)
        made = [kept(m, "model") for m in models(log)]
        return replayed(time_slices(log, SLICES, AHEAD_S), lambda stream: transform(stream, *made))

    QUERIES[name], SQL[name] = run, E + sql


def frequent_model(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, first and last activities that are at least as frequent as their mean."""
    often = lambda t: t.join(t.agg(F.avg("n").alias("mean")), F.col("n") >= F.col("mean"), "inner").drop("mean")  # noqa: E731  one row
    return often(relations.dfg(log)), often(relations.endpoints(log)), often(relations.endpoints(log, "last_activity"))


FREQUENT = """, g AS (SELECT activity AS a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL), gs AS (SELECT a, b FROM g WHERE n >= (SELECT avg(n) FROM g)),
f AS (SELECT first_activity AS act, count(*) AS n FROM c GROUP BY ALL), fs AS (SELECT act FROM f WHERE n >= (SELECT avg(n) FROM f)),
l AS (SELECT last_activity AS act, count(*) AS n FROM c GROUP BY ALL), ls AS (SELECT act FROM l WHERE n >= (SELECT avg(n) FROM l)),
dev AS (SELECT case_id, 'step' AS kind, activity AS a, b, us2 AS us FROM s WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gs WHERE gs.a = s.activity AND gs.b = s.b)
UNION ALL SELECT case_id, 'start', NULL, first_activity, first_us FROM c WHERE first_activity NOT IN (SELECT act FROM fs)
UNION ALL SELECT case_id, 'end', last_activity, NULL, last_us FROM c WHERE last_activity NOT IN (SELECT act FROM ls)) """
query("footprint_deviations", FREQUENT + "SELECT case_id, kind, a, b, us FROM dev")(lambda log: conformance.footprint_deviations(log, *frequent_model(log)))
replay("stream_footprint_deviations", FREQUENT + "SELECT case_id::VARCHAR AS case_id, kind, a, b, us FROM dev", frequent_model, lambda stream, *model: streamed.stream_footprint_deviations(stream, *model, IDLE, LATE))
replay(
    "stream_declare_deviations",
    PAIRED + f" SELECT case_id::VARCHAR AS case_id, template, a, b FROM y WHERE {BROKEN}",
    lambda log: (_model(log),),
    lambda stream, model: streamed.stream_declare_deviations(stream, model, IDLE, LATE).select("case_id", "template", "a", "b"),
)
replay(
    "stream_temporal_deviations",
    f", q AS ({PAIRS}), t AS (SELECT a, b, avg(gap) AS m, coalesce(stddev_samp(gap), 0) AS d FROM q GROUP BY ALL) SELECT q.case_id::VARCHAR AS case_id, a, b, gap FROM q JOIN t USING (a, b) WHERE abs(gap - m) > 2 * d",
    lambda log: (relations.temporal_profile(log),),
    lambda stream, profile: streamed.stream_temporal_deviations(stream, profile, 2, IDLE, LATE).select("case_id", "a", "b", "gap"),
)
