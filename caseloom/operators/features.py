"""Feature tables of cases, targets for prediction, and seeded splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cases, in_case, position, unused


def case_features(log: DataFrame, activities: Sequence[str], edges: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """A row per case: n_events, duration_s, a count for each activity (act_*) and each directly-follows edge (edge_i)."""
    rows = log.withColumn("next", F.lead("activity").over(in_case()))
    counts = [F.count_if(F.col("activity") == a).alias(f"act_{a}") for a in activities]
    pairs = [F.count_if((F.col("activity") == a) & (F.col("next") == b)).alias(f"edge_{i}") for i, (a, b) in enumerate(edges)]
    return rows.groupBy("case_id").agg(F.count("*").alias("n_events"), ((F.max("us") - F.min("us")) / 1e6).alias("duration_s"), *counts, *pairs)


def remaining_time(log: DataFrame) -> DataFrame:
    """(case_id, event_idx, position, elapsed_s, remaining_s, next_activity) of each event."""
    own = Window.partitionBy("case_id")
    return log.select(
        "case_id", "event_idx", position().cast("long").alias("position"), ((F.col("us") - F.min("us").over(own)) / 1e6).alias("elapsed_s"), ((F.max("us").over(own) - F.col("us")) / 1e6).alias("remaining_s"), F.lead("activity").over(in_case()).alias("next_activity")
    )


def case_rates(log: DataFrame) -> DataFrame:
    """(case_id, service_s, sojourn_s, waiting_s): the events' own time, the case's span, and the difference."""
    c = log.groupBy("case_id").agg((F.sum(F.col("us") - F.col("start_us")) / 1e6).alias("service_s"), ((F.max("us") - F.min("start_us")) / 1e6).alias("sojourn_s"))
    return c.withColumn("waiting_s", F.col("sojourn_s") - F.col("service_s"))


def case_split(log: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The events of about a share of the cases and of the rest: chosen by the hash of case and seed, so reruns agree."""
    hit = F.pmod(F.xxhash64(F.col("case_id").cast("string"), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    return log.where(hit), log.where(~hit)


def prefixes_of(log: DataFrame, length: int) -> DataFrame:
    """The first events of each case."""
    place = unused(log, "place")
    return log.withColumn(place, position()).where(F.col(place) < length).drop(place)


def time_pivot(log: DataFrame, months: Sequence[int] = tuple(range(1, 13))) -> DataFrame:
    """A row per case with its events by month (m1 ... m12)."""
    m = F.month(F.col("ts").cast("timestamp"))
    return log.groupBy("case_id").agg(*[F.count_if(m == k).alias(f"m{k}") for k in months])


def cube(log: DataFrame, bins: int = 4) -> DataFrame:
    """(size_bin, duration_bin, n_cases, mean_duration_s): cases by equal-width bins of their size and duration."""
    c = cases(log).select("n_events", ((F.col("last_us") - F.col("first_us")) / 1e6).alias("d"))
    edge = c.agg(F.min("n_events").alias("a0"), F.max("n_events").alias("a1"), F.min("d").alias("b0"), F.max("d").alias("b1"))
    binned = lambda x, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1))).otherwise(0).cast("long")
    rows = c.crossJoin(F.broadcast(edge)).select(binned("n_events", "a0", "a1").alias("size_bin"), binned("d", "b0", "b1").alias("duration_bin"), "d")  # one row
    return rows.groupBy("size_bin", "duration_bin").agg(F.count("*").alias("n_cases"), F.avg("d").alias("mean_duration_s"))
