"""Frequent segments of cases with gaps: activities that stand in this order, with others between them or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dropped, kept
from ..schema import variants


def frequent_segments(log: DataFrame, least: int, most_length: int | None = None) -> DataFrame:
    """(segment, n): segments of activities that at least ``least`` cases hold in this order, of at most ``most_length`` activities.

    Level by level: a frequent segment keeps, for each distinct variant that holds it, the place where its first occurrence ends; what
    follows that place gives the next level.  Counts of variants are summed before the shuffle, so a segment that all cases share,
    and an activity that follows it everywhere, cost a partial sum a task.  The number of frequent segments may grow with the power of
    their length: that is the result's size, which ``least`` and ``most_length`` set.
    """
    counted = variants(log).groupBy("variant").agg(F.count("*").alias("n"))
    places = kept(counted.select(F.array().cast("array<string>").alias("segment"), "variant", "n", F.lit(0).alias("at")), "places")
    found, length = [], 0
    while most_length is None or length < most_length:
        rest = F.slice("variant", F.col("at") + 1, F.size("variant"))
        step = places.withColumn("rest", rest).select("segment", "variant", "n", "at", "rest", F.explode(F.array_distinct("rest")).alias("next"))
        step = step.select(F.concat("segment", F.array("next")).alias("segment"), "variant", "n", (F.col("at") + F.array_position("rest", F.col("next"))).cast("int").alias("at"))
        counts = kept(step.groupBy("segment").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "segments")
        if counts.isEmpty():
            dropped(counts)
            break
        found.append(counts)
        nxt = kept(step.join(counts.select("segment"), "segment", "left_semi"), "places")
        dropped(places)
        places, length = nxt, length + 1
    out = log.sparkSession.createDataFrame([], "segment array<string>, n long")
    for counts in found:
        out = out.unionByName(counts)
    return out
