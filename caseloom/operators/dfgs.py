"""Filters on directly-follows graphs (a, b, n) with start and end activities (activity, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dropped, kept


def without_noise(edges: DataFrame, noise: float) -> DataFrame:
    """Edges with at least ``noise`` times the count of the smaller of their activities' largest edges."""
    ends = edges.select(F.col("a").alias("activity"), "n").union(edges.select("b", "n"))
    most = ends.groupBy("activity").agg(F.max("n").alias("most"))
    rows = edges.join(most.select(F.col("activity").alias("a"), F.col("most").alias("ma")), "a").join(most.select(F.col("activity").alias("b"), F.col("most").alias("mb")), "b")
    return rows.where(F.col("n") >= F.least("ma", "mb") * noise).select("a", "b", "n")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(activity) that a path leads to from start (activity), itself included: rounds until none is new."""
    seen = kept(start.select("activity").distinct(), "seen")
    front = seen
    while not front.isEmpty():
        new = edges.join(front.withColumnRenamed("activity", "a"), "a").select(F.col("b").alias("activity")).distinct()
        new = kept(new.join(seen, "activity", "left_anti"), "front")
        grown = kept(seen.union(new), "seen")
        dropped(seen)
        seen, front = grown, new
    return seen


def backwards(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")


def within(edges: DataFrame, activities: DataFrame) -> DataFrame:
    """Edges whose both ends are among activities."""
    return edges.join(activities.withColumnRenamed("activity", "a"), "a", "left_semi").join(activities.withColumnRenamed("activity", "b"), "b", "left_semi")


def one(edges: DataFrame, activity: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(activity,)], "activity string")


def to_activity(edges: DataFrame, starts: DataFrame, activity: str) -> DataFrame:
    """Edges on ways from a start activity that end at an activity."""
    left = kept(edges.where(F.col("a") != activity), "graph")
    both = reachable(left, starts).join(reachable(backwards(left), one(edges, activity)), "activity", "left_semi")
    return within(left, both)


def from_activity(edges: DataFrame, ends: DataFrame, activity: str) -> DataFrame:
    """Edges on ways from an activity to an end activity."""
    left = kept(edges.where(F.col("b") != activity), "graph")
    both = reachable(left, one(edges, activity)).join(reachable(backwards(left), ends), "activity", "left_semi")
    return within(left, both)


def containing(edges: DataFrame, starts: DataFrame, ends: DataFrame, activity: str) -> DataFrame:
    """Edges on ways from a start to an end activity that pass an activity."""
    edges = kept(edges, "graph")  # as small as the alphabet squared; each round reads it
    before = within(edges, reachable(edges, starts).join(reachable(backwards(edges), one(edges, activity)), "activity", "left_semi"))
    after = within(edges, reachable(edges, one(edges, activity)).join(reachable(backwards(edges), ends), "activity", "left_semi"))
    return before.union(after).distinct()
