"""Filters of directly-follows graphs by share or dependency that keep activities on ways from the start to the end."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import indexed
from ..functions.tables import dropped, kept
from .relations import dfg, endpoints

# The names under which start and end take part in ties between links of equal weight.
FIRST, LAST = "_S_START_", "_S_END_"
START, END, ALWAYS = "start", "end", (1 << 63) - 1
EDGE, ENTRY, EXIT, ACTIVITY = "edge", "start", "end", "activity"


@dataclass(frozen=True)
class FollowsGraph:
    """edges (a, b, n), starts, ends and activities (activity, n)."""

    edges: DataFrame
    starts: DataFrame
    ends: DataFrame
    activities: DataFrame

    def rows(self) -> DataFrame:
        """(kind, a, b, n) of all parts: edge, start, end and activity."""
        alone = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), "n")
        x = F.col("activity")
        out = self.edges.select(F.lit(EDGE).alias("kind"), "a", "b", "n")
        return out.union(alone(self.starts, ENTRY, F.lit(FIRST), x)).union(alone(self.ends, EXIT, x, F.lit(LAST))).union(alone(self.activities, ACTIVITY, x, x))


def follows_graph(log: DataFrame) -> FollowsGraph:
    return FollowsGraph(dfg(log), endpoints(log, "first_activity"), endpoints(log, "last_activity"), log.groupBy("activity").agg(F.count("*").alias("n")))


def by_activities(graph: FollowsGraph, share: float) -> FollowsGraph:
    """Removes activities from the rarest on, but those that the most frequent ``share`` needs on its ways from start and to end.

    Of k activities ceil((k - 1) * share) + 1 stay in any case; equal counts are ordered by name.  A graph of one activity or one edge is
    returned as it is, as is one in which some of the staying ones lack a way already, except for what no way passes.
    """
    if _small(graph):
        return graph
    rows = kept(graph.rows(), "graph")
    placed = indexed(rows.where(F.col("kind") == ACTIVITY), "n", "a")
    low = _low(placed, share)
    ranks = placed.select("kind", "a", "b", F.when(F.col("index") < low, F.col("index")).alias("rank"))
    return _connected(rows, ranks, ranks.where("rank IS NULL").select("a"))


def by_paths(graph: FollowsGraph, share: float, keep_all: bool = False) -> FollowsGraph:
    """Removes links (edges, starts, ends) from the rarest on, but those that activities of the most frequent ``share`` of links need.

    With ``keep_all`` every activity keeps a way.  Counts and ties as in by_activities(), ties by the names at both ends.
    """
    if _small(graph):
        return graph
    rows = kept(graph.rows(), "graph")
    placed = indexed(rows.where(F.col("kind") != ACTIVITY), "n", "a", "b", "kind")
    low = _low(placed, share)
    return _by_links(rows, placed.withColumn("rank", F.when(F.col("index") < low, F.col("index"))), keep_all)


def by_dependency(graph: FollowsGraph, threshold: float, keep_all: bool = False) -> FollowsGraph:
    """Removes links with a dependency (ab - ba) / (ab + ba + 1) below the threshold, lowest first; starts and ends have 1."""
    if _small(graph):
        return graph
    rows = kept(graph.rows(), "graph")
    back = graph.edges.select(F.lit(EDGE).alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    m = F.coalesce("m", F.lit(0))
    dependency = F.when(F.col("kind") == EDGE, (F.col("n") - m) / (F.col("n") + m + 1)).otherwise(1.0)
    weighed = rows.where(F.col("kind") != ACTIVITY).join(back, ["kind", "a", "b"], "left").withColumn("dependency", dependency)
    placed = indexed(weighed, "dependency", "a", "b", "kind")
    return _by_links(rows, placed.withColumn("rank", F.when(F.col("dependency") < threshold, F.col("index"))), keep_all)


def _small(graph: FollowsGraph) -> bool:
    return graph.activities.limit(2).count() < 2 or graph.edges.limit(2).count() < 2


def _low(placed: DataFrame, share: float) -> int:
    """How many of the lowest places are open to removal."""
    n = placed.count()
    return n - math.ceil((n - 1) * share) - 1


def _by_links(rows: DataFrame, placed: DataFrame, keep_all: bool) -> FollowsGraph:
    if keep_all:
        must = rows.where(F.col("kind") == ACTIVITY).select("a")
    else:
        firm = placed.where("rank IS NULL")
        must = firm.where(F.col("kind") != ENTRY).select("a").union(firm.where(F.col("kind") != EXIT).select("b"))
    return _connected(rows, placed.select("kind", "a", "b", "rank"), must)


def _connected(rows: DataFrame, ranks: DataFrame, must: DataFrame) -> FollowsGraph:
    """What is left of a graph's rows when those with a rank go in its order, as long as all of must (a) keep their ways.

    An activity is a link of its own between its two sides, so that links and activities are removed alike.
    """
    into, out = (lambda c: F.concat(F.lit("i:"), c)), (lambda c: F.concat(F.lit("o:"), c))
    kind = F.col("kind")
    u = F.when(kind == ENTRY, START).when(kind == ACTIVITY, into("a")).otherwise(out("a"))
    v = F.when(kind == EXIT, END).when(kind == ACTIVITY, out("b")).otherwise(into("b"))
    links = kept(rows.join(ranks, ["kind", "a", "b"], "left").select("kind", "a", "b", "n", "rank", u.alias("u"), v.alias("v")), "links")
    stay, width, whole = _needed(links.select("u", "v", "rank"), must.distinct().select(into("a").alias("node")))
    left = links.where("rank IS NULL").unionByName(links.join(stay, "rank", "left_semi").select(links.columns)) if whole else links
    at = width.where(F.col("width") == ALWAYS) if whole else width
    passed = at.groupBy("node").agg(F.count("*").alias("sides")).where("sides = 2").select("node")
    left = left.join(passed.withColumnRenamed("node", "u"), "u", "left_semi").join(passed.withColumnRenamed("node", "v"), "v", "left_semi")
    left = kept(left.select("kind", "a", "b", "n"), "graph")
    part = lambda k, c: left.where(F.col("kind") == k).select(F.col(c).alias("activity"), "n")
    return FollowsGraph(left.where(kind == EDGE).select("a", "b", "n"), part(ENTRY, "b"), part(EXIT, "a"), part(ACTIVITY, "a"))


def _needed(links: DataFrame, must: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(rank) of the links (u, v, rank; null: never removed) that removal in the order of ranks has to leave, widths, and if all of must had ways.

    A way is as wide as the lowest rank on it.  If the widest ways from the start and to the end of all of must are wider than some
    rank, that link and all lower ones can go, since the ways of higher ranks are all still there; and the link that bounds the
    narrowest of these ways must stay, as without it no way is left.  So one pass over widest ways decides all links up to the next one
    that stays; it is then wide for ever, and widths only grow from there.  Rounds: a link that stays (at most two for
    each activity), times a few links of a way.  The tables hold the alphabet squared at most.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    lone = F.col("rank").alias("place"), F.coalesce("rank", F.lit(ALWAYS)).alias("rank")
    graph = kept(links.select(F.lit(0).alias("side"), "u", "v", *lone).union(links.select(F.lit(1), "v", "u", *lone)), "graph")
    ends = links.sparkSession.createDataFrame([(0, START, ALWAYS, False), (1, END, ALWAYS, False)], "side int, node string, width long, goal boolean")
    width = kept(ends.union(must.select(sides, "node", F.lit(-1), F.lit(True))), "width")
    while True:
        width, least = _widened(graph, width)
        if least in (None, -1, ALWAYS):
            return graph.where(f"place IS NOT NULL AND rank = {ALWAYS}").select(F.col("place").alias("rank")).distinct(), width.where("width >= 0"), least != -1
        firmer = kept(graph.withColumn("rank", F.when(F.col("rank") == least, ALWAYS).otherwise(F.col("rank"))), "graph")
        dropped(graph)
        graph = firmer


def _widened(graph: DataFrame, width: DataFrame, steps: int = 3) -> tuple[DataFrame, int | None]:
    """Widths (side, node, width, goal) when no link widens another, and the least of a goal; some links of a way a round."""
    while True:
        now = width.withColumn("was", F.col("width"))
        for _ in range(steps):
            offers = now.where("width >= 0").withColumnRenamed("node", "u").join(graph, ["side", "u"])
            offers = offers.select("side", F.col("v").alias("node"), F.least("width", "rank").alias("width"), F.lit(False).alias("goal"), F.lit(None).cast("long").alias("was"))
            now = now.select(offers.columns).union(offers).groupBy("side", "node").agg(F.max("width").alias("width"), F.max("goal").alias("goal"), F.max("was").alias("was"))
        grown = kept(now, "width")
        dropped(width)
        least, moved = grown.agg(F.min(F.when(F.col("goal"), F.col("width"))), F.max(F.col("was").isNull() | (F.col("width") > F.col("was")))).first()
        width = grown.select("side", "node", "width", "goal")
        width._kept_at = grown._kept_at
        if not moved:
            return width, least
