"""Organisational relations between resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import ranged
from ..functions.tables import dropped, kept
from ..schema import in_case


def handover(log: DataFrame) -> DataFrame:
    """(source, target, n, share): work passed directly from one resource to the next of a case; shares of all passes."""
    rows = log.select(F.col("resource").alias("source"), F.lead("resource").over(in_case()).alias("target")).where("source IS NOT NULL AND target IS NOT NULL")
    counts = rows.groupBy("source", "target").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("source", "target", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def working_together(log: DataFrame, normalise: str = "events") -> DataFrame:
    """(a, b, n_cases, share): resources of one case, a < b; by the number of events, or of cases on request."""
    own = log.where("resource IS NOT NULL").select("case_id", "resource").distinct()
    x, y = own.withColumnRenamed("resource", "a"), own.withColumnRenamed("resource", "b")
    counts = x.join(y, "case_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_cases"))
    total = log.agg((F.count("*") if normalise == "events" else F.count_distinct("case_id")).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("a", "b", "n_cases", (F.col("n_cases") / F.col("total")).alias("share"))  # one row


def subcontracting(log: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b, n, share): a passes to b and has the case back after ``distance`` steps; shares of the number of cases."""
    w = in_case()
    rows = log.select("case_id", F.col("resource").alias("a"), F.lead("resource", distance).over(w).alias("back"), F.array(*[F.lead("resource", k).over(w) for k in range(1, distance)]).alias("between"))
    hits = rows.where("a = back").select("a", F.explode("between").alias("b")).where("b IS NOT NULL AND a <> b")
    counts = hits.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(log.agg(F.count_distinct("case_id").alias("total")))).select("a", "b", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def joint_activities(log: DataFrame) -> DataFrame:
    """(a, b, similarity): Pearson correlation of two resources' activity counts over all activities, a < b; null if one is constant."""
    counts = log.where("resource IS NOT NULL").groupBy("resource", "activity").agg(F.count("*").cast("double").alias("n"))
    size = log.where("resource IS NOT NULL").agg(F.count_distinct("activity").alias("m"))
    own = counts.groupBy("resource").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    x, y = counts.select(F.col("resource").alias("a"), "activity", F.col("n").alias("na")), counts.select(F.col("resource").alias("b"), "activity", F.col("n").alias("nb"))
    dots = x.join(y, "activity").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    pairs = own.select(F.col("resource").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")).join(own.select(F.col("resource").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), F.col("a") < F.col("b"))
    rows = pairs.join(dots, ["a", "b"], "left").crossJoin(F.broadcast(size))  # one row
    m = F.col("m")
    cover = m * F.coalesce("dot", F.lit(0.0)) - F.col("sa") * F.col("sb")
    spread = F.sqrt((m * F.col("qa") - F.col("sa") * F.col("sa")) * (m * F.col("qb") - F.col("sb") * F.col("sb")))
    return rows.select("a", "b", F.when(spread > 0, cover / spread).alias("similarity"))


def resource_profile(log: DataFrame) -> DataFrame:
    """(resource, n_events, n_activities, n_cases, share_of_cases)."""
    total = log.agg(F.count_distinct("case_id").alias("total"))
    rows = log.where("resource IS NOT NULL").groupBy("resource").agg(F.count("*").alias("n_events"), F.count_distinct("activity").alias("n_activities"), F.count_distinct("case_id").alias("n_cases"))
    return rows.crossJoin(F.broadcast(total)).select("resource", "n_events", "n_activities", "n_cases", (F.col("n_cases") / F.col("total")).alias("share_of_cases"))  # one row


def since_previous(log: DataFrame) -> DataFrame:
    """The log with events that begin when the one before in their case ends; the first ones have no length."""
    return log.withColumn("start_us", F.coalesce(F.lag("us").over(in_case()), F.col("us")))


def event_workload(log: DataFrame) -> DataFrame:
    """(case_id, event_idx, resource, start_us, us, n): events of the resource whose time [start, end] meets that of the event, itself included.

    Starts and ends stand in one order: an event meets those that began by its end, less those that ended before its start.  Counts run
    inside ranges of resource and time and are carried on, so a resource that does a third of all events is not one task.
    """
    own = log.where("resource IS NOT NULL").select("case_id", "event_idx", "resource", "start_us", "us")
    start = F.struct(F.col("start_us").alias("at"), F.lit(0).alias("ends"))
    end = F.struct(F.col("us").alias("at"), F.lit(1).alias("ends"))
    order = ["at", "ends", "case_id", "event_idx"]
    marks = ranged(own.select("*", F.inline(F.array(start, end))), "resource", *order)
    w = Window.partitionBy("part", "resource").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = marks.withColumns({"began": F.sum(1 - F.col("ends")).over(w), "ended": F.sum("ends").over(w)})
    parts = marks.groupBy("part", "resource").agg(F.sum(1 - F.col("ends")).alias("b"), F.sum("ends").alias("e"))
    earlier = Window.partitionBy("resource").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = parts.select("part", "resource", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b"), F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("e"))
    rows = inside.join(carried, ["part", "resource"])
    met = F.max(F.when(F.col("ends") == 1, F.col("began") + F.col("b"))) - F.max(F.when(F.col("ends") == 0, F.col("ended") + F.col("e")))
    return rows.groupBy("case_id", "event_idx", "resource", "start_us", "us").agg(met.alias("n"))


def workload_measures(log: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """(resource, average_workload, multitasking) in a time.

    average_workload: event_workload() of the events that end from low on and start before high, weighted by their lengths; multitasking: of the
    lengths of events that lie in the time, the share with a workload above 1.  0 where all lengths are 0.
    """
    took, n = F.col("us") - F.col("start_us"), F.col("n")
    meets, inside = (F.col("us") >= low_us) & (F.col("start_us") < high_us), (F.col("start_us") >= low_us) & (F.col("us") <= high_us)
    total = lambda hit, x: F.coalesce(F.sum(F.when(hit, x)), F.lit(0))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    sums = event_workload(log).groupBy("resource").agg(total(meets, took * n).alias("load"), total(meets, took).alias("time"), total(inside & (n > 1), took).alias("shared"), total(inside, took).alias("inner"))
    return sums.select("resource", share("load", "time").alias("average_workload"), share("shared", "inner").alias("multitasking"))


def case_interactions(log: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """(a, b, n_cases): cases that end in the time from low to before high and hold events of both resources, a < b."""
    own = log.groupBy("case_id").agg(F.array_sort(F.collect_set("resource")).alias("all"), F.max("us").alias("last"))
    rows = own.where((F.col("last") >= low_us) & (F.col("last") < high_us)).select("all", F.posexplode("all").alias("i", "a"))
    pairs = rows.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_cases"))


def activity_share(log: DataFrame) -> DataFrame:
    """(resource, activity, n, share of the resource's events)."""
    counts = log.where("resource IS NOT NULL").groupBy("resource", "activity").agg(F.count("*").alias("n"))
    return counts.select("resource", "activity", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("resource"))).alias("share"))


def social_position(log: DataFrame) -> DataFrame:
    """(resource, share of the resources with which it shares a case, itself not counted among them)."""
    own = log.where("resource IS NOT NULL").select("case_id", "resource").distinct()
    pairs = own.join(own.withColumnRenamed("resource", "other"), "case_id").where("resource <> other").select("resource", "other").distinct()
    total = own.agg(F.count_distinct("resource").alias("total"))
    met = own.select("resource").distinct().join(pairs.groupBy("resource").agg(F.count("*").alias("k")), "resource", "left")
    return met.crossJoin(F.broadcast(total)).select("resource", (F.coalesce("k", F.lit(0)) / F.col("total")).alias("share"))  # one row


def group_metrics(log: DataFrame, group: str) -> DataFrame:
    """(group, activity, focus, stake, coverage): of a group's events, of an activity's events, and of the group's resources."""
    rows = log.where(f"resource IS NOT NULL AND {group} IS NOT NULL").withColumn("grp", F.col(group).cast("string"))
    counts = rows.groupBy("grp", "activity").agg(F.count("*").alias("n"), F.count_distinct("resource").alias("r"))
    sizes = rows.groupBy("grp").agg(F.count_distinct("resource").alias("size"))
    out = counts.join(sizes, "grp")
    focus = F.col("n") / F.sum("n").over(Window.partitionBy("grp"))
    stake = F.col("n") / F.sum("n").over(Window.partitionBy("activity"))
    return out.select(F.col("grp").alias("group"), "activity", focus.alias("focus"), stake.alias("stake"), (F.col("r") / F.col("size")).alias("coverage"))


def similar_roles(log: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(role, activity): roles of activities whose resources are alike, named by their first activity.

    The likeness of two roles is the sum over resources of the smaller of their shares of events, by that of the larger.  In rounds,
    each role looks for the likest other above ``threshold`` (ties: the first names); two that choose each other become one, with the sum
    of their events, until none are left.  Only roles that share a resource are compared.  Activities without any resource are left out.
    """
    work = kept(log.where("resource IS NOT NULL").groupBy(F.col("activity").alias("role"), "resource").agg(F.count("*").alias("n")), "work")
    members = kept(work.select(F.col("role").alias("activity"), "role").distinct(), "members")
    while True:
        share = work.join(work.groupBy("role").agg(F.sum("n").alias("total")), "role").select("role", "resource", (F.col("n") / F.col("total")).alias("share"))
        x, y = share.toDF("x", "resource", "sx"), share.toDF("y", "resource", "sy")
        small = x.join(y, "resource").where("x <> y").groupBy("x", "y").agg(F.sum(F.least("sx", "sy")).alias("m"))
        # Both sum to one, so the larger shares sum to 2 - m; rounded, so that the order of sums decides no tie.
        like = small.withColumn("like", F.round(F.col("m") / (2 - F.col("m")), 9)).where(F.col("like") > threshold)
        best = like.groupBy("x").agg(F.min(F.struct((-F.col("like")).alias("l"), F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"), "y")).alias("b")).select("x", F.col("b.y").alias("y"))
        best = kept(best, "best")
        pairs = kept(best.join(best.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_semi").where("x < y").select(F.col("y").alias("role"), F.col("x").alias("to")), "pairs")
        if pairs.isEmpty():
            return members.select("role", "activity")
        renamed = lambda df: df.join(pairs, "role", "left").withColumn("role", F.coalesce("to", "role")).drop("to")  # noqa: B023, E731
        new_work = kept(renamed(work).groupBy("role", "resource").agg(F.sum("n").alias("n")), "work")
        new_members = kept(renamed(members).select("activity", "role"), "members")
        dropped(work, members, best, pairs)
        work, members = new_work, new_members
