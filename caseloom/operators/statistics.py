"""Statistics of cases, activities and variants."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import business_seconds
from ..schema import cases, in_case, position, variants
from .relations import beside_activities


def variant_counts(log: DataFrame) -> DataFrame:
    """(variant, n)."""
    return variants(log).groupBy("variant").agg(F.count("*").alias("n"))


def language(log: DataFrame) -> DataFrame:
    """(variant, probability)."""
    counts = variant_counts(log)
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("variant", (F.col("n") / F.col("total")).alias("probability"))  # one row


def case_durations(log: DataFrame, business: bool = False) -> DataFrame:
    """(case_id, n_events, start_s, end_s, duration_s)."""
    span = business_seconds(F.col("first_us"), F.col("last_us")) if business else (F.col("last_us") - F.col("first_us")) / 1e6
    return cases(log).select("case_id", "n_events", (F.col("first_us") / 1e6).alias("start_s"), (F.col("last_us") / 1e6).alias("end_s"), span.alias("duration_s"))


def duration_quantiles(log: DataFrame) -> DataFrame:
    """One row: the first quartile, median and mean of the case durations."""
    return case_durations(log).agg(F.percentile("duration_s", 0.25).alias("q1_s"), F.median("duration_s").alias("median_s"), F.avg("duration_s").alias("mean_s"))


def arrival(log: DataFrame, end: bool = False) -> DataFrame:
    """One row: the mean gap between case starts (or ends) in order, which is their span over their number less one."""
    at = "last_us" if end else "first_us"
    return cases(log).agg(((F.max(at) - F.min(at)) / 1e6 / (F.count("*") - 1)).alias("mean_gap_s"))


def rework(log: DataFrame) -> DataFrame:
    """(activity, n_cases): cases in which the activity occurs more than once."""
    per_case = log.groupBy("activity", "case_id").agg(F.count("*").alias("k")).where("k > 1")
    return per_case.groupBy("activity").agg(F.count("*").alias("n_cases"))


def case_rework(log: DataFrame) -> DataFrame:
    """(case_id, n_events, n_rework: events beyond the first of each activity)."""
    return log.groupBy("case_id").agg(F.count("*").alias("n_events"), (F.count("*") - F.count_distinct("activity")).alias("n_rework"))


def sojourn(log: DataFrame) -> DataFrame:
    """(activity, n, mean_s, min_s, max_s, sum_s) of the events' own durations."""
    d = (F.col("us") - F.col("start_us")) / 1e6
    return log.groupBy("activity").agg(F.count("*").alias("n"), F.avg(d).alias("mean_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"), F.sum(d).alias("sum_s"))


def attribute_values(log: DataFrame, column: str, once_per_case: bool = False) -> DataFrame:
    """(value, n)."""
    n = F.count_distinct("case_id") if once_per_case else F.count("*")
    return log.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(n.alias("n"))


def events_distribution(log: DataFrame, unit: str = "days_week") -> DataFrame:
    """(value, n): events by day of the month, month, year, hour, day of the week (0: Monday) or ISO week, zeros filled."""
    domains = {"days_month": (1, 31), "months": (1, 12), "hours": (0, 23), "days_week": (0, 6), "weeks": (0, 52)}
    at = F.col("ts").cast("timestamp")
    value = {"days_month": F.dayofmonth(at), "months": F.month(at), "years": F.year(at), "hours": F.hour(at), "days_week": F.weekday(at), "weeks": F.weekofyear(at)}[unit]
    counts = log.groupBy(value.cast("long").alias("value")).agg(F.count("*").alias("n"))
    if unit not in domains:
        return counts
    low, high = domains[unit]
    full = log.sparkSession.range(low, high + 1).select(F.col("id").alias("value"), F.lit(0).cast("long").alias("n"))
    return counts.union(full).groupBy("value").agg(F.sum("n").alias("n"))


def case_overlap(log: DataFrame) -> DataFrame:
    """(case_id, n_open): cases open at some time of the case, itself included.

    A case overlaps those that start by its end less those that end before its start: two ranks in the order of starts
    and ends, found by a running count over one ordered union, not by comparing pairs of cases.
    """
    span = cases(log).select("case_id", "first_us", "last_us")
    marks = span.select("case_id", F.col("first_us").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("starts"), F.lit(0).alias("ends"))
    marks = marks.union(span.select("case_id", "last_us", F.lit(1), F.lit(0), F.lit(1)))
    counted = running_total(marks, ["at"], ["starts", "ends"])
    at_end = counted.where("kind = 1").select("case_id", F.col("starts_upto").alias("started"))
    at_start = counted.where("kind = 0").select("case_id", F.col("ends_before").alias("ended"))
    return at_end.join(at_start, "case_id").select("case_id", (F.col("started") - F.col("ended")).alias("n_open"))


def ranged(rows: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """rows with the number of their range, ascending with the key: ranges by approximate quantiles, equal keys in one."""
    cuts = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(key)))).drop("cuts")  # one row


def running_total(rows: DataFrame, order: list[str], columns: list[str], buckets: int = 256) -> DataFrame:
    """rows with <c>_upto (all rows at or before the row's place) and <c>_before (strictly before), without one global sort task.

    Totals of earlier ranges of the first order column are added to a window within the range.
    """
    placed = ranged(rows, order[0], buckets)
    sums = placed.groupBy("range").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most buckets rows
    base = sums.select(F.col("range").alias("r"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in columns])
    w = Window.partitionBy("range").orderBy(*order)
    upto, before = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(base), F.col("range") == F.col("r"))  # at most buckets rows
    for c in columns:
        joined = joined.withColumn(f"{c}_upto", F.sum(c).over(upto) + F.col(f"{c}_base")).withColumn(f"{c}_before", F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"{c}_base"))
    return joined.drop("range", "r", *[f"{c}_base" for c in columns])


def cycle_time(log: DataFrame, include_last: bool = False, buckets: int = 256) -> DataFrame:
    """One row: busy time (the union of all events' intervals) over the number of cases; the last stretch counts on request.

    Each interval adds what reaches beyond all that began before it: a running maximum within ranges of start times, over
    the maximum of the earlier ranges, so no task sorts all events and no stretches are kept.
    """
    rows = ranged(log.select("start_us", "us"), "start_us", buckets)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most buckets rows
    base = rows.groupBy("range").agg(F.max("us").alias("far")).select(F.col("range").alias("r"), F.max("far").over(earlier).alias("base"))
    own = F.max("us").over(Window.partitionBy("range").orderBy("start_us", "us").rowsBetween(Window.unboundedPreceding, -1))
    met = rows.join(F.broadcast(base), F.col("range") == F.col("r")).withColumn("far", F.greatest(own, "base"))  # at most buckets rows; greatest() skips nulls
    adds = F.greatest(F.col("us") - F.greatest("start_us", "far"), F.lit(0))
    begins = F.when(F.col("far").isNull() | (F.col("far") < F.col("start_us")), F.col("start_us"))
    sums = met.agg(F.sum(adds).alias("busy"), (F.max("us") - F.max(begins)).alias("last"))
    busy = F.col("busy") if include_last else F.col("busy") - F.col("last")
    return sums.crossJoin(F.broadcast(log.agg(F.count_distinct("case_id").alias("n")))).select((busy / 1e6 / F.nullif("n", F.lit(0))).alias("cycle_s"))  # one row


def kernel_density(values: DataFrame, points: int = 200) -> DataFrame:
    """(x, density) of the numbers in column ``value``: Gaussian kernels of Scott's width at ``points`` places.

    Half of the places lie evenly between the extremes, half evenly on a logarithmic scale from 1e-6 or the least value up
    (left out where the largest is below); equal places are one.  Equal values are counted first; each then adds to every
    place, summed before the shuffle.  Nulls are left out; fewer than two different values give no rows.
    """
    counts = values.where("value IS NOT NULL").groupBy(F.col("value").cast("double").alias("value")).agg(F.count("*").cast("double").alias("n"))
    frame = values.agg(F.count("value").alias("total"), F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"), F.stddev_samp("value").alias("sd")).where("high > low")
    last = max(points // 2, 2) - 1
    place = lambda f: F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.when(k == last, F.col("high")).otherwise(f(k / F.lit(last))))
    least = F.greatest("low", F.lit(1e-6))
    logarithmic = F.when(F.col("high") >= least, place(lambda t: least * F.pow(F.col("high") / least, t))).otherwise(F.array().cast("array<double>"))
    places = F.array_distinct(F.concat(place(lambda t: F.col("low") + t * (F.col("high") - F.col("low"))), logarithmic))
    grid = frame.select("total", (F.col("sd") * F.pow("total", F.lit(-0.2))).alias("h"), F.explode(places).alias("x"))
    z = (F.col("x") - F.col("value")) / F.col("h")
    met = counts.crossJoin(F.broadcast(grid))  # as many rows as points
    sums = met.groupBy("x", "total", "h").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("s"))
    return sums.select("x", (F.col("s") / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def precede_succeed(log: DataFrame, buckets: int = 256) -> DataFrame:
    """(a, b, share): of all pairs of an event of a and one of b <> a in the whole log, the share where a ends before b starts.

    Pairs in different ranges of time are products of counts; within a range running counts are taken, as in
    relations.eventually_follows(), so no pairs of events are made.
    """
    ends = log.select("activity", F.col("us").alias("at"), F.lit(1).alias("kind"))
    marks = ranged(ends.union(log.select("activity", "start_us", F.lit(0))), "at", buckets)
    # A start comes before the ends of its moment.
    w = Window.partitionBy("range", "a").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    before = F.count_if((F.col("kind") == 1) & (F.col("activity") == F.col("a"))).over(w)
    inside = beside_activities(marks, "range", "a").withColumn("n", before).where("kind = 0").groupBy("a", F.col("activity").alias("b")).agg(F.sum("n").alias("n"))
    counts = marks.groupBy("range", "activity").agg(F.count_if(F.col("kind") == 1).alias("ends"), F.count_if(F.col("kind") == 0).alias("starts"))
    x, y = counts.select(F.col("range").alias("r"), F.col("activity").alias("a"), "ends"), counts.select("range", F.col("activity").alias("b"), "starts")
    across = x.join(F.broadcast(y), F.col("r") < F.col("range")).groupBy("a", "b").agg(F.sum(F.col("ends") * F.col("starts")).alias("n"))  # buckets times the alphabet
    own = log.groupBy("activity").agg(F.count("*").alias("k"))
    total = inside.union(across).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = own.select(F.col("activity").alias("a"), F.col("k").alias("ka")).join(own.select(F.col("activity").alias("b"), F.col("k").alias("kb")), F.col("a") != F.col("b"))  # the alphabet squared
    return pairs.join(total, ["a", "b"], "left").select("a", "b", (F.coalesce("n", F.lit(0)) / (F.col("ka").cast("double") * F.col("kb"))).alias("share"))


def positions(log: DataFrame, activity: str) -> DataFrame:
    """(position, n) of an activity in its cases, from 0."""
    return log.withColumn("position", position()).where(F.col("activity") == activity).groupBy(F.col("position").cast("long").alias("position")).agg(F.count("*").alias("n"))


def variant_paths(log: DataFrame) -> DataFrame:
    """(variant, position, a, b, n, mean_s): the mean gap of each step of each variant."""
    w = in_case()
    rows = log.select("case_id", position().alias("position"), F.col("activity").alias("a"), F.lead("activity").over(w).alias("b"), ((F.lead("us").over(w) - F.col("us")) / 1e6).alias("gap"))
    return rows.where("b IS NOT NULL").join(variants(log), "case_id").groupBy("variant", F.col("position").cast("long").alias("position"), "a", "b").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_s"))


def around(log: DataFrame, activity: str, after: bool = True) -> DataFrame:
    """(activity, n, mean_s): successors (or predecessors) of an activity and the mean time to them."""
    w = in_case()
    move = F.lead if after else F.lag
    rows = log.select("activity", move("activity").over(w).alias("other"), (F.abs(move("us").over(w) - F.col("us")) / 1e6).alias("gap"))
    return rows.where((F.col("activity") == activity) & F.col("other").isNotNull()).groupBy(F.col("other").alias("activity")).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_s"))


def batches(log: DataFrame, merge_distance_s: float = 900, least: int = 2) -> DataFrame:
    """(activity, resource, start_us, end_us, n): runs of an activity by one resource with gaps of at most merge_distance_s."""
    w = Window.partitionBy("activity", "resource").orderBy("start_us", "us", "event_idx")
    far = F.max("us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(far + merge_distance_s * 1e6 >= F.col("start_us"), 0).otherwise(1)
    runs = log.where("resource IS NOT NULL").withColumn("new", new).withColumn("k", F.sum("new").over(w))
    return runs.groupBy("activity", "resource", "k").agg(F.min("start_us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n")).where(F.col("n") >= least).drop("k")


def successor_entropy(log: DataFrame) -> DataFrame:
    """(activity, entropy in bits of what follows directly, the end of the case included)."""
    w = in_case()
    counts = log.select("activity", F.coalesce(F.lead("activity").over(w), F.lit("")).alias("b")).groupBy("activity", "b").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("activity"))
    return counts.withColumn("p", share).groupBy("activity").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
