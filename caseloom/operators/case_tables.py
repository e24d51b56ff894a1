"""Further tables of features by case, event, resource and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import lagged
from ..schema import cases, in_case, position
from .filters import of_cases


def most_concurrent(log: DataFrame, by_activity: bool = False) -> DataFrame:
    """(case_id[, activity], n): the largest number of later events that begin by the end of one (events in order of their starts).

    Starts and ends stand in one order: the starts up to an event's end, less those up to its own, are its later ones.
    """
    keys = ["case_id", "activity"] if by_activity else ["case_id"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("start_us", "event_idx"))
    marks = log.withColumn("rank", rank).select(*keys, F.inline(F.array(F.struct(F.col("start_us").alias("at"), F.lit(0).alias("end"), F.lit(None).cast("int").alias("own")), F.struct(F.col("us").alias("at"), F.lit(1).alias("end"), F.col("rank").alias("own")))))
    so_far = F.sum(1 - F.col("end")).over(Window.partitionBy(*keys).orderBy("at", "end"))
    return marks.withColumn("n", so_far - F.col("own")).groupBy(*keys).agg(F.max("n").alias("n"))


def resource_workload(log: DataFrame) -> DataFrame:
    """(case_id, resource, n): cases with the resource whose time from first to last event meets that of the case."""
    spans = log.where("resource IS NOT NULL").select("case_id", "resource").distinct().join(cases(log).select("case_id", "first_us", "last_us"), "case_id")
    begin = F.struct(F.col("first_us").alias("at"), F.lit(0).alias("kind"))
    end = F.struct(F.col("last_us").alias("at"), F.lit(1).alias("kind"))
    marks = spans.select("case_id", "resource", F.inline(F.array(begin, end)))
    w = Window.partitionBy("resource").orderBy("at", "kind")
    began = F.sum(1 - F.col("kind")).over(w)
    ended = F.sum("kind").over(Window.partitionBy("resource").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    rows = marks.select("case_id", "resource", "kind", began.alias("began"), F.coalesce(ended, F.lit(0)).alias("ended"))
    return rows.groupBy("case_id", "resource").agg((F.max(F.when(F.col("kind") == 1, F.col("began"))) - F.max(F.when(F.col("kind") == 0, F.col("ended")))).alias("n"))


def occurrence_times(log: DataFrame) -> DataFrame:
    """(case_id, activity, first_index, last_index, since_first_s, since_last_s): places in the case, and times to its end."""
    rows = log.select("case_id", "activity", "us", position().alias("p"), F.max("us").over(Window.partitionBy("case_id")).alias("end_us"))
    gap = lambda f: ((F.max("end_us") - f("us")) / 1e6)
    return rows.groupBy("case_id", "activity").agg(F.min("p").alias("first_index"), F.max("p").alias("last_index"), gap(F.min).alias("since_first_s"), gap(F.max).alias("since_last_s"))


def last_path_times(log: DataFrame) -> DataFrame:
    """(case_id, a, b, seconds): of each directly-follows step of a case the time it took when it came last."""
    w = in_case()
    rows = log.select("case_id", F.col("activity").alias("a"), F.lead("activity").over(w).alias("b"), ((F.lead("us").over(w) - F.col("us")) / 1e6).alias("s"), position().alias("p"))
    return rows.where("b IS NOT NULL").groupBy("case_id", "a", "b").agg(F.max_by("s", "p").alias("seconds"))


def event_table(log: DataFrame) -> DataFrame:
    """(case_id, event_idx, place, since_start_s, since_last_s, to_end_s): numbers of each event."""
    whole = Window.partitionBy("case_id")
    gap = lambda x, y: (x - y) / 1e6
    return log.select(
        "case_id", "event_idx", position().alias("place"), gap(F.col("us"), F.min("us").over(whole)).alias("since_start_s"),
        gap(F.col("us"), F.coalesce(F.lag("us").over(in_case()), F.col("us"))).alias("since_last_s"), gap(F.max("us").over(whole), F.col("us")).alias("to_end_s"),
    )


def temporal_features(log: DataFrame, unit: str = "week") -> DataFrame:
    """(bucket, n_events, n_cases, n_resources, n_activities, n_started, n_ended) of each week, day or the like."""
    at = lambda c: F.date_trunc(unit, F.timestamp_micros(c))
    rows = log.groupBy(at("us").alias("bucket")).agg(F.count("*").alias("n_events"), F.count_distinct("case_id").alias("n_cases"), F.count_distinct("resource").alias("n_resources"), F.count_distinct("activity").alias("n_activities"))
    own = cases(log)
    for c, name in (("first_us", "n_started"), ("last_us", "n_ended")):
        rows = rows.join(own.groupBy(at(c).alias("bucket")).agg(F.count("*").alias(name)), "bucket", "left")
    return rows.na.fill(0, ["n_started", "n_ended"])


def with_ends(log: DataFrame, start: str = "▶", end: str = "■") -> DataFrame:
    """(case_id, activity, us, event_idx): the log with an artificial first and last event in each case."""
    own = cases(log)
    made = own.select("case_id", F.inline(F.array(
        F.struct(F.lit(start).alias("activity"), (F.col("first_us") - 1).alias("us"), F.lit(-1).cast("long").alias("event_idx")),
        F.struct(F.lit(end).alias("activity"), (F.col("last_us") + 1).alias("us"), F.lit(-2).cast("long").alias("event_idx")),
    )))
    return log.select("case_id", "activity", "us", "event_idx").unionByName(made)


def partitions(log: DataFrame, parts: int) -> DataFrame:
    """The log with part, from 0 to parts - 1: a hash of the case, so that cases stay whole."""
    return log.withColumn("part", F.pmod(F.crc32(F.col("case_id").cast("string").cast("binary")), F.lit(parts)))


def sample_cases(log: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """The cases whose hash lies below the share: reruns agree, and nothing is sorted."""
    h = F.crc32(F.concat(F.lit(f"{seed} "), F.col("case_id").cast("string")).cast("binary"))
    return log.where(F.pmod(h, F.lit(10_000)) < share * 10_000)


def sample_events(log: DataFrame, share: float, seed: int = 0) -> DataFrame:
    h = F.crc32(F.concat(F.lit(f"{seed} "), F.col("event_idx").cast("string")).cast("binary"))
    return log.where(F.pmod(h, F.lit(10_000)) < share * 10_000)


def to_lifecycle(log: DataFrame) -> DataFrame:
    """(case_id, activity, us, transition, event_idx): a start and a complete row for each event with its interval."""
    return log.select("case_id", "activity", "event_idx", F.inline(F.array(F.struct(F.col("start_us").alias("us"), F.lit("start").alias("transition")), F.struct(F.col("us").alias("us"), F.lit("complete").alias("transition")))))


def to_intervals(rows: DataFrame) -> DataFrame:
    """(case_id, activity, start_us, us): completes of lifecycle rows, each with the start of its rank among the activity's in the case."""
    rank = F.row_number().over(Window.partitionBy("case_id", "activity", "transition").orderBy("us", "event_idx"))
    ranked = rows.withColumn("k", rank)
    done = ranked.where("transition = 'complete'").select("case_id", "activity", "k", "us")
    begun = ranked.where("transition = 'start'").select("case_id", "activity", "k", F.col("us").alias("start_us"))
    return done.join(begun, ["case_id", "activity", "k"], "left").select("case_id", "activity", F.coalesce("start_us", "us").alias("start_us"), "us")


def open_paths(log: DataFrame) -> DataFrame:
    """(case_id, a, b, from_us, to_us): the time between an event and the next one of its case, where it is not zero."""
    w = in_case()
    rows = log.select("case_id", F.col("activity").alias("a"), F.lead("activity").over(w).alias("b"), F.col("us").alias("from_us"), F.lead("us").over(w).alias("to_us"))
    return rows.where("to_us > from_us")


def performance_spectrum(log: DataFrame, activities: Sequence[str]) -> DataFrame:
    """(case_id, times): where the events of these activities hold the whole sequence in a row, the times of each."""
    rows = log.where(F.col("activity").isin(list(activities)))
    w = in_case()
    met, times = F.lit(True), []
    for k, name in enumerate(activities):
        met = met & (F.lead("activity", k).over(w) == name)
        times.append(F.lead("us", k).over(w))
    return rows.select("case_id", F.coalesce(met, F.lit(False)).alias("met"), F.array(*times).alias("times")).where("met").drop("met")


def traces_with_attribute_in_time(log: DataFrame, column: str, value: object, low_us: int, high_us: int) -> DataFrame:
    """The cases with an event that has the value between two times."""
    return of_cases(log, log.where((F.col(column) == value) & F.col("us").between(low_us, high_us)).select("case_id").distinct())


def case_rates(log: DataFrame) -> DataFrame:
    """(case_id, service_s, arrival_rank): the summed lengths of a case's events, and its rank among the cases that begin on its day."""
    day = F.date_trunc("day", F.timestamp_micros("first_us"))
    own = cases(log).select("case_id", "first_us", day.alias("day"))
    service = log.groupBy("case_id").agg((F.sum(F.col("us") - F.col("start_us")) / 1e6).alias("service_s"))
    return own.join(service, "case_id").select("case_id", "service_s", F.row_number().over(Window.partitionBy("day").orderBy("first_us", "case_id")).alias("arrival_rank"))


def case_arrivals(log: DataFrame) -> DataFrame:
    """(case_id, arrival_s, finish_s): the time from the case before, in the order of the cases' first starts (ends) and ids; 0 for the first.

    Cases are ordered in ranges, so no task sorts them all.
    """
    spans = log.groupBy("case_id").agg(F.min("start_us").alias("begin"), F.max("us").alias("finish"))
    since = lambda c: (F.col(c) - F.coalesce("before", c)) / 1e6
    arrival = lagged(spans.select("case_id", "begin"), "begin", "begin", "case_id").select("case_id", since("begin").alias("arrival_s"))
    finish = lagged(spans.select("case_id", "finish"), "finish", "finish", "case_id").select("case_id", since("finish").alias("finish_s"))
    return arrival.join(finish, "case_id")


def resource_durations(log: DataFrame) -> DataFrame:
    """(resource, activity, n, mean_s): how long activities take a resource, from the event before to its own."""
    took = (F.col("us") - F.lag("us").over(in_case())) / 1e6
    rows = log.select("resource", "activity", took.alias("s")).where("resource IS NOT NULL AND s IS NOT NULL")
    return rows.groupBy("resource", "activity").agg(F.count("*").alias("n"), F.avg("s").alias("mean_s"))


def resource_case_durations(log: DataFrame) -> DataFrame:
    """(resource, n_cases, mean_s): the duration of the cases that a resource takes part in."""
    own = log.where("resource IS NOT NULL").select("case_id", "resource").distinct()
    rows = own.join(cases(log).select("case_id", ((F.col("last_us") - F.col("first_us")) / 1e6).alias("s")), "case_id")
    return rows.groupBy("resource").agg(F.count("*").alias("n_cases"), F.avg("s").alias("mean_s"))


def roles(log: DataFrame) -> DataFrame:
    """(resources, activities, n_events): activities that the same set of resources does form a role."""
    by = log.where("resource IS NOT NULL").groupBy("activity").agg(F.array_sort(F.collect_set("resource")).alias("resources"), F.count("*").alias("n"))
    return by.groupBy(F.array_join("resources", ",").alias("resources")).agg(F.array_join(F.array_sort(F.collect_list("activity")), ",").alias("activities"), F.sum("n").alias("n_events"))


def threshold(counts: DataFrame, factor: float) -> DataFrame:
    """(threshold): of counts (n), the largest reached from the top by steps that each keep more than ``factor`` of the one before."""
    w = Window.orderBy(F.desc("n"))  # a row for each activity
    rows = counts.select("n", F.lag("n").over(w).alias("before"))
    broken = F.max(F.when(F.col("n") <= F.col("before") * factor, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("cut", broken).where("cut IS NULL OR n > cut").agg(F.min("n").alias("threshold"))
