"""Event- and case-level filters.  Case filters are semi or anti joins on the case, so they keep every event column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import business_seconds
from ..schema import cases, in_case, position, trace, unused, variants


def of_cases(log: DataFrame, chosen: DataFrame, keep: bool = True) -> DataFrame:
    """The events of the chosen cases, or of the others."""
    return log.join(chosen.select("case_id").distinct(), "case_id", "left_semi" if keep else "left_anti")


def events_with(log: DataFrame, column: str, values: Sequence, keep: bool = True) -> DataFrame:
    hit = F.col(column).isin(list(values))
    return log.where(hit if keep else ~F.coalesce(hit, F.lit(False)))


def cases_with(log: DataFrame, column: str, values: Sequence, keep: bool = True) -> DataFrame:
    return of_cases(log, log.where(F.col(column).isin(list(values))), keep)


def events_between(log: DataFrame, column: str, low: object, high: object, keep: bool = True) -> DataFrame:
    hit = F.col(column).between(low, high)
    return log.where(hit if keep else ~F.coalesce(hit, F.lit(False)))


def cases_between(log: DataFrame, column: str, low: object, high: object, keep: bool = True, **equal: object) -> DataFrame:
    """Cases with an event in range that also has the given values in other columns."""
    hit = F.col(column).between(low, high)
    for name, value in equal.items():
        hit = hit & (F.col(name) == value)
    return of_cases(log, log.where(hit), keep)


def frequent_activities(log: DataFrame, least: int) -> DataFrame:
    """Events of activities that occur at least so often."""
    return log.join(log.groupBy("activity").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("activity"), "activity", "left_semi").select(log.columns)


def top_activities(log: DataFrame, most: int) -> DataFrame:
    """Events of the most frequent activities, ties by name."""
    top = log.groupBy("activity").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "activity").limit(most)
    return log.join(top.select("activity"), "activity", "left_semi").select(log.columns)


def relative_occurrence(log: DataFrame, column: str, share: float, by_case: bool = True) -> DataFrame:
    """Events whose value occurs in at least a share of the cases, or of the events."""
    unit = F.count_distinct("case_id") if by_case else F.count("*")
    total = log.agg(unit.alias("total"))
    values = log.groupBy(column).agg(unit.alias("k")).crossJoin(F.broadcast(total)).where(F.col("k") >= F.col("total") * share)  # one row
    return log.join(values.select(column), column, "left_semi").select(log.columns)


def starting_with(log: DataFrame, activities: Sequence[str], keep: bool = True) -> DataFrame:
    return of_cases(log, cases(log).where(F.col("first_activity").isin(list(activities))), keep)


def ending_with(log: DataFrame, activities: Sequence[str], keep: bool = True) -> DataFrame:
    return of_cases(log, cases(log).where(F.col("last_activity").isin(list(activities))), keep)


def frequent_ends(log: DataFrame, least: int, end: str = "first_activity") -> DataFrame:
    """Cases whose first (or last) activity is that of at least so many cases."""
    found = cases(log)
    often = found.groupBy(end).agg(F.count("*").alias("k")).where(F.col("k") >= least)
    return of_cases(log, found.join(often, end, "left_semi"))


def cases_in_time(log: DataFrame, low_us: int, high_us: int, mode: str = "contained") -> DataFrame:
    """contained and starting/completing include the bounds; intersecting compares strictly."""
    first, last = F.col("first_us"), F.col("last_us")
    inside = lambda c: (c > low_us) & (c < high_us)
    hit = {
        "contained": (first >= low_us) & (last <= high_us),
        "intersecting": inside(first) | inside(last) | ((first < low_us) & (last > high_us)),
        "starting": first.between(low_us, high_us),
        "completing": last.between(low_us, high_us),
    }[mode]
    return of_cases(log, cases(log).where(hit))


def largest_cases(log: DataFrame, most: int) -> DataFrame:
    return of_cases(log, cases(log).orderBy(F.desc("n_events"), "case_id").limit(most))


def case_size(log: DataFrame, low: int, high: int | None = None) -> DataFrame:
    hit = F.col("n_events") >= low
    return of_cases(log, cases(log).where(hit if high is None else hit & (F.col("n_events") <= high)))


def case_duration(log: DataFrame, low_s: float, high_s: float, business: bool = False) -> DataFrame:
    span = business_seconds(F.col("first_us"), F.col("last_us")) if business else (F.col("last_us") - F.col("first_us")) / 1e6
    return of_cases(log, cases(log).where(span.between(low_s, high_s)))


def _variant(activities: Sequence[str]) -> Column:
    return F.array(*map(F.lit, activities))


def with_variants(log: DataFrame, admitted: Sequence[Sequence[str]], keep: bool = True) -> DataFrame:
    hit = F.lit(False)
    for v in admitted:
        hit = hit | (F.col("variant") == _variant(v))
    return of_cases(log, variants(log).where(hit), keep)


def top_variants(log: DataFrame, k: int) -> DataFrame:
    """The k most frequent variants, of equals the later in order."""
    found = variants(log)
    top = found.groupBy("variant").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("variant")).limit(k)
    return of_cases(log, found.join(top, "variant", "left_semi"))


def variant_coverage(log: DataFrame, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Variants whose share of the cases lies within the bounds."""
    found = variants(log)
    counts = found.groupBy("variant").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ok = counts.crossJoin(F.broadcast(total)).where((F.col("n") >= least * F.col("total")) & (F.col("n") <= most * F.col("total")))  # one row
    return of_cases(log, found.join(ok, "variant", "left_semi"))


def with_path(log: DataFrame, pairs: Sequence[tuple[str, str]], keep: bool = True, low_s: float | None = None, high_s: float | None = None) -> DataFrame:
    """Cases in which one of the pairs follow each other directly, within low_s..high_s seconds if given."""
    step = log.withColumn("next_activity", F.lead("activity").over(in_case())).withColumn("gap", (F.lead("us").over(in_case()) - F.col("us")) / 1e6)
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | ((F.col("activity") == a) & (F.col("next_activity") == b))
    if low_s is not None:
        hit = hit & F.col("gap").between(low_s, high_s)
    return of_cases(log, step.where(hit), keep)


def eventually_follows(log: DataFrame, chain: Sequence[str], keep: bool = True) -> DataFrame:
    """Cases that hold the chain of activities at growing positions: one pass of each trace."""
    found = variants(log)
    want = _variant(chain)
    reached = F.aggregate("variant", F.lit(0), lambda k, a: F.when((k < len(chain)) & (F.get(want, k) == a), k + 1).otherwise(k))
    return of_cases(log, found.where(reached == len(chain)), keep)


def directly_chained(log: DataFrame, a: str, b: str, c: str, keep: bool = True) -> DataFrame:
    """Cases where a stands right before the case's last b, and that right before its last c."""
    at = log.withColumn("p", position()).groupBy("case_id").agg(
        F.max(F.when(F.col("activity") == b, F.col("p"))).alias("pb"), F.max(F.when(F.col("activity") == c, F.col("p"))).alias("pc"), trace().alias("t")
    )
    hit = (F.col("pc") == F.col("pb") + 1) & (F.col("pb") >= 1) & (F.get("t", F.col("pb") - 1) == a)
    return of_cases(log, at.where(F.coalesce(hit, F.lit(False))), keep)


def four_eyes(log: DataFrame, a: str, b: str, keep: bool = True) -> DataFrame:
    """Cases where some a has another resource than the last b and none the same (keep), or some a has the same."""
    by_case = log.groupBy("case_id").agg(
        F.max_by("resource", F.when(F.col("activity") == b, F.struct("us", "event_idx"))).alias("rb"),
        F.max(F.when(F.col("activity") == b, F.lit(1))).alias("has_b"),
        F.collect_set(F.when(F.col("activity") == a, F.col("resource"))).alias("ra"),
    ).where("has_b = 1 AND size(ra) > 0")
    same = F.array_contains("ra", F.col("rb"))
    return of_cases(log, by_case.where(~same if keep else same))


def different_persons(log: DataFrame, a: str, keep: bool = True) -> DataFrame:
    """Cases where an activity was done by more than one resource."""
    found = log.where(F.col("activity") == a).groupBy("case_id").agg(F.count_distinct("resource").alias("k")).where("k > 1")
    return of_cases(log, found, keep)


def value_repeats(log: DataFrame, column: str, value: object, low: int, high: int | None = None, keep: bool = True) -> DataFrame:
    """Cases with so many events of a value; with column activity this is the rework filter."""
    found = log.where(F.col(column) == value).groupBy("case_id").agg(F.count("*").alias("k"))
    return of_cases(log, found.where((F.col("k") >= low) & (F.col("k") <= high if high is not None else F.lit(True))), keep)


def prefixes(log: DataFrame, activity: str, first: bool = True, strict: bool = True) -> DataFrame:
    """Events before (not strict: up to) the first or last occurrence; cases without it go."""
    return _cut(log, activity, first, strict, before=True)


def suffixes(log: DataFrame, activity: str, first: bool = True, strict: bool = True) -> DataFrame:
    """Events after (not strict: from) the first or last occurrence; cases without it go."""
    return _cut(log, activity, first, strict, before=False)


def _cut(log: DataFrame, activity: str, first: bool, strict: bool, before: bool) -> DataFrame:
    at = F.when(F.col("activity") == activity, F.struct("us", "event_idx"))
    own = Window.partitionBy("case_id")
    edge = F.min(at).over(own) if first else F.max(at).over(own)
    here = F.struct("us", "event_idx")
    name = unused(log, "edge")
    marked, at_edge = log.withColumn(name, edge), F.col(name)
    hit = (here < at_edge) if before else (here > at_edge)
    return marked.where(hit if strict else hit | (here == at_edge)).drop(name)


def split_at(log: DataFrame, activity: str, at_next: bool = False) -> DataFrame:
    """Sub-cases cut at each occurrence of an activity (or after it); case ids get ##@@ and a number."""
    hit = F.when(F.col("activity") == activity, 1).otherwise(0)
    upto = F.sum(hit).over(in_case().rowsBetween(Window.unboundedPreceding, -1 if at_next else 0))
    return log.withColumn("case_id", F.concat_ws("##@@", F.col("case_id").cast("string"), F.coalesce(upto, F.lit(0)).cast("string")))


def between(log: DataFrame, a: str, b: str) -> DataFrame:
    """Sub-cases from each a to the next b; an a inside an open sub-case doesn't begin another."""
    hits = F.when(F.col("activity").isin(a, b), F.col("activity"))
    w = in_case()
    names = {k: unused(log, k) for k in ("before", "k", "last_b")}
    before, k, last_b = map(F.col, names.values())
    begins = (F.col("activity") == a) & F.coalesce(before != a, F.lit(True))
    opened = log.withColumn(names["before"], F.last(hits, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.max(F.when(F.col("activity") == b, F.struct("us", "event_idx"))).over(Window.partitionBy("case_id"))
    numbered = opened.withColumns({names["k"]: F.sum(F.when(begins, 1).otherwise(0)).over(w), names["last_b"]: last})
    inside = ((before == a) | begins) & (F.struct("us", "event_idx") <= last_b)
    chosen = numbered.where(F.coalesce(inside, F.lit(False)) & (k > 0))
    return chosen.withColumn("case_id", F.concat_ws("##@@", F.col("case_id").cast("string"), (k - 1).cast("string"))).drop(*names.values())


def starts_with(log: DataFrame, prefix: Sequence[str], keep: bool = True) -> DataFrame:
    return of_cases(log, variants(log).where(F.slice("variant", 1, len(prefix)) == _variant(prefix)), keep)


def ends_with(log: DataFrame, suffix: Sequence[str], keep: bool = True) -> DataFrame:
    found = variants(log).where(F.size("variant") >= len(suffix))
    return of_cases(log, found.where(F.slice("variant", -len(suffix), len(suffix)) == _variant(suffix)), keep)


def trace_pattern(log: DataFrame, pattern: Sequence[str], keep: bool = True) -> DataFrame:
    """Cases whose trace holds the activities one after another; ``...`` stands for any activities between."""
    import re

    mark = "\x1f"
    parts = ["(?:[^\x1f]*\x1f)*" if p == "..." else re.escape(p) + mark for p in pattern]
    text = F.concat(F.lit(mark), F.array_join("variant", mark), F.lit(mark))
    return of_cases(log, variants(log).where(text.rlike(mark + "".join(parts))), keep)


def collapse_runs(log: DataFrame, keep_first: bool = True) -> DataFrame:
    """Of events of one activity in a row, the first or the last."""
    other = F.lag("activity").over(in_case()) if keep_first else F.lead("activity").over(in_case())
    name = unused(log, "other")
    return log.withColumn(name, other).where(F.coalesce(F.col(name) != F.col("activity"), F.lit(True))).drop(name)


def collapse_times(log: DataFrame, how: str = "concat") -> DataFrame:
    """One event (case_id, us, activity) per case and time: first, last, or the activities joined in order by `` & ``."""
    at = F.col("event_idx")
    chosen = {"first": F.min_by("activity", at), "last": F.max_by("activity", at), "concat": F.array_join(F.array_sort(F.collect_list("activity")), " & ")}[how]
    return log.groupBy("case_id", "us").agg(chosen.alias("activity"))
