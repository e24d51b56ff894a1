"""Directly- and eventually-follows relations, triples, concurrency and endpoints of a canonical event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import business_seconds
from ..schema import cases, in_case


def steps(log: DataFrame, window: int = 1) -> DataFrame:
    """(case_id, a, b, gap in seconds from a's end to b's start, end_us, start_us) of events a window apart."""
    w = in_case()
    rows = log.select(
        "case_id",
        F.col("activity").alias("a"),
        F.lead("activity", window).over(w).alias("b"),
        F.col("us").alias("end_us"),
        F.lead("start_us", window).over(w).alias("start_us"),
        F.col("resource").alias("ra"),
        F.lead("resource", window).over(w).alias("rb"),
    ).where("b IS NOT NULL")
    return rows.withColumn("gap", F.greatest(F.col("start_us") - F.col("end_us"), F.lit(0)) / 1e6)


def dfg(log: DataFrame, window: int = 1, once_per_case: bool = False) -> DataFrame:
    """(a, b, n): how often b follows a directly, or in how many cases."""
    return steps(log, window).groupBy("a", "b").agg((F.count_distinct("case_id") if once_per_case else F.count("*")).alias("n"))


def performance_dfg(log: DataFrame, business: bool = False) -> DataFrame:
    """(a, b, n, mean_s, min_s, max_s, sum_s, stdev_s, median_s) of the times between; stdev of one time is null."""
    rows = steps(log)
    gap = business_seconds(F.col("end_us"), F.col("start_us")) if business else F.col("gap")
    return rows.withColumn("g", gap).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.avg("g").alias("mean_s"), F.min("g").alias("min_s"), F.max("g").alias("max_s"), F.sum("g").alias("sum_s"), F.stddev_samp("g").alias("stdev_s"), F.median("g").alias("median_s")
    )


def triples(log: DataFrame) -> DataFrame:
    """(a, b, c, n): how often three activities follow each other."""
    w = in_case()
    rows = log.select(F.col("activity").alias("a"), F.lead("activity", 1).over(w).alias("b"), F.lead("activity", 2).over(w).alias("c"))
    return rows.where("c IS NOT NULL").groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def later_pairs(log: DataFrame, first_only: bool = False) -> DataFrame:
    """(case_id, a, b, gap) of all pairs i < j of a case's events with end_i <= start_j.

    The number of pairs grows with the square of a case's length by the definition; aggregations over it should be
    preferred to it (eventually_follows() and first_following() make no pairs).
    """
    seq = log.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_idx", "activity", "start_us"))).alias("t"))
    left = seq.select("case_id", "t", F.posexplode("t").alias("i", "x"))
    after = F.filter(F.slice("t", F.col("i") + 2, F.size("t")), lambda y: y["start_us"] >= F.col("x.us"))
    rows = left.select("case_id", "x", "i", F.explode(after).alias("y"))
    out = rows.select("case_id", "i", F.col("x.activity").alias("a"), F.col("y.activity").alias("b"), ((F.col("y.start_us") - F.col("x.us")) / 1e6).alias("gap"))
    if first_only:
        out = out.groupBy("case_id", "i", "a", "b").agg(F.min("gap").alias("gap"))
    return out.drop("i")


def beside_activities(log: DataFrame, group: str, name: str) -> DataFrame:
    """Each row once for every activity (``name``) of its group: one shuffle, and no list of activities is needed."""
    marked = log.withColumn(name, F.collect_set("activity").over(Window.partitionBy(group)))
    return marked.select(*log.columns, F.explode(name).alias(name))


def eventually_follows(log: DataFrame) -> DataFrame:
    """(a, b, n): pairs i < j of a case, for atomic events: running counts instead of pairs.

    Each event of b adds the number of events a before it, so the work is the events times the activities of their case.
    """
    w = Window.partitionBy("case_id", "a").orderBy("us", "event_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.count_if(F.col("activity") == F.col("a")).over(w)
    rows = beside_activities(log.select("case_id", "activity", "us", "event_idx"), "case_id", "a").select("a", F.col("activity").alias("b"), before.alias("n"))
    return rows.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))


def first_following(log: DataFrame) -> DataFrame:
    """(case_id, event_idx, a, b, gap): for each event and activity b the time to the next b of its case, if there is one.

    Runs from the end of the case, so that each frame grows by one row; atomic events.
    """
    w = Window.partitionBy("case_id", "b").orderBy(F.desc("us"), F.desc("event_idx")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("activity") == F.col("b"), F.col("us")), ignorenulls=True).over(w)
    rows = beside_activities(log.select("case_id", "activity", "us", "event_idx"), "case_id", "b").withColumn("next_us", after)
    return rows.where("next_us IS NOT NULL").select("case_id", "event_idx", F.col("activity").alias("a"), "b", ((F.col("next_us") - F.col("us")) / 1e6).alias("gap"))


def concurrent_pairs(log: DataFrame, strict: bool = False) -> DataFrame:
    """(a, b, n): unordered pairs of events of a case whose intervals [start, end] overlap; both directions are summed."""
    x, y = log.alias("x"), log.alias("y")
    meet = F.least("x.us", "y.us") - F.greatest("x.start_us", "y.start_us")
    earlier = F.struct("x.us", "x.event_idx") < F.struct("y.us", "y.event_idx")
    rows = x.join(y, (F.col("x.case_id") == F.col("y.case_id")) & earlier & (meet > 0 if strict else meet >= 0))
    return rows.groupBy(F.least("x.activity", "y.activity").alias("a"), F.greatest("x.activity", "y.activity").alias("b")).agg(F.count("*").alias("n"))


def endpoints(log: DataFrame, end: str = "first_activity") -> DataFrame:
    """(activity, n) of the first or last events of the cases."""
    return cases(log).groupBy(F.col(end).alias("activity")).agg(F.count("*").alias("n"))


def case_attribute_edges(log: DataFrame, column: str) -> DataFrame:
    """(a, b, value, n): directly-follows edges by the value of a column at their first event."""
    w = in_case()
    rows = log.select(F.col("activity").alias("a"), F.lead("activity").over(w).alias("b"), F.col(column).alias("value"))
    return rows.where("b IS NOT NULL").groupBy("a", "b", "value").agg(F.count("*").alias("n"))


def footprints(log: DataFrame) -> DataFrame:
    """(a, b, relation) of pairs that follow directly: sequence if only one way, parallel if both."""
    edges = dfg(log)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("back"))
    return edges.join(back, ["a", "b"], "left").select("a", "b", F.when(F.col("back") == 1, "parallel").otherwise("sequence").alias("relation"))


def causal(log: DataFrame) -> DataFrame:
    """(a, b, dependency): (ab - ba) / (ab + ba + 1) for each edge."""
    edges = dfg(log)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    m = F.coalesce("m", F.lit(0))
    return edges.join(back, ["a", "b"], "left").select("a", "b", ((F.col("n") - m) / (F.col("n") + m + 1)).alias("dependency"))


def temporal_profile(log: DataFrame) -> DataFrame:
    """(a, b, n, mean_s, stdev_s) of the gaps of all later pairs (see later_pairs()); the deviation of one gap is 0.

    No row per pair is made: an event's end tells its time once, its start hears the ends before it of each activity of the case,
    as number, sum and sum of squares that run along the case.  A case needs its events times its activities, sorted.
    """
    end = F.struct(F.col("us").alias("at"), F.col("place").alias("turn"), F.lit(1).alias("ends"))
    never = F.lit((1 << 31) - 1)
    start = F.struct(F.col("start_us").alias("at"), F.when(F.col("start_us") < F.col("us"), never).otherwise(F.col("place")).alias("turn"), F.lit(0).alias("ends"))
    rows = log.select("case_id", "activity", "us", "start_us", F.row_number().over(in_case()).alias("place"), F.collect_set("activity").over(Window.partitionBy("case_id")).alias("names"), F.min("us").over(Window.partitionBy("case_id")).alias("base"))
    marks = rows.select("case_id", "activity", "names", "base", F.inline(F.array(start, end)))
    heard = marks.select("case_id", "activity", "at", "turn", "ends", (F.col("at") - F.col("base")).alias("t"), F.explode(F.when(F.col("ends") == 1, F.array("activity")).otherwise(F.col("names"))).alias("a"))
    return _gap_profile(heard, F.col("ends") == 1, "at", "turn", "ends", asks=F.col("ends") == 0)


def point_profile(log: DataFrame) -> DataFrame:
    """temporal_profile() of a log of events without length: half as many rows, the ends being the starts."""
    named = beside_activities(log.select("case_id", "activity", "us", "event_idx", (F.col("us") - F.min("us").over(Window.partitionBy("case_id"))).alias("t")), "case_id", "a")
    return _gap_profile(named, F.col("activity") == F.col("a"), "us", "event_idx")


def _gap_profile(rows: DataFrame, told: Column, *order: str, asks: Column | None = None) -> DataFrame:
    """The profile of rows (case_id, a, activity, t) in an order: each that asks hears those that told before it.

    Squares are taken in decimals, as a long case's cancel out but for a few digits.
    """
    w = Window.partitionBy("case_id", "a").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("t").cast("decimal(19,0)")
    sums = {"n": F.count_if(told).over(w), "s": F.sum(F.when(told, F.col("t"))).over(w), "q": F.sum(F.when(told, t * t)).over(w)}
    rows = rows.withColumns(sums)
    rows = rows.where("n > 0" if asks is None else asks & (F.col("n") > 0))
    n = F.col("n").cast("decimal(18,0)")
    gaps = F.col("n") * F.col("t") - F.col("s")
    squares = (n * (t * t) - 2 * (t * F.col("s").cast("decimal(19,0)")) + F.col("q")).cast("double")
    out = rows.select("a", F.col("activity").alias("b"), "n", (gaps / 1e6).alias("s"), (squares / 1e12).alias("q")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))).otherwise(0.0)
    return out.select("a", "b", "n", (F.col("s") / F.col("n")).alias("mean_s"), spread.alias("stdev_s"))


def temporal_deviations(log: DataFrame, profile: DataFrame, zeta: float) -> DataFrame:
    """(case_id, a, b, gap, score): gaps beyond mean +- zeta * stdev; the score is null where stdev is 0.

    Pairs are compared inside a case's array, where the profile's rows of the case's activities come as maps by b and a, so that only
    deviations become rows and no pair is shuffled.  Cases meet the profile by their activities alone: rows that hold a case's array are
    as many times larger than the files let Spark guess, and must be neither shuffled nor broadcast.
    """
    seq = log.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_idx", "activity", "start_us"))).alias("t"))
    of_b = profile.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("a", F.struct("mean_s", "stdev_s")))).alias("of"))  # the alphabet
    held = log.groupBy("case_id").agg(F.collect_set("activity").alias("names")).select("case_id", "names", F.explode("names").alias("b"))
    own = held.join(of_b.hint("merge"), "b").select("case_id", "b", F.map_filter("of", lambda a, _: F.array_contains("names", a)).alias("of"))
    of = own.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "of"))).alias("of"))  # a case's alphabet squared
    rows = seq.join(of.hint("merge"), "case_id").select("case_id", "of", "t", F.posexplode("t").alias("i", "x")).where("i > 0")
    rows = rows.withColumn("b", F.col("x.activity")).withColumn("of", F.try_element_at("of", F.col("b")))
    gap = lambda y: (F.col("x.start_us") - y["us"]) / 1e6
    row_of = lambda y: F.try_element_at("of", y["activity"])
    beyond = lambda y: (y["us"] <= F.col("x.start_us")) & (F.abs(gap(y) - row_of(y)["mean_s"]) > zeta * row_of(y)["stdev_s"])
    found = rows.select("case_id", "b", "of", "x", F.explode(F.filter(F.slice("t", 1, F.col("i")), beyond)).alias("y"))
    y = F.col("y")
    rows = found.select("case_id", y["activity"].alias("a"), "b", gap(y).alias("gap"), row_of(y)["mean_s"].alias("m"), row_of(y)["stdev_s"].alias("s"))
    return rows.select("case_id", "a", "b", "gap", F.when(F.col("s") > 0, F.abs(F.col("gap") - F.col("m")) / F.col("s")).alias("score"))


def self_distance(log: DataFrame) -> DataFrame:
    """(activity, distance): the fewest events between two occurrences of it in a case, of activities that repeat."""
    w = in_case()
    rows = log.select("case_id", "activity", "us", "event_idx", F.row_number().over(w).alias("p"))
    gap = F.lead("p").over(Window.partitionBy("case_id", "activity").orderBy("p")) - F.col("p") - 1
    return rows.select("activity", gap.alias("gap")).where("gap IS NOT NULL").groupBy("activity").agg(F.min("gap").alias("distance"))


def witnesses(log: DataFrame) -> DataFrame:
    """(activity, witness): activities between two occurrences at the activity's minimal self distance."""
    seq = log.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_idx", "activity"))), lambda x: x["activity"]).alias("t"))
    rows = seq.select("case_id", "t", F.posexplode("t").alias("p", "activity"))
    nxt = F.lead("p").over(Window.partitionBy("case_id", "activity").orderBy("p"))
    spans = rows.withColumn("q", nxt).where("q IS NOT NULL").withColumn("d", F.col("q") - F.col("p") - 1)
    best = spans.join(self_distance(log), "activity").where("d = distance AND d > 0")
    return best.select("activity", F.explode(F.slice("t", F.col("p") + 2, F.col("d"))).alias("witness")).distinct()
