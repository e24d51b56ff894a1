"""Matching without case ids: variants with the nearest of another log, times of one activity with times of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import nearest_of_blocks
from ..functions.order import indexed, ranged
from ..functions.tables import bounded, kept
from ..schema import variants

MOST_ACTIVITIES = 20_000
LEFTS, RIGHTS = 32, 8192  # texts in a block


def alphabet_of(names: DataFrame) -> DataFrame:
    """(activity, letter): a character for each of the names (activity), in their order; more than MOST_ACTIVITIES are refused."""
    n = names.count()
    if n > MOST_ACTIVITIES:
        raise ValueError(f"more than {MOST_ACTIVITIES} activities")
    code = 0x3400 + F.row_number().over(Window.orderBy("activity"))  # the alphabet; ideographs, below the surrogates
    return names.select("activity", F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE").alias("letter"))


def as_text(rows: DataFrame, alphabet: DataFrame, column: str) -> DataFrame:
    """rows with ``text``: the activities of a column as a text of a character each, from which distances are taken."""
    letters = alphabet.agg(F.map_from_entries(F.collect_list(F.struct("activity", "letter"))).alias("letters"))  # at most MOST_ACTIVITIES
    text = F.array_join(F.transform(column, lambda a: F.element_at("letters", a)), "")
    return rows.crossJoin(F.broadcast(letters)).withColumn("text", text).drop("letters")


def nearest_variants(log: DataFrame, other: DataFrame, pivots: int = 8) -> DataFrame:
    """(variant, nearest, distance): for each variant of log the variant of the other log at the least edit distance; exact.

    Distances count activities put in, left out or replaced; ties go to the first variant by its activities.  Distances to a few
    frequent variants of the other log, the pivots, bound all others by the triangle inequality.  Both sides are sorted by their nearest pivot
    and cut into blocks; blocks that lie near each other in that order are compared first and give a better bound, then all other pairs of blocks
    that lengths and pivots allow, a text with a block at a time (see edit_distances()).  Logs of more than MOST_ACTIVITIES
    activities are refused.  No row for a log without a variant, or if the other log has none.
    """
    names = log.select("activity").union(other.select("activity")).distinct()
    alphabet = alphabet_of(names)
    mine = kept(as_text(variants(log).select("variant").distinct(), alphabet, "variant"), "variants")
    counted = variants(other).groupBy("variant").agg(F.count("*").alias("n"))
    theirs = kept(as_text(counted, alphabet, "variant").select("variant", "text", "n"), "variants")
    # A hash breaks ties, so that pivots of a log of single cases are not alike in their first activities.
    chosen = theirs.orderBy(F.desc("n"), F.xxhash64("text"), "text").limit(pivots).select(F.row_number().over(Window.orderBy(F.desc("n"), F.xxhash64("text"), "text")).alias("pivot"), F.col("text").alias("p"))
    every = chosen.agg(F.transform(F.array_sort(F.collect_list(F.struct("pivot", "p"))), lambda x: x["p"]).alias("ps"))  # one row
    away = lambda rows: rows.crossJoin(F.broadcast(every)).withColumn("d", F.transform("ps", lambda p: F.levenshtein(F.col("text"), p))).drop("ps")
    placed = lambda rows: away(rows).where("size(d) > 0").withColumn("bound", F.array_min("d")).withColumn("pivot", F.array_position("d", F.col("bound")))
    left, right = kept(_blocks(placed(mine.select("text")), LEFTS), "blocks"), kept(_blocks(placed(theirs.select("text")), RIGHTS), "blocks")
    nearest = lambda met: met.groupBy("text").agg(F.min(F.struct("distance", "other")).alias("x"))  # noqa: E731  letters are in the order of activities
    apart = F.exists(F.arrays_zip("low", "high", "low_", "high_"), lambda z: (z["low_"] - z["high"] > F.col("bound")) | (z["low"] - z["high_"] > F.col("bound")))
    if right.count() > 1:
        overlap = (F.col("first") <= F.col("last_")) & (F.col("first_") <= F.col("last"))
        near = kept(nearest(_compared(left, right, overlap & ~apart)), "near")
        rest = _compared(kept(_bounded_by(left, near), "blocks"), right, ~overlap & ~apart)
        met = near.select("text", "x.other", "x.distance").unionByName(rest)
    else:
        met = _compared(left, right, ~apart)
    best = nearest(met).select("text", "x.distance", "x.other")
    named = best.join(theirs.select(F.col("text").alias("other"), F.col("variant").alias("nearest")), "other")
    return mine.join(named, "text").select("variant", "nearest", "distance")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, rows (text, bound, d), bound, first, last, low, high) of rows sorted by pivot, so many at a time: ranges of place, of d and of lengths."""
    numbered = indexed(rows, "pivot", "bound", "text").withColumn("at", F.struct("pivot", F.array_min("d").alias("near")))
    numbered = numbered.withColumn("spread", F.array_append("d", F.length("text")))
    ends = lambda f: F.transform(F.sequence(F.lit(0), F.size(F.first("spread")) - 1), lambda k: f(F.transform(F.collect_list("spread"), lambda d: F.get(d, k))))
    made = numbered.groupBy(F.floor(F.col("index") / size).cast("int").alias("block"))
    return made.agg(F.collect_list(F.struct("text", "bound", "d")).alias("rows"), F.max("bound").alias("bound"), F.min("at").alias("first"), F.max("at").alias("last"), ends(F.array_min).alias("low"), ends(F.array_max).alias("high"))


def _bounded_by(blocks: DataFrame, near: DataFrame) -> DataFrame:
    """blocks whose texts' bounds are no more than the distances found (text, x.distance)."""
    rows = blocks.select("block", F.inline("rows")).join(near.select("text", F.col("x.distance").alias("found")), "text", "left")
    made = rows.groupBy("block").agg(F.collect_list(F.struct("text", F.least("bound", "found").alias("bound"), "d")).alias("rows"), F.max(F.least("bound", "found")).alias("bound"))
    return blocks.drop("rows", "bound").join(made, "block")


def _compared(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """(text, other, distance): the nearest of each pair of blocks that the condition allows, within the bounds.

    Texts are dealt by the right block and a salt, so that few blocks keep all cores busy; a task gets a right block once for up to two
    thousand texts, which come to it one after the other.
    """
    spark = bounded(left).sparkSession
    rights, lefts = right.count(), LEFTS * left.count()
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = max(-(-4 * parts // max(1, rights)), -(-lefts // max(1, RIGHTS // 4)))
    ranges = right.select(F.col("block").alias("other_block"), *[F.col(c).alias(f"{c}_") for c in ("first", "last", "low", "high")])
    asked = left.join(F.broadcast(ranges), condition).select("other_block", F.pmod(F.col("block"), F.lit(salts)).alias("salt"), F.lit(1).alias("side"), F.inline("rows"))
    held = right.select(F.col("block").alias("other_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), "rows")
    rows = asked.unionByName(held.select("other_block", "salt", "side", F.inline("rows")))
    dealt = rows.repartition(max(parts, rights * salts // 2), "other_block", "salt").sortWithinPartitions("other_block", "salt", "side")
    return dealt.mapInArrow(nearest_of_blocks, "text string, other string, distance int")


def matched_times(log: DataFrame, lifo: bool = False) -> DataFrame:
    """(a, b, a_us, b_us): for each pair of different activities the times of a and b that belong together if cases are not known.

    Each b takes a waiting a whose end is not later than its start: the oldest, or with lifo the youngest; a b that finds none
    waiting, and an a that no b takes, stay alone.  The number waiting is a running sum that can't fall below zero, that is the sum less
    its running minimum.  Both are taken inside ranges of time and carried from range to range, so no pair's times meet in one task.
    The r-th b that finds one meets the r-th a; with lifo those of one height of the stack meet in turn.
    """
    ends = log.select("activity", F.col("us").alias("t"), F.lit(0).alias("side"), "event_idx")
    starts = log.select("activity", F.col("start_us").alias("t"), F.lit(1).alias("side"), "event_idx")
    rows = ranged(ends.unionByName(starts), "t", "side", "event_idx")
    other = log.select(F.col("activity").alias("other")).distinct()
    rows = rows.crossJoin(F.broadcast(other)).where("activity <> other")  # the alphabet
    is_a = F.col("side") == 0
    rows = rows.select(F.when(is_a, F.col("activity")).otherwise(F.col("other")).alias("a"), F.when(is_a, F.col("other")).otherwise(F.col("activity")).alias("b"), "part", "t", "side", "event_idx", F.when(is_a, 1).otherwise(-1).alias("step"))
    inside = Window.partitionBy("a", "b", "part").orderBy("t", "side", "event_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"sum": F.sum("step").over(inside), "bs": F.sum("side").over(inside)}).withColumns({"low": F.min("sum").over(inside), "prior": F.min("sum").over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    part = rows.groupBy("a", "b", "part").agg(F.sum("step").alias("step"), F.sum("side").alias("side"), F.min("sum").alias("low"))
    earlier = Window.partitionBy("a", "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    part = part.withColumns({"sum0": F.coalesce(F.sum("step").over(earlier), zero), "bs0": F.coalesce(F.sum("side").over(earlier), zero)})
    part = part.withColumn("low0", F.least(zero, F.coalesce(F.min(F.col("sum0") + F.col("low")).over(earlier), zero))).select("a", "b", "part", "sum0", "bs0", "low0")
    rows = rows.join(part, ["a", "b", "part"]).withColumns({"sum": F.col("sum") + F.col("sum0"), "bs": F.col("bs") + F.col("bs0"), "low": F.least("low0", F.col("low") + F.col("sum0"))})
    height = F.col("sum") - F.col("low")
    # A b that finds none waiting is one that lowers the minimum.
    rows = rows.withColumn("alone", (F.col("side") == 1) & (F.col("sum") < F.least("low0", F.coalesce(F.col("prior") + F.col("sum0"), F.lit(0)))))
    if lifo:
        rows = rows.where("NOT alone").withColumn("place", F.when(F.col("side") == 0, height).otherwise(height + 1))
        turn = F.row_number().over(Window.partitionBy("a", "b", "place", "side").orderBy("t", "event_idx"))
        keyed = rows.select("a", "b", "place", turn.alias("turn"), "side", "t")
    else:
        rank = F.when(F.col("side") == 0, F.col("sum") + F.col("bs")).otherwise(F.col("bs") + F.col("low"))
        keyed = rows.where("NOT alone").select("a", "b", F.lit(0).alias("place"), rank.alias("turn"), "side", "t")
    x = keyed.where("side = 0").select("a", "b", "place", "turn", F.col("t").alias("a_us"))
    y = keyed.where("side = 1").select("a", "b", "place", "turn", F.col("t").alias("b_us"))
    return x.join(y, ["a", "b", "place", "turn"]).select("a", "b", "a_us", "b_us")


def matched_durations(log: DataFrame, lifo: bool = False) -> DataFrame:
    """(a, b, n, mean_s, min_s, max_s) of matched_times()."""
    gap = (F.col("b_us") - F.col("a_us")) / 1e6
    return matched_times(log, lifo).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(gap).alias("mean_s"), F.min(gap).alias("min_s"), F.max(gap).alias("max_s"))
