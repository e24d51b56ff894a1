"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Sizes are summed by source and hash bucket.  Where a source's budget ends inside a bucket, only the rows of that
bucket are refined by the next bits of their hash.  The thresholds nest: a larger budget takes all that a smaller
one takes.  No row is sorted, and nothing but a row per source and bucket is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(column: Column) -> Column:
    """60 bits of MD5 of a column as text (null as empty), 0 to 2^60 - 1."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): budgets by weight, filled up to most times a source's size.

    The excess of capped sources goes to the others by weight.  In order of size / weight, a source is capped while
    the level that the rest would share is at or above its own cap; a window over one row per source finds it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    chosen = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", chosen.cast("double").alias("w"), (F.col("source_size") * most).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
        .withColumn("open_level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    )
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open_level") * F.col("w")).alias("target"))


def source_bounds(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(of, source_size, target, times, budget, edge, edge_size) by source from rows (source, size, h), one row a source.

    Documents are taken ``times`` times, once more those with h < edge, and ``budget`` words of those with h = edge.
    """
    targets = kept(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.coalesce(F.least(F.floor(F.try_divide("target", "source_size")), F.lit(most)), F.lit(0)).cast("long")
    budget = F.floor(F.col("target") - whole * F.col("source_size")).cast("long")
    bound = targets.select(F.col("source").alias("of"), budget.alias("budget"), F.lit(0).cast("long").alias("edge"))
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        inside = rows.join(bound, F.col("source").eqNullSafe(F.col("of"))).where(F.shiftright("h", shift + BITS) == F.col("edge"))
        sums = inside.groupBy("of", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"))
        crossing = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("of").orderBy("bucket"))).where("upto > budget")
        first = F.min(F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("s")).alias("left"), "s")).alias("x")
        bound = crossing.groupBy("of").agg(first).select("of", F.col("x.left").alias("budget"), F.col("x.bucket").alias("edge"), F.col("x.s").alias("edge_size"))
    found = bound.select(F.col("of").alias("found"), "budget", "edge", "edge_size")
    all_sources = targets.select(F.col("source").alias("of"), "source_size", "target", whole.alias("times"))
    return kept(all_sources.join(found, F.col("of").eqNullSafe(F.col("found")), "left").drop("found"), "bounds")


def _taken(size: str) -> Column:
    part = F.floor(F.col(size) * F.col("budget") / F.col("edge_size"))
    extra = F.when(F.col("h") < F.col("edge"), F.col(size)).when(F.col("h") == F.col("edge"), part).otherwise(0)
    return (F.col("times") * F.col(size) + F.coalesce(extra, F.lit(0))).cast("long")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row (id_col, size, source, source_size, target, taken) per row of docs.

    A document's size is its number of words (null text: 0).  Sources by code point, null last, get the weights in
    turn and share ``share`` times all sizes, at most ``most`` times their own.  Every document of a source is taken
    floor(target / source_size) times; the rest of the target is taken once more from the documents whose hash of id_col
    is below the source's threshold.  Rows with the boundary hash share what is left in proportion to their sizes, as
    whole words.  So a source's taken words fall short of its target by less than one word and one for each row that
    repeats the boundary id.  Empty tables give no rows; a source of size 0 has target 0; other columns, clashing names
    too, are not read.  The result depends on the rows alone: reruns agree.
    """
    columns = F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h")
    rows = kept(docs.select(*columns), "sizes")
    bounds = source_bounds(rows, weights, share, most)
    return rows.join(bounds, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", _taken("size").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with each row as often as mix_sources takes it, in the columns of docs (doc_id, text, source and any others).

    Columns of any name pass through.  A row that is taken in part holds its first words, joined by single spaces.  Rows without words go; n_chars, where
    there is one, is that of the new text.  The text is not shuffled: a row per source decides on all its documents.
    """
    rows = kept(docs.select("source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h")), "sizes")
    bounds = source_bounds(rows, weights, share, most)
    sized = docs.select(F.struct(*docs.columns).alias("row"), word_count(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h"))
    joined = sized.join(bounds, F.col("row.source").eqNullSafe(F.col("of")))
    extra = F.expr("CASE WHEN h < edge THEN size WHEN h = edge THEN floor(size * budget / edge_size) ELSE 0 END").cast("long")
    parts = F.filter(F.concat(F.array_repeat("size", F.col("times").cast("int")), F.array(extra)), lambda x: x > 0)
    out = joined.withColumn("part", F.explode(parts))
    first_words = F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int"))
    text = F.when(F.col("part") < F.col("size"), F.array_join(first_words, " ")).otherwise(F.col("row.text"))
    made = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.withColumn("new_text", text).select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
