"""Label splitting: an activity that stands in unlike contexts gets a label for each kind of context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import indexed
from ..functions.tables import dropped, kept
from ..schema import in_case
from .matching import alphabet_of, as_text


def _around(before: int, after: int):
    """The activities just before and after an event, in order."""
    w = in_case()
    parts = [(-before, -1)] if before else []
    parts += [(1, after)] if after else []
    return F.concat(F.array().cast("array<string>"), *[F.collect_list("activity").over(w.rowsBetween(*part)) for part in parts])


def contexts(log: DataFrame, before: int = 2, after: int = 2, activities: Sequence[str] | None = None) -> DataFrame:
    """(node, activity, context, n): the different contexts of each activity with their events; node is their place by activity and context."""
    rows = log.select("activity", _around(before, after).alias("context"))
    if activities is not None:
        rows = rows.where(F.col("activity").isin(list(activities)))
    counted = rows.groupBy("activity", "context").agg(F.count("*").alias("n"))
    return indexed(counted, "activity", "context").withColumnRenamed("index", "node")


def similar_contexts(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """(u, v, weight): contexts of one activity with u < v whose likeness is above ``least``.

    Likeness is 1 less the edit distance by the longer context's length.  For a likeness above ``least`` two contexts must share more
    than ``least`` of the longer one's activities (counted with repeats), so one of the rarest of each is shared: pairs
    come from a join on these, and only pairs that share one are compared.  Contexts without a common activity have likeness 0; an empty
    one is like nothing.
    """
    if not 0 <= least < 1:
        raise ValueError("likeness lies in 0 to 1")
    names = nodes.select(F.explode("context").alias("activity")).distinct()
    letters = alphabet_of(names)
    size = F.size("context")
    turn = F.transform("context", lambda x, i: F.struct(x.alias("name"), F.size(F.filter(F.slice("context", F.lit(1), i + 1), lambda y: y == x)).alias("turn")))
    marks = as_text(nodes.where(size > 0), letters, "context").select("node", "activity", "text", size.alias("size"), F.explode(turn).alias("mark"))
    common = marks.groupBy("activity", "mark").agg(F.count("*").alias("k"))
    own = marks.join(common, ["activity", "mark"]).groupBy("node", "activity", "text", "size").agg(F.array_sort(F.collect_list(F.struct("k", "mark"))).alias("marks"))
    rare = F.slice("marks", F.lit(1), F.col("size") - F.floor(F.col("size") * least).cast("int"))
    asked = kept(own.select("node", "activity", "text", F.explode(F.transform(rare, lambda x: x["mark"])).alias("mark")), "marks")
    x = asked.select(F.col("node").alias("u"), "activity", "mark", F.col("text").alias("x"))
    y = asked.select(F.col("node").alias("v"), "activity", "mark", F.col("text").alias("y"))
    pairs = x.join(y, ["activity", "mark"]).where("u < v").select("u", "v", "x", "y").distinct()
    weight = 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))
    return pairs.select("u", "v", weight.alias("weight")).where(F.col("weight") > least)


def communities(nodes: DataFrame, links: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community): label propagation over links (u, v, weight) of nodes (node, n); reruns agree.

    In a round a node hears its neighbours' labels with weight times n; it moves to the strongest if that is stronger than its own, ties
    between others go to the smaller label.  Only half of the nodes, by a hash of node and round, may move in a round, so that neighbours don't swap labels
    for ever.  Ends when no node wants to move, or after ``rounds``; a node without links is alone.  A community is named by its least node.
    """
    both = links.select("u", "v", "weight").union(links.select("v", "u", "weight"))
    heard = kept(both.join(nodes.select(F.col("node").alias("v"), "n"), "v").select("u", "v", (F.col("weight") * F.col("n")).alias("voice")), "voices")
    labels = kept(nodes.select("node", F.col("node").alias("label")), "labels")
    for turn in range(rounds):
        told = heard.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u", "label").agg(F.round(F.sum("voice"), 6).alias("voice"))
        best = told.groupBy("u").agg(F.max(F.struct("voice", (-F.col("label")).alias("last"))).alias("best"))
        mine = labels.join(told.withColumnRenamed("u", "node"), ["node", "label"], "left").join(best.withColumnRenamed("u", "node"), "node", "left")
        wants = F.coalesce(F.col("best.voice") > F.coalesce("voice", F.lit(0.0)), F.lit(False))
        asked = kept(mine.select("node", "label", F.when(wants, -F.col("best.last")).alias("to")), "wishes")
        if asked.where("to IS NOT NULL").isEmpty():
            dropped(asked)
            break
        may = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 0
        moved = kept(asked.select("node", F.when(may & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("label")).alias("label")), "labels")
        dropped(labels, asked)
        labels = moved
    first = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(first, "label").select("node", "community")


def split_labels(log: DataFrame, before: int = 2, after: int = 2, least: float = 0.5, activities: Sequence[str] | None = None, column: str = "label", suffix: str = "_", rounds: int = 20) -> DataFrame:
    """The log with ``column``: the activity, followed by ``suffix`` and a number from 0 where its contexts form several communities.

    A context is the ``before`` activities before and the ``after`` activities after an event of the case.  Communities are numbered by
    their events, most first, ties by their first context.  With ``activities`` only these are split.  A column of the log with the name
    of ``column`` is replaced.
    """
    nodes = contexts(log, before, after, activities)
    nodes = kept(nodes, "contexts")
    links = kept(similar_contexts(nodes, least), "likeness")
    found = kept(nodes.join(communities(nodes, links, rounds), "node"), "communities")
    sizes = found.groupBy("activity", "community").agg(F.sum("n").alias("n"))
    number = F.row_number().over(Window.partitionBy("activity").orderBy(F.desc("n"), "community")) - 1
    several = F.count("*").over(Window.partitionBy("activity")) > 1
    named = sizes.withColumns({"number": number, "several": several}).where("several").select("activity", "community", F.concat("activity", F.lit(suffix), "number").alias("split"))
    split = found.join(named, ["activity", "community"]).select("activity", "context", "split")
    rows = log.select(F.struct(*[F.col(f"`{c}`") for c in log.columns]).alias("row"), "activity", _around(before, after).alias("context"))
    joined = rows.join(split, ["activity", "context"], "left")
    own = [F.col(f"row.`{c}`").alias(c) for c in log.columns if c != column]
    return joined.select(*own, F.coalesce("split", "activity").alias(column))
