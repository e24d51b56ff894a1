"""Models found by aggregation: transition systems, prefix trees, alpha places and heuristics dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cases, in_case, position, variants
from .relations import dfg


def _view(states: Column, view: str) -> Column:
    """A state's name: the activities as they come, as a set, or as a multiset."""
    if view == "set":
        states = F.array_sort(F.array_distinct(states))
    elif view == "multiset":
        states = F.array_sort(states)
    elif view != "sequence":
        raise ValueError("view is sequence, set or multiset")
    return F.array_join(states, ",")


def transition_system(log: DataFrame, window: int = 2, view: str = "sequence", forward: bool = True) -> DataFrame:
    """(source, activity, target, n): moves between states, a state being the last (or the next) ``window`` activities of a case."""
    past, after = (in_case().rowsBetween(-window, -1), in_case().rowsBetween(-window + 1, 0)) if forward else (in_case().rowsBetween(0, window - 1), in_case().rowsBetween(1, window))
    rows = log.select("activity", F.collect_list("activity").over(past).alias("x"), F.collect_list("activity").over(after).alias("y"))
    return rows.groupBy(_view(F.col("x"), view).alias("source"), "activity", _view(F.col("y"), view).alias("target")).agg(F.count("*").alias("n"))


def prefix_tree(log: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(prefix, depth, n_cases, n_final): the nodes of the trie of the variants; n_final counts cases that end there.

    Variants are counted first, so a node costs a row a variant and not a row a case.
    """
    counted = variants(log).groupBy("variant").agg(F.count("*").alias("n"))
    size = F.size("variant")
    depth = size if most_depth is None else F.least(size, F.lit(most_depth))
    nodes = counted.select("n", F.col("variant"), F.explode(F.sequence(F.lit(1), depth)).alias("depth"))
    rows = nodes.select(F.array_join(F.slice("variant", F.lit(1), F.col("depth")), ",").alias("prefix"), "depth", "n", (F.col("depth") == size).alias("final"))
    return rows.groupBy("prefix", "depth").agg(F.sum("n").alias("n_cases"), F.sum(F.when(F.col("final"), F.col("n")).otherwise(0)).alias("n_final"))


def prefix_nodes(log: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node, parent, activity, depth, n_cases, n_final): prefix_tree() with nodes named by hashes, linear in a variant's length.

    A node's name is the SHA-256 of its parent's name, a slash and its activity, the root's being empty; so a row that is shuffled has the same
    size at any depth, and the prefix of a node is read along its parents.
    """
    rows = variants(log).groupBy("variant").agg(F.count("*").alias("n")).withColumn("size", F.size("variant"))
    if most_depth is not None:
        rows = rows.withColumn("variant", F.slice("variant", 1, most_depth))
    start = F.array(F.lit(""))
    names = F.aggregate("variant", start, lambda held, a: F.array_append(held, F.sha2(F.concat(F.element_at(held, -1), F.lit("/"), a), 256)))
    nodes = rows.withColumn("names", names).select("*", F.posexplode("variant").alias("at", "activity"))
    last = F.col("at") + 1 == F.col("size")
    named = nodes.select(F.get("names", F.col("at") + 1).alias("node"), F.get("names", F.col("at")).alias("parent"), "activity", (F.col("at") + 1).alias("depth"), "n", last.alias("final"))
    return named.groupBy("node", "parent", "activity", "depth").agg(F.sum("n").alias("n_cases"), F.sum(F.when(F.col("final"), F.col("n")).otherwise(0)).alias("n_final"))


def footprint_similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """(similarity): of the relations (a, b, relation) of two footprints, the share that both have; 0 where neither has any."""
    x = first.select("a", "b", "relation").distinct().withColumn("x", F.lit(1))
    both = x.join(second.select("a", "b", "relation").distinct().withColumn("y", F.lit(1)), ["a", "b", "relation"], "full")
    met = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return both.agg(F.when(F.count("*") > 0, met / F.count("*")).otherwise(0.0).alias("similarity"))


def alpha_relations(log: DataFrame) -> DataFrame:
    """(a, b, relation): causal, parallel or none for every pair of activities, the alpha algorithm's footprint matrix."""
    edges = dfg(log).select("a", "b")
    names = log.select("activity").distinct()
    pairs = names.select(F.col("activity").alias("a")).crossJoin(F.broadcast(names.select(F.col("activity").alias("b"))))  # the alphabet squared
    there = pairs.join(edges.withColumn("ab", F.lit(True)), ["a", "b"], "left")
    both = there.join(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("ba")), ["a", "b"], "left")
    ab, ba = F.coalesce("ab", F.lit(False)), F.coalesce("ba", F.lit(False))
    return both.select("a", "b", F.when(ab & ba, "parallel").when(ab, "causal").when(ba, "inverse").otherwise("none").alias("relation"))


def heuristics_dependencies(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, n, dependency): edges of a heuristics net.

    For a <> b the dependency is (ab - ba) / (ab + ba + 1), for a loop of one aa / (aa + 1); edges at the threshold or above stay.
    """
    edges = dfg(log)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    m = F.coalesce("m", F.lit(0))
    value = F.when(F.col("a") == F.col("b"), F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - m) / (F.col("n") + m + 1))
    return edges.join(back, ["a", "b"], "left").select("a", "b", "n", value.alias("dependency")).where(F.col("dependency") >= threshold)


def loops_of_two(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, n, dependency): pairs with a b a or b a b in a case, (aba + bab) / (aba + bab + 1) at the threshold or above."""
    w = in_case()
    rows = log.select(F.col("activity").alias("a"), F.lead("activity").over(w).alias("b"), F.lead("activity", 2).over(w).alias("c"))
    pairs = rows.where("a = c AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    return pairs.select("a", "b", "n", (F.col("n") / (F.col("n") + 1)).alias("dependency")).where(F.col("dependency") >= threshold)


def dfg_conformance(log: DataFrame, model: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(case_id, n_moves, n_deviations, fitness): a case's moves that a directly-follows model (a, b), its starts and ends allow.

    The start and the end count as moves; fitness is the share of allowed moves.
    """
    nothing = F.lit(None).cast("string")
    w = in_case()
    moves = log.select("case_id", F.col("activity").alias("a"), F.lead("activity").over(w).alias("b")).where("b IS NOT NULL")
    bounds = cases(log)
    rows = moves.unionByName(bounds.select("case_id", nothing.alias("a"), F.col("first_activity").alias("b"))).unionByName(bounds.select("case_id", F.col("last_activity").alias("a"), nothing.alias("b")))
    allowed = model.select("a", "b").unionByName(starts.select(nothing.alias("a"), F.col("activity").alias("b"))).unionByName(ends.select(F.col("activity").alias("a"), nothing.alias("b"))).distinct()
    allowed = allowed.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1).alias("ok"))
    joined = rows.join(allowed, F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")), "left")
    summed = joined.groupBy("case_id").agg(F.count("*").alias("n_moves"), F.count_if(F.col("ok").isNull()).alias("n_deviations"))
    return summed.withColumn("fitness", 1 - F.col("n_deviations") / F.col("n_moves"))


def dfg_precision(log: DataFrame, model: DataFrame) -> DataFrame:
    """(precision): one less the share of moves that a directly-follows model allows after the cases' prefixes but the log doesn't take.

    A prefix is known by 128 bits, the exclusive or of its (activity, position) hashes, so long cases cost no more a row.
    """
    w = in_case().rowsBetween(Window.unboundedPreceding, 0)
    placed = log.withColumn("place", position())
    parts = [F.bit_xor(F.xxhash64(F.lit(seed), "activity", "place")).over(w) for seed in (1, 2)]
    rows = placed.select(F.struct(*parts).alias("prefix"), "activity", F.lead("activity").over(in_case()).alias("b"))
    states = rows.groupBy("prefix", "activity").agg(F.count("*").alias("n"), F.size(F.collect_set("b")).alias("taken"))
    allowed = model.groupBy(F.col("a").alias("activity")).agg(F.count_distinct("b").alias("allowed"))
    sums = states.join(allowed, "activity").agg(F.sum(F.col("n") * F.col("allowed")).alias("all"), F.sum(F.col("n") * (F.col("allowed") - F.least("taken", "allowed"))).alias("escaping"))
    return sums.select((1 - F.try_divide(F.col("escaping"), F.col("all"))).alias("precision"))
