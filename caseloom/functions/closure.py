"""Transitive closure of directed graphs as DataFrame joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, dropped, kept

#: Nodes in a list of path_pairs() at most; 2^k.
LIST = 64


@dataclass(frozen=True)
class Closure:
    """members(id, part, cyclic): the strongly connected part of each node, named by its least id; pairs(a, b): parts that a path leads through."""

    members: DataFrame
    pairs: DataFrame

    def expanded(self) -> DataFrame:
        """(a, b) of all nodes that a path of an edge or more leads between; a part on a cycle gives all pairs of its nodes."""
        named = lambda c: self.members.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))
        across = self.pairs.toDF("a_part", "b_part").join(named("a"), "a_part").join(named("b"), "b_part").select("a", "b")
        cyclic = self.members.where("cyclic")
        inside = cyclic.select(F.col("id").alias("a"), "part").join(cyclic.select(F.col("id").alias("b"), "part"), "part").select("a", "b")
        return across.unionByName(inside)


def transitive_closure(links: DataFrame, a: str, b: str) -> Closure:
    """Closure of the links a -> b, with cycles condensed to one node each.

    Each round joins only the pairs that the round before found with all pairs known: the first half of a shortest path of twice the
    length is new, the second half known, so lengths double and a chain of n links takes log n rounds.  A new pair whose reverse is known
    lies on a cycle; such nodes are contracted at once, before a cycle of s nodes can grow to s^2 pairs, and what is left counts as
    new, as contracting shortens paths.  Rows with a null end are no links, repeated ones count once.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    known = kept(edges, "closure")
    nodes = known.select(F.col("a").alias("id")).union(known.select("b")).distinct()
    own = known.where("a = b").select(F.col("a").alias("id"), F.lit(True).alias("loop"))
    members = kept(nodes.join(own, "id", "left").select("id", F.col("id").alias("part"), F.coalesce("loop", F.lit(False)).alias("cyclic")), "members")
    known = new = _swapped(known.where("a <> b"), "closure", known)
    while not new.isEmpty():
        mutual = new.join(known.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi")
        mutual = kept(mutual, "mutual")
        if not mutual.isEmpty():
            to = components(mutual, "a", "b").select(F.col("id").alias("part"), F.col("component_id").alias("to"))
            to = kept(to, "contracted")
            moved = members.join(to, "part", "left").select("id", F.coalesce("to", "part").alias("part"), (F.col("cyclic") | F.col("to").isNotNull()).alias("cyclic"))
            members = _swapped(moved, "members", members)
            named = lambda c: to.select(F.col("part").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
            renamed = known.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
            before = (known,) if new is known else (known, new)
            known = new = _swapped(renamed.where("a <> b").distinct(), "closure", *before)
            dropped(mutual, to)
            continue
        dropped(mutual)
        further = new.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).where("a <> b")
        # a = b would be a cycle: its pairs are both known by then, so the next round finds them mutual.
        fresh = kept(further.distinct().join(known, ["a", "b"], "left_anti"), "fresh")
        grown = kept(known.unionByName(fresh), "closure")
        dropped(known, *(() if new is known else (new,)))
        known, new = grown, fresh
    # Parts that took in another member or had a loop of their own are cyclic, also the members that came in before.
    parts = members.groupBy("part").agg(F.max("cyclic").alias("cyclic"))
    return Closure(members.drop("cyclic").join(parts, "part").select("id", "part", "cyclic"), known)


def _swapped(df: DataFrame, name: str, *before: DataFrame) -> DataFrame:
    """df written, and the tables that it was made of dropped."""
    out = kept(df, name)
    dropped(*before)
    return out


def path_pairs(links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) of all nodes that a path of an edge or more leads between, as transitive_closure().expanded().

    A node with a single link takes the nodes on its way as a list, and in each round the list of the node that its own ends at, so a way
    of n links takes log n rounds that shuffle a row a node, and pairs are made when all is done.  Full lists stay as they are: the steps
    from a node to the end of its list are links again, and what they lead to says which lists follow.  Only nodes on ways to a fork
    or a cycle get their pairs by transitive_closure().
    """
    edges = kept(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"), "links")
    first = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"), (F.min("b") != F.max("b")).alias("hard"))
    rounds = [kept(first.select("id", F.when(~F.col("hard"), F.col("to")).alias("to"), F.array("to").alias("reach"), "hard"), "ways")]
    size, going = 1, rounds[0].where("to IS NOT NULL")
    while size < LIST and not going.isEmpty():
        known = _union([t.where("to IS NULL") for t in rounds[:-1]] + rounds[-1:])
        ends = known.select(F.col("id").alias("to"), F.col("to").alias("next"), F.when(~F.col("hard"), F.col("reach")).alias("more"), F.col("hard").alias("at_hard"))
        longer = F.when(F.col("more").isNull(), F.col("reach")).otherwise(F.concat("reach", "more"))
        step = going.join(ends, "to", "left").select("id", F.col("next").alias("to"), longer.alias("reach"), F.coalesce("at_hard", F.lit(False)).alias("hard"))
        rounds.append(kept(step, "ways"))
        size, going = 2 * size, rounds[-1].where("to IS NOT NULL")
    lists = _union([t.where("to IS NULL AND NOT hard") for t in rounds]).select("id", "reach")
    hard = _union([t.where("hard") for t in rounds]).select("id")
    further = None
    if not going.isEmpty():
        # Each node has one step, so a component of steps has one end or a cycle.
        parts = kept(components(going, "id", "to"), "parts")
        whole = parts.join(going.select("id"), "id", "left_anti").join(hard, "id", "left_anti").select("component_id")
        ending = kept(parts.join(whole, "component_id", "left_semi").select("id"), "ending")
        hard = hard.union(going.join(ending, "id", "left_anti").select("id"))
        going = going.join(ending, "id", "left_semi")
        lists = lists.union(going.select("id", "reach"))
        if not going.isEmpty():
            further = path_pairs(going, "id", "to")
    pairs = lists.select(F.col("id").alias("a"), F.explode("reach").alias("b"))
    if further is not None:
        pairs = pairs.union(further.join(lists.withColumnRenamed("id", "b"), "b").select("a", F.explode("reach").alias("b")))
    if hard.isEmpty():
        dropped(edges)
        return pairs
    own = kept(transitive_closure(edges.join(hard.withColumnRenamed("id", "a"), "a", "left_semi"), "a", "b").expanded(), "pairs")
    beyond = own.join(pairs.toDF("b", "c"), "b").select("a", F.col("c").alias("b"))
    return pairs.union(own.union(beyond).distinct())


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def reach_from(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id) of all nodes that links (a, b) lead to from the sources (id), those themselves not unless on a cycle.

    A round a link: only the pairs of the last round are joined.
    """
    edges = kept(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    front = kept(sources.select(F.col("id").alias("source")).distinct().join(edges, F.col("source") == F.col("a")).select("source", F.col("b").alias("id")), "front")
    seen = front
    while not front.isEmpty():
        further = front.join(edges.withColumnRenamed("a", "id"), "id").select("source", F.col("b").alias("id")).distinct()
        fresh = kept(further.join(seen, ["source", "id"], "left_anti"), "front")
        grown = kept(seen.unionByName(fresh), "seen")
        dropped(seen, *(() if front is seen else (front,)))
        seen, front = grown, fresh
    return seen
