"""Variants of a log with noisy counts: a prefix tree grown level by level under the Laplace mechanism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dropped, kept
from ..schema import variants

STOP = "\u0000"  # stands for the end of a case among the next activities


def chained(parent: Column, nxt: Column) -> Column:
    """The name of a prefix: the hash of its parent's name and its last activity, of one size however long the prefix."""
    return F.sha2(F.concat(parent, F.lit(":"), nxt), 256)


def laplace(node: Column, epsilon: float, secret: str) -> Column:
    """Laplace noise of scale 1 / epsilon, cut to whole numbers towards 0, drawn from the hash of a secret and a node.

    A task that runs again after a lost executor draws the same noise, which fresh random numbers would not; whoever knows
    the secret can take the noise off, so it has to be long, random and used for one release only.
    """
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(secret), F.lit(":"), node), 256), 1, 13), 16, 10).cast("long")
    u = (bits + 0.5) / float(1 << 52) - 0.5
    return (-F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon).cast("long")


def private_variants(log: DataFrame, epsilon: float | None, least: int, length: int, secret: str = "") -> DataFrame:
    """(variant: array of activities, n: noisy number of cases) of complete variants, found in at most ``length`` steps, the end counted as one.

    Each step extends every prefix left by each activity of the log or the end, adds noise to the number of its cases (0 for prefixes
    that no case has) and prunes what is below ``least``; so variants that no case has may come out, as the mechanism demands.  Without an
    epsilon there is no noise and the variants are exact, as far as no prefix is rarer than ``least``.  ``least`` must be 1 or more: at 0 every
    sequence would come out.  Cases longer than ``length`` - 1 activities count for their prefixes and come out in no variant.

    Cases are counted once, by partial sums over hashed prefixes.  In a step prefixes that cases have come from a join with these
    counts; those that none has are settled where they are made, since only noise of ``least`` or more lets them live, and only survivors are
    compared with the counts.  The rows made are prefixes left times activities: the method's own size, which least and epsilon set.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    if epsilon is not None and (epsilon <= 0 or not secret):
        raise ValueError("noise takes an epsilon above 0 and a secret")
    noise = (lambda node: laplace(node, epsilon, secret)) if epsilon is not None else (lambda node: F.lit(0).cast("long"))
    counts = kept(_prefix_counts(log, length), "prefixes")
    alphabet = kept(log.select(F.col("activity").alias("nxt")).distinct().union(log.sparkSession.createDataFrame([(STOP,)], "nxt string")), "alphabet")
    left = kept(log.sparkSession.createDataFrame([("", [])], "node string, prefix array<string>"), "tree")
    found = []
    for level in range(1, length + 1):
        known = counts.where(F.col("level") == level).select("parent", "nxt", "child", "cases")
        held = left.join(known, left["node"] == known["parent"]).select("child", "prefix", "nxt", "cases")
        held = held.withColumn("n", F.col("cases") + noise(F.col("child"))).select("child", "prefix", "nxt", "n")
        grown = held
        if epsilon is not None:
            every = left.join(alphabet, F.lit(True)).select(chained(F.col("node"), F.col("nxt")).alias("child"), "prefix", "nxt")
            lucky = every.withColumn("n", noise(F.col("child"))).where(F.col("n") >= least)
            grown = held.unionByName(lucky.join(known.select("child"), "child", "left_anti"))
        grown = kept(grown.where(F.col("n") >= least), "grown")
        found.append(grown.where(F.col("nxt") == STOP).select(F.col("prefix").alias("variant"), "n"))
        further = kept(grown.where(F.col("nxt") != STOP).select(F.col("child").alias("node"), F.concat("prefix", F.array("nxt")).alias("prefix")), "tree")
        dropped(left)
        left = further
        if left.isEmpty():
            break
    out = log.sparkSession.createDataFrame([], "variant array<string>, n long")
    for part in found:
        out = out.unionByName(part)
    return out


def _prefix_counts(log: DataFrame, length: int) -> DataFrame:
    """(level, parent, nxt, child, cases) of the prefixes of at most ``length`` steps that cases have."""
    begin = F.struct(F.lit("").alias("child"), F.array().cast("array<struct<parent:string,nxt:string,child:string>>").alias("steps"))

    def step(acc: Column, nxt: Column) -> Column:
        child = chained(acc["child"], nxt)
        return F.struct(child.alias("child"), F.concat(acc["steps"], F.array(F.struct(acc["child"].alias("parent"), nxt.alias("nxt"), child.alias("child")))).alias("steps"))

    whole = variants(log).groupBy("variant").agg(F.count("*").alias("n"))
    steps = whole.select("n", F.aggregate(F.slice(F.concat("variant", F.array(F.lit(STOP))), 1, length), begin, step)["steps"].alias("steps"))
    rows = steps.select("n", F.posexplode("steps").alias("at", "step")).select("n", (F.col("at") + 1).alias("level"), "step.*")
    return rows.groupBy("level", "parent", "nxt", "child").agg(F.sum("n").alias("cases"))
