"""Declare templates and the log skeleton, from positions of activities in cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cases, in_case, position


def occurrences(log: DataFrame) -> DataFrame:
    """(case_id, activity, places: ascending positions)."""
    rows = log.select("case_id", "activity", position().alias("p"))
    return rows.groupBy("case_id", "activity").agg(F.array_sort(F.collect_list("p")).alias("places"))


def declare_unary(log: DataFrame) -> DataFrame:
    """(template, a, support, confidence) of existence, exactly_one, init and absence.

    support is the number of cases to which a template applies (all for existence, absence and init; those with the activity
    for exactly_one), confidence the share of them that fulfil it.
    """
    total = cases(log).agg(F.count("*").alias("total"))
    by = occurrences(log).groupBy(F.col("activity").alias("a")).agg(
        F.count("*").alias("have"), F.count_if(F.size("places") == 1).alias("once"), F.count_if(F.get("places", F.lit(0)) == 0).alias("first")
    )
    rows = by.crossJoin(F.broadcast(total))  # one row
    t = F.col("total")
    made = F.array(
        *[
            F.struct(F.lit(name).alias("template"), support.alias("support"), (hits / support).alias("confidence"))
            for name, support, hits in (("existence", t, F.col("have")), ("absence", t, t - F.col("have")), ("exactly_one", F.col("have"), F.col("once")), ("init", t, F.col("first")))
        ]
    )
    return rows.select("a", F.inline(made)).select("template", "a", "support", "confidence")


def declare_binary(log: DataFrame) -> DataFrame:
    """(template, a, b, support, confidence) of the relation templates for all pairs of activities, also those that share no case.

    A case decides response templates if it holds a, precedence templates if it holds b, and the others if it holds either.  A
    negative template (non...) turns the outcome of its positive one round.
    """
    occ = occurrences(log)
    x = occ.select("case_id", F.col("activity").alias("a"), F.col("places").alias("pa"))
    y = occ.select("case_id", F.col("activity").alias("b"), F.col("places").alias("pb"))
    both = x.join(y, "case_id").where("a <> b")
    even = F.size("pa") == F.size("pb")
    order = F.forall(F.arrays_zip("pa", "pb"), lambda z: z["pa"] < z["pb"])
    apart = F.forall(F.arrays_zip(F.slice("pa", 2, F.size("pa")), F.col("pb")), lambda z: F.coalesce(z["pb"] < z["0"], F.lit(True)))
    near = F.forall(F.arrays_zip("pa", "pb"), lambda z: z["pb"] == z["pa"] + 1)
    last_a, last_b = F.array_max("pa"), F.array_max("pb")
    first_a, first_b = F.array_min("pa"), F.array_min("pb")
    sums = both.groupBy("a", "b").agg(
        F.count("*").alias("both"),
        F.count_if(last_a < last_b).alias("response"),
        F.count_if(first_a < first_b).alias("precedence"),
        F.count_if((last_a < last_b) & (first_a < first_b)).alias("succession"),
        F.count_if(even & order & apart).alias("alternating"),
        F.count_if(even & near).alias("chain"),
    )
    alone = occ.groupBy("activity").agg(F.count("*").alias("k"))
    names = alone.select(F.col("activity").alias("a"), F.col("k").alias("ka")).crossJoin(alone.select(F.col("activity").alias("b"), F.col("k").alias("kb"))).where("a <> b")  # the alphabet squared
    counts = ["both", "response", "precedence", "succession", "alternating", "chain"]
    rows = names.join(sums, ["a", "b"], "left").na.fill(0, counts)
    ka, kb, either = F.col("ka"), F.col("kb"), F.col("ka") + F.col("kb") - F.col("both")
    hits = {
        "responded_existence": (ka, F.col("both")),
        "response": (ka, F.col("response")),
        "alternate_response": (ka, F.col("alternating")),
        "chain_response": (ka, F.col("chain")),
        "precedence": (kb, F.col("precedence")),
        "alternate_precedence": (kb, F.col("alternating")),
        "chain_precedence": (kb, F.col("chain")),
        "succession": (either, F.col("succession")),
        "alternate_succession": (either, F.col("alternating")),
        "chain_succession": (either, F.col("chain")),
        "coexistence": (either, F.col("both")),
        "non_coexistence": (either, either - F.col("both")),
        "non_succession": (either, either - F.col("succession")),
        "non_chain_succession": (either, either - F.col("chain")),
    }
    made = F.array(*[F.struct(F.lit(n).alias("template"), s.alias("support"), (h / s).alias("confidence")) for n, (s, h) in hits.items()])
    return rows.select("a", "b", F.inline(made)).select("template", "a", "b", "support", "confidence")


def skeleton(log: DataFrame, noise: float = 0.0) -> DataFrame:
    """(relation, a, b) of the log skeleton: relations whose count is at least 1 - noise of the events of a.

    Counts: for equivalence the events of a in cases with as many of b; for always_after and always_before the cases with some b after
    (before) some a, so that a case with several a weighs less than its events; for never_together the events of a less the cases with both; for
    directly_follows the steps from a to b.  A count of 0 gives no relation, whatever the noise; only the first and never_together leave out a = b.
    """
    occ = occurrences(log)
    x = occ.select("case_id", F.col("activity").alias("a"), F.col("places").alias("pa"))
    y = occ.select("case_id", F.col("activity").alias("b"), F.col("places").alias("pb"))
    first, last = F.array_min, F.array_max
    sums = x.join(y, "case_id").groupBy("a", "b").agg(
        F.count("*").alias("both"),
        F.sum(F.when(F.size("pa") == F.size("pb"), F.size("pa")).otherwise(0)).alias("equal"),
        F.count_if(last("pb") > first("pa")).alias("after"),
        F.count_if(first("pb") < last("pa")).alias("before"),
    )
    follows = log.select(F.col("activity").alias("a"), F.lead("activity").over(in_case()).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    events = log.groupBy("activity").agg(F.count("*").alias("k"))
    names = events.select(F.col("activity").alias("a"), "k").crossJoin(events.select(F.col("activity").alias("b")))  # the alphabet squared
    rows = names.join(sums, ["a", "b"], "left").join(follows, ["a", "b"], "left").na.fill(0, ["both", "equal", "after", "before", "n"])
    other = F.col("a") != F.col("b")
    enough = lambda c: (c > 0) & (c >= F.col("k") * (1 - noise))
    tests = {
        "equivalence": other & enough(F.col("equal")),
        "always_after": enough(F.col("after")),
        "always_before": enough(F.col("before")),
        "never_together": other & enough(F.col("k") - F.col("both")),
        "directly_follows": enough(F.col("n")),
    }
    made = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return rows.select(F.explode(made).alias("relation"), "a", "b")


def activity_frequencies(log: DataFrame, noise: float = 0.0) -> DataFrame:
    """(activity, times, n_cases): admissible numbers of occurrences in a case, the commonest that cover 1 - noise of the cases."""
    occ = occurrences(log).select("activity", F.size("places").cast("long").alias("times"))
    total = cases(log).agg(F.count("*").alias("total"))
    counted = occ.groupBy("activity", "times").agg(F.count("*").alias("n_cases"))
    zero = counted.groupBy("activity").agg(F.sum("n_cases").alias("have")).crossJoin(F.broadcast(total)).where("have < total")  # one row
    every = counted.unionByName(zero.select("activity", F.lit(0).cast("long").alias("times"), (F.col("total") - F.col("have")).alias("n_cases")))
    before = F.coalesce(F.sum("n_cases").over(Window.partitionBy("activity").orderBy(F.desc("n_cases"), "times").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.withColumn("before", before).crossJoin(F.broadcast(total)).where(F.col("before") < F.col("total") * (1 - noise)).select("activity", "times", "n_cases")


def footprint_conformance(log_footprints: DataFrame, model_footprints: DataFrame) -> DataFrame:
    """(a, b, log_relation, model_relation) of pairs whose relation in the log the model lacks."""
    model = model_footprints.select("a", "b", F.col("relation").alias("model_relation"))
    rows = log_footprints.select("a", "b", F.col("relation").alias("log_relation")).join(model, ["a", "b"], "left")
    return rows.where("model_relation IS NULL OR (log_relation = 'parallel' AND model_relation = 'sequence')")
