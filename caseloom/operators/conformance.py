"""Conformance of single cases: declare constraints, log skeletons, temporal profiles, footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import cases, in_case
from .declarative import occurrences
from .relations import dfg, temporal_deviations

#: Which activity of a relation constraint (a, b) makes a case decide it.
BY_A = ("responded_existence", "response", "alternate_response", "chain_response")
BY_B = ("precedence", "alternate_precedence", "chain_precedence")
BY_EITHER = ("succession", "alternate_succession", "chain_succession", "coexistence", "non_coexistence", "non_succession", "non_chain_succession")
UNARY = ("existence", "absence", "exactly_one", "init")


def _outcomes() -> dict[str, Column]:
    """Whether a case fulfils a template, by the places pa and pb of its activities (null: none)."""
    both = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    even = both & (F.size("pa") == F.size("pb"))
    response, precedence = both & (F.array_max("pa") < F.array_max("pb")), both & (F.array_min("pa") < F.array_min("pb"))
    order = F.forall(F.arrays_zip("pa", "pb"), lambda z: z["pa"] < z["pb"])
    apart = F.forall(F.arrays_zip(F.slice("pa", 2, F.size("pa")), F.col("pb")), lambda z: F.coalesce(z["pb"] < z["0"], F.lit(True)))
    alternating, chain = even & order & apart, even & F.forall(F.arrays_zip("pa", "pb"), lambda z: z["pb"] == z["pa"] + 1)
    return {
        "responded_existence": both, "coexistence": both, "non_coexistence": ~both, "response": response, "precedence": precedence, "succession": response & precedence,
        "non_succession": ~(response & precedence), "alternate_response": alternating, "alternate_precedence": alternating, "alternate_succession": alternating,
        "chain_response": chain, "chain_precedence": chain, "chain_succession": chain, "non_chain_succession": ~chain,
    }


def _tested(outcomes: dict[str, Column], name: str = "template") -> Column:
    out = F.lit(None).cast("boolean")
    for template, met in outcomes.items():
        out = F.when(F.col(name) == template, F.coalesce(met, F.lit(False))).otherwise(out)
    return out


def _pairs(log: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, template, a, b, pa, pb): of each case with a or b of a constraint, that constraint."""
    occ = occurrences(log)
    a = occ.select("case_id", F.col("activity").alias("a"), F.col("places").alias("pa"))
    b = occ.select("case_id", F.col("activity").alias("b"), F.col("places").alias("pb"))
    left = a.join(model, "a").join(b, ["case_id", "b"], "left")
    alone = b.join(model, "b").join(a.select("case_id", "a"), ["case_id", "a"], "left_anti")
    return left.select("case_id", "template", "a", "b", "pa", "pb").union(alone.select("case_id", "template", "a", "b", F.lit(None).cast("array<int>"), "pb"))


def declare_deviations(log: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, template, a, b): constraints of the model (template, a, b; b null for the unary ones) that a case breaks."""
    rows = _pairs(log, model.where(~F.col("template").isin(*UNARY)))
    decides = F.when(F.col("template").isin(*BY_A), F.col("pa").isNotNull()).when(F.col("template").isin(*BY_B), F.col("pb").isNotNull()).otherwise(F.lit(True))
    broken = rows.where(decides & ~_tested(_outcomes())).select("case_id", "template", "a", "b")
    held = log.groupBy("case_id", "activity").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("activity", "n"))).alias("held"))
    single = held.join(cases(log).select("case_id", "first_activity"), "case_id").crossJoin(model.where(F.col("template").isin(*UNARY)))  # each case decides each
    n = F.coalesce(F.try_element_at("held", F.col("a")), F.lit(0))
    unary = {"existence": n > 0, "absence": n == 0, "exactly_one": (n == 0) | (n == 1), "init": F.col("first_activity") == F.col("a")}
    return broken.union(single.where(~_tested(unary)).select("case_id", "template", "a", "b"))


def _summed(log: DataFrame, deviations: DataFrame, total: DataFrame) -> DataFrame:
    """(case_id, n_constraints, n_deviations, fitness, is_fit) from the deviations and (case_id, n_constraints)."""
    n = deviations.groupBy("case_id").agg(F.count("*").alias("n_deviations"))
    out = cases(log).select("case_id").join(total, "case_id", "left").join(n, "case_id", "left").na.fill(0, ["n_constraints", "n_deviations"])
    fitness = F.when(F.col("n_constraints") > 0, 1 - F.col("n_deviations") / F.col("n_constraints")).otherwise(1.0)
    return out.select("case_id", "n_constraints", "n_deviations", fitness.alias("fitness"), (F.col("n_deviations") == 0).alias("is_fit"))


def declare_conformance(log: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, n_constraints, n_deviations, fitness, is_fit): a row a case, against all constraints of the model."""
    size = model.agg(F.count("*").alias("n_constraints"))
    total = cases(log).select("case_id").crossJoin(F.broadcast(size))  # one row
    return _summed(log, declare_deviations(log, model), total)


def skeleton_conformance(log: DataFrame, model: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(case_id, n_constraints, n_deviations, fitness, is_fit) against a log skeleton (relation, a, b) and numbers of occurrences (activity, times).

    A constraint counts for the cases that hold its first activity; one event of it that fulfils always_after, always_before or directly_follows is
    enough.  With frequencies each activity of a case is a constraint, met by an admissible number, and each activity that has no
    admissible 0 is one more, broken, for the cases without it.
    """
    rows = _pairs(log, model.withColumnRenamed("relation", "template")).where("pa IS NOT NULL")
    both = F.col("pb").isNotNull()
    outcomes = {
        "equivalence": both & (F.size("pa") == F.size("pb")),
        "always_after": both & (F.array_max("pb") > F.array_min("pa")),
        "always_before": both & (F.array_min("pb") < F.array_max("pa")),
        "never_together": ~both,
        "directly_follows": both & F.exists("pa", lambda p: F.array_contains(F.col("pb"), p + 1)),
    }
    rows = rows.select("case_id", _tested(outcomes).alias("ok"))
    if frequencies is not None:
        allowed = frequencies.groupBy("activity").agg(F.collect_set(F.col("times").cast("long")).alias("times"))  # the alphabet
        held = log.groupBy("case_id", "activity").agg(F.count("*").alias("n"))
        counted = held.join(allowed, "activity", "left").select("case_id", F.coalesce(F.array_contains("times", F.col("n")), F.lit(False)).alias("ok"))
        needed = allowed.where(F.array_min("times") > 0).select("activity")
        absent = cases(log).select("case_id").crossJoin(F.broadcast(needed)).join(held, ["case_id", "activity"], "left_anti")  # at most the alphabet
        rows = rows.unionByName(counted).unionByName(absent.select("case_id", F.lit(False).alias("ok")))
    n = rows.groupBy("case_id").agg(F.count("*").alias("n_constraints"))
    return _summed(log, rows.where("NOT ok"), n)


def temporal_conformance(log: DataFrame, profile: DataFrame, zeta: float) -> DataFrame:
    """(case_id, n_deviations, worst: the largest score, infinite where the deviation is 0, is_fit) of every case."""
    score = F.coalesce("score", F.lit(float("inf")))
    found = temporal_deviations(log, profile, zeta).groupBy("case_id").agg(F.count("*").alias("n_deviations"), F.max(score).alias("worst"))
    out = cases(log).select("case_id").join(found, "case_id", "left").na.fill(0, ["n_deviations"])
    return out.select("case_id", "n_deviations", "worst", (F.col("n_deviations") == 0).alias("is_fit"))


def footprint_quality(log: DataFrame, model: DataFrame) -> DataFrame:
    """(fitness, precision): the share of directly-follows steps that the model (a, b, relation) allows; of the model's pairs that occur."""
    steps = dfg(log)
    allowed = model.select("a", "b", F.lit(1).alias("allowed"))
    both = steps.join(allowed, ["a", "b"], "full")
    fitness = F.sum(F.when(F.col("allowed") == 1, F.col("n")).otherwise(0)) / F.sum("n")
    precision = F.count_if(F.col("n").isNotNull() & F.col("allowed").isNotNull()) / F.count("allowed")
    return both.agg(fitness.alias("fitness"), precision.alias("precision"))


def footprint_deviations(log: DataFrame, footprints: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(case_id, kind, a, b, us) against a model of steps (a, b) and first and last activities (activity).

    kind is start (b begins the case), step (a is followed by b) or end (a ends it); us is the time of the event, for end of the last one.
    One window pass over the log; the models, at most the alphabet squared, are joined.
    """
    w = in_case()
    rows = log.select("case_id", "us", F.lag("activity").over(w).alias("a"), F.col("activity").alias("b"), F.lead("activity").over(w).isNull().alias("last"))
    known = footprints.select("a", "b").distinct().withColumn("known", F.lit(True))
    steps = rows.where("a IS NOT NULL").join(known, ["a", "b"], "left_anti").select("case_id", F.lit("step").alias("kind"), "a", "b", "us")
    begun = rows.where("a IS NULL").join(starts.select(F.col("activity").alias("b")), "b", "left_anti").select("case_id", F.lit("start").alias("kind"), "a", "b", "us")
    ended = rows.where("last").select("case_id", F.col("b").alias("a"), "us").join(ends.select(F.col("activity").alias("a")), "a", "left_anti")
    return steps.unionByName(begun).unionByName(ended.select("case_id", F.lit("end").alias("kind"), "a", F.lit(None).cast("string").alias("b"), "us"))
