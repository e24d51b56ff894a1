"""Concept drift: where the follows relations of consecutive sub-logs change, by permutation tests over adjoining windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import indexed
from ..functions.tables import kept
from ..schema import cases
from .declarative import occurrences


def sub_logs(log: DataFrame, size: int) -> DataFrame:
    """(case_id, first_us, sub): cases in the order of their begin, ``size`` to a sub-log; the last may be smaller."""
    rows = indexed(cases(log).select("case_id", "first_us"), "first_us", "case_id")
    return rows.select("case_id", "first_us", F.floor(F.col("index") / size).cast("int").alias("sub"))


def follows_features(log: DataFrame, subs: DataFrame) -> DataFrame:
    """(sub, activity, always, sometimes, never): of all activities, how many the activity follows in every, some or none of the sub-log's
    cases that hold them; those that no case of it holds count as never followed.  For each sub-log and each activity of the log.
    """
    occ = occurrences(log).join(subs.select("case_id", "sub"), "case_id").select("sub", "case_id", "activity", F.array_min("places").alias("first"), F.array_max("places").alias("last"))
    held = occ.groupBy("sub", F.col("activity").alias("a")).agg(F.count("*").alias("n"))
    x, y = occ.select("sub", "case_id", F.col("activity").alias("a"), "first"), occ.select("case_id", F.col("activity").alias("b"), "last")
    both = x.join(y, "case_id").where("first < last").groupBy("sub", "a", "b").agg(F.count("*").alias("m"))
    found = both.join(held, ["sub", "a"]).groupBy("sub", "b").agg(F.count_if(F.col("m") == F.col("n")).alias("always"), F.count_if(F.col("m") < F.col("n")).alias("sometimes"))
    alphabet = log.select("activity").distinct()
    every = subs.select("sub").distinct().crossJoin(alphabet)  # a row a sub-log and activity, as the result has
    size = alphabet.agg(F.count("*").alias("size"))
    rows = every.join(found.withColumnRenamed("b", "activity"), ["sub", "activity"], "left").na.fill(0, ["always", "sometimes"]).crossJoin(F.broadcast(size))  # one row
    return rows.select("sub", "activity", "always", "sometimes", (F.col("size") - F.col("always") - F.col("sometimes")).alias("never"))


def permutation_p(vectors: np.ndarray, window: int, permutations: int, seed: list[int]) -> tuple[float, float]:
    """(distance of the means of the first and last ``window`` vectors, share of seeded permutations whose distance is as large)."""
    gram = vectors @ vectors.T
    side = np.where(np.arange(2 * window) < window, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    signs = np.array([side[rng.permutation(2 * window)] for _ in range(permutations)])
    observed = side @ gram @ side  # of integers, so equal distances are equal
    shuffled = np.einsum("pi,ij,pj->p", signs, gram, signs)
    return float(np.sqrt(max(0.0, observed)) / window), float((shuffled >= observed).mean())


def window_tests(features: DataFrame, window: int, permutations: int, seed: int) -> DataFrame:
    """(sub, distance, p_value): for each sub-log that has ``window`` of them before it and, with itself, after it."""
    vector = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("activity", "always", "sometimes", "never"))), lambda x: F.array(x["always"], x["sometimes"], x["never"])))
    vectors = features.groupBy("sub").agg(vector.cast("array<double>").alias("vector"))
    around = vectors.select("sub", "vector", F.explode(F.sequence(F.col("sub") - window + 1, F.col("sub") + window)).alias("center"))
    rows = around.groupBy("center").agg(F.array_sort(F.collect_list(F.struct("sub", "vector"))).alias("x")).where((F.size("x") == 2 * window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [permutation_p(np.array([y["vector"] for y in x]), window, permutations, [seed, c]) for c, x in zip(batch.column("center").to_pylist(), batch.column("x").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("center"), pa.array([d for d, _ in found], pa.float64()), pa.array([p for _, p in found], pa.float64())], ["sub", "distance", "p_value"])

    return rows.mapInArrow(run, "sub int, distance double, p_value double")


def drift_points(log: DataFrame, size: int = 50, window: int = 8, permutations: int = 100, threshold: float = 0.05, most: int = 5, seed: int = 1) -> DataFrame:
    """(sub, us, distance, p_value) of at most ``most`` sub-logs at which the process changes; us is the begin of its first case.

    Points are taken by their p-value (ties: the larger distance, then the earlier), as long as it is at most ``threshold``; each leaves
    the log before and after it to be searched again, without the tests whose windows reach across it.
    """
    subs = kept(sub_logs(log, size), "sub-logs")
    tests = kept(window_tests(follows_features(log, subs), window, permutations, seed), "tests")
    begins = subs.groupBy("sub").agg(F.min("first_us").alias("us"))
    found: list[int] = []
    while len(found) < most:
        open_ = tests.where(F.col("p_value") <= threshold)
        for s in found:
            open_ = open_.where(F.abs(F.col("sub") - s) >= window)
        best = open_.agg(F.min(F.struct("p_value", (-F.col("distance")).alias("d"), "sub")).alias("x")).first()["x"]
        if best is None:
            break
        found.append(best["sub"])
    return tests.where(F.col("sub").isin(found)).join(begins, "sub").select("sub", "us", "distance", "p_value")
