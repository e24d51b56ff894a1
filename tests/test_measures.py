"""Log-wide measures against plain versions on small logs with ties, intervals and few ranges; deviations of a stream."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import discovery, filters, relations, statistics
from caseloom.schema import EventSchema, canonical
from caseloom.streaming.relations import stream_deviations, stream_edges

SCHEMA = EventSchema("case", "act", "t", "i", start="s")


def log_of(spark, events):
    """events: (case, activity, start second, end second)."""
    rows = [(c, a, k, s, e) for k, (c, a, s, e) in enumerate(events)]
    df = spark.createDataFrame(rows, "case long, act string, i long, s0 long, s1 long")
    return canonical(df.withColumn("t", F.timestamp_seconds("s1")).withColumn("s", F.timestamp_seconds("s0")), SCHEMA)


def some_events(seed, n=120, longest=5):
    rng = random.Random(seed)
    return [(rng.randrange(6), rng.choice("ABC"), s, s + rng.randrange(longest + 1)) for s in (rng.randrange(90) for _ in range(n))]


@pytest.mark.parametrize("buckets", [2, 16])
def test_precede_succeed(spark, buckets):
    events = some_events(1)
    found = {(r.a, r.b): r.share for r in statistics.precede_succeed(log_of(spark, events), buckets).collect()}
    expected = {}
    for a, b in itertools.permutations("ABC", 2):
        x, y = [e for _, k, _, e in events if k == a], [s for _, k, s, _ in events if k == b]
        expected[a, b] = sum(e < s for e in x for s in y) / (len(x) * len(y))
    assert found == pytest.approx(expected)
    assert statistics.precede_succeed(log_of(spark, events).limit(0), buckets).count() == 0


@pytest.mark.parametrize("buckets", [2, 16])
@pytest.mark.parametrize("events", [some_events(2, 30, 2), some_events(3, 30, 0), [(1, "A", 0, 9), (1, "B", 2, 3), (2, "A", 9, 10), (2, "B", 20, 20)]])
def test_cycle_time(spark, events, buckets):
    stretches = []
    for s, e in sorted((s, e) for _, _, s, e in events):
        if stretches and s <= stretches[-1][1]:
            stretches[-1][1] = max(e, stretches[-1][1])
        else:
            stretches.append([s, e])
    n = len({c for c, *_ in events})
    log = log_of(spark, events)
    assert statistics.cycle_time(log, True, buckets).first()[0] == pytest.approx(sum(e - s for s, e in stretches) / n)
    assert statistics.cycle_time(log, False, buckets).first()[0] == pytest.approx(sum(e - s for s, e in stretches[:-1]) / n)


def test_cycle_time_of_no_events(spark):
    assert statistics.cycle_time(log_of(spark, [(1, "A", 0, 0)]).limit(0)).first()[0] is None


def test_kernel_density(spark):
    values = [0.0, 1.0, 1.0, 4.0, 10.0, None]
    found = {round(r.x, 9): r.density for r in statistics.kernel_density(spark.createDataFrame([(v,) for v in values], "value double"), 10).collect()}
    x = [v for v in values if v is not None]
    mean = sum(x) / len(x)
    h = math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)) * len(x) ** -0.2
    places = {round(k * 2.5, 9) for k in range(5)} | {round(1e-6 * 1e7 ** (k / 4), 9) for k in range(5)}
    assert set(found) == places
    for p, d in found.items():
        assert d == pytest.approx(sum(math.exp(-(((p - v) / h) ** 2) / 2) for v in x) / (len(x) * h * math.sqrt(2 * math.pi)), abs=1e-7)
    for few in ([], [(None,)], [(3.0,), (3.0,)]):
        assert statistics.kernel_density(spark.createDataFrame(few, "value double")).count() == 0


def test_first_following(spark):
    log = log_of(spark, [(1, "A", t, t) for t in (0, 5)] + [(1, "B", 7, 7), (1, "A", 9, 9), (2, "B", 1, 1)])
    found = sorted((r.event_idx, r.a, r.b, r.gap) for r in relations.first_following(log).collect())
    assert found == [(0, "A", "A", 5.0), (0, "A", "B", 7.0), (1, "A", "A", 4.0), (1, "A", "B", 2.0), (2, "B", "A", 2.0)]


def test_precision_of_a_long_case(spark):
    log = log_of(spark, [(1, "AB"[t % 2], t, t) for t in range(3000)] + [(2, "A", 0, 0), (2, "C", 1, 1)])
    # Both moves are taken after the first A; every later A could go to C and never does, nor does the last B go to A.
    wasted, allowed = 1499 + 1, 2 * 2 + 1499 * 2 + 1500
    assert discovery.dfg_precision(log, relations.dfg(log)).first()[0] == pytest.approx(1 - wasted / allowed)


def test_between(spark):
    log = log_of(spark, [(1, a, t, t) for t, a in enumerate("bxaxaybzaxb a".replace(" ", "z") + "q")])
    found = sorted((r.case_id, r.event_idx) for r in filters.between(log, "a", "b").collect())
    assert found == [("1##@@0", k) for k in (2, 3, 4, 5, 6)] + [("1##@@1", k) for k in (8, 9, 10)]


def test_stream_deviations(spark, tmp_path):
    rows = [("1", "A", 0), ("1", "B", 10), ("1", "C", 11), ("2", "A", 0), ("2", "B", 100), ("3", "A", 0), ("3", "B", 1), ("4", "B", 5)]
    table = spark.createDataFrame(rows, "case_id string, activity string, s long").select("case_id", "activity", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    profile = spark.createDataFrame([("A", "B", 10.0, 2.0)], "a string, b string, mean_s double, stdev_s double")
    stream = stream_deviations(stream_edges(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")), profile, 1.5)
    query = stream.writeStream.format("memory").queryName("deviations").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    found = {(r.case_id, r.a, r.b): r.deviation for r in spark.table("deviations").collect()}
    assert found == {("1", None, "A"): None, ("2", None, "A"): None, ("3", None, "A"): None, ("4", None, "B"): None, ("1", "A", "B"): None, ("1", "B", "C"): "unknown", ("2", "A", "B"): "slow", ("3", "A", "B"): "fast"}
