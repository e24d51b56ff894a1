"""Steps whose work must not grow faster than their input: what they leave out is told from their plans and calls."""

import random

import pytest

from caseloom.operators import object_filters, object_tools, relations
from caseloom.operators.objects import ObjectLog


def object_log(spark, pairs):
    relations_ = spark.createDataFrame(pairs, "eid long, oid string")
    events = relations_.select("eid").distinct().selectExpr("eid", "IF(eid % 2 = 0, 'even', 'odd') AS activity", "eid AS us")
    return ObjectLog(events, relations_.select("oid").distinct().selectExpr("oid", "left(oid, 1) AS type"), relations_)


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    at = {}
    for e, o in pairs:
        at.setdefault(e, set()).add(o)
    for objects in at.values():
        for o in objects:
            a, b = find(o), find(min(objects))
            root[max(a, b)] = min(a, b)
    shared = {o for objects in at.values() if len(objects) > 1 for o in objects}
    return {o: find(o) for o in shared}


def test_objects_of_one_hub_are_not_contracted(spark, monkeypatch):
    pairs = [(e, o) for e in range(12) for o in (f"c{e // 4}", f"i{e}a", f"i{e}b")] + [(99, "alone")]
    monkeypatch.setattr(object_filters, "components", lambda *a: pytest.fail("a forest of stars has nothing to contract"))
    found = {r.oid: r.component for r in object_filters.object_components(object_log(spark, pairs)).collect()}
    assert found == plain_components(pairs)


@pytest.mark.parametrize("seed", range(4))
def test_object_components_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    pairs = list({(rng.randrange(40), f"o{rng.randrange(60)}") for _ in range(60)}) + [(100 + k, f"p{k + d}") for k in range(9) for d in (0, 1)]
    log = object_log(spark, pairs)
    found = {r.oid: r.component for r in object_filters.object_components(log).collect()}
    expected = plain_components(pairs)
    assert found == expected
    held = {}
    for e, o in pairs:
        if o in expected:
            held.setdefault(expected[o], set()).update({(f"type {o[0]}", o), (f"activity {'even' if e % 2 == 0 else 'odd'}", e)})
    profiles = sorted(", ".join(sorted(f"{w}={sum(x[0] == w for x in of)}" for w in {x[0] for x in of})) for of in held.values())
    assert sorted(r.profile for r in object_tools.component_profiles(log).collect() for _ in range(r.n)) == profiles


def test_temporal_deviations_shuffle_no_pairs(spark):
    rows = [("c", "ab"[k % 2], k, k * k * 1_000_000, k * k * 1_000_000) for k in range(8)]
    log = spark.createDataFrame(rows, "case_id string, activity string, event_idx long, us long, start_us long")
    profile = spark.createDataFrame([(a, b, 5.0, 1.0) for a in "ab" for b in "ab"], "a string, b string, mean_s double, stdev_s double")
    found = relations.temporal_deviations(log, profile, 2)
    gaps = [("ab"[i % 2], "ab"[j % 2], float(j * j - i * i)) for i in range(8) for j in range(i + 1, 8)]
    assert sorted((r.a, r.b, r.gap, r.score) for r in found.collect()) == sorted((a, b, g, abs(g - 5)) for a, b, g in gaps if abs(g - 5) > 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" not in plan  # pairs met the profile by (a, b)


def test_temporal_deviations_broadcast_no_cases(spark, tmp_path):
    rows = [(c, "ab"[k % 2], k, k * k * 1_000_000, k * k * 1_000_000) for c in range(5) for k in range(8)] + [(9, "z", 0, 0, 0), (9, "a", 1, 10**9, 10**9)]
    spark.createDataFrame(rows, "case_id long, activity string, event_idx long, us long, start_us long").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")  # small files: Spark took a case's array, once an event, for a table to broadcast
    profile = spark.createDataFrame([(a, b, 5.0, 1.0) for a in "ab" for b in "ab"] + [("q", "a", 0.0, 0.0)], "a string, b string, mean_s double, stdev_s double")
    profile.write.parquet(f"{tmp_path}/profile")
    found = relations.temporal_deviations(log, spark.read.parquet(f"{tmp_path}/profile"), 2)
    gaps = [(c, "ab"[i % 2], "ab"[j % 2], float(j * j - i * i)) for c in range(5) for i in range(8) for j in range(i + 1, 8)]
    assert sorted((r.case_id, r.a, r.b, r.gap) for r in found.collect()) == sorted(g for g in gaps if abs(g[3] - 5) > 2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
