"""Shares of tasks that must not grow with the tables, whatever the session's number of partitions."""

import random
from collections import defaultdict

import pytest

from caseloom.functions import tables
from caseloom.operators import object_tools, objects
from caseloom.plans import catalog

N = 9


@pytest.fixture
def tiny_shares(spark, tmp_path, monkeypatch):
    """A log read from files of N shares."""
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(60), f"{rng.choice('ab')}{rng.randrange(25)}") for _ in range(240)})
    spark.createDataFrame(pairs, "eid long, oid string").coalesce(1).write.parquet(f"{tmp_path}/relations")
    relations = spark.read.parquet(f"{tmp_path}/relations")
    size = sum(p.stat().st_size for p in (tmp_path / "relations").glob("*.parquet"))
    monkeypatch.setattr(tables, "PART_BYTES", -(-size // N))
    events = spark.createDataFrame([(e, "xyz"[e % 3], e // 4) for e in range(60)], "eid long, activity string, us long")
    kinds = spark.createDataFrame([(o, o[0]) for o in sorted({o for _, o in pairs})], "oid string, type string")
    return pairs, objects.ObjectLog(events, kinds, relations)


def test_partitions_grow_with_the_files(spark, tiny_shares, monkeypatch):
    _, log = tiny_shares
    assert tables.many(log.relations) == (N,)
    assert tables.many(log.relations, log.relations) == (N,)  # a file counts once
    monkeypatch.setattr(tables, "PART_BYTES", 1 << 30)
    assert tables.many(log.relations) == ()  # the session's own number is enough
    assert tables.many(log.events) == ()  # no files


def dealt_by(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_object_dfg_in_shares_equals_a_plain_version(tiny_shares):
    pairs, log = tiny_shares
    lives = defaultdict(list)
    for e, o in pairs:
        lives[o].append((e // 4, e))
    edges = defaultdict(list)
    for o, life in lives.items():
        life.sort()
        for (u, e), (v, f) in zip(life, life[1:]):
            edges[o[0], "xyz"[e % 3], "xyz"[f % 3]].append((o, e, f, (v - u) / 1e6))
    found = objects.object_dfg(log)
    expected = {k: (len({x[1:3] for x in xs}), len({x[0] for x in xs}), len(xs), pytest.approx(sum(x[3] for x in xs) / len(xs))) for k, xs in edges.items()}
    assert {(r.type, r.a, r.b): (r.n_couples, r.n_objects, r.n_total, r.mean_s) for r in found.collect()} == expected
    plan = dealt_by(found)
    assert "Expand" not in plan  # rows were doubled for the two distinct counts
    assert "hashpartitioning(eid" in plan and f", {N})" in plan


def test_pairs_of_objects_in_shares_equal_a_plain_version(tiny_shares):
    pairs, log = tiny_shares
    at = defaultdict(set)
    for e, o in pairs:
        at[e].add(o)
    together, related = defaultdict(int), defaultdict(set)
    for group in at.values():
        for x in group:
            for y in group - {x}:
                together[x, y] += x < y
                related[x, y[0]].add(y)
    found = objects.interactions(log)
    assert {(r.o1, r.o2): r.n_events for r in found.collect()} == {k: n for k, n in together.items() if n}
    assert f"{N})" in next(line for line in dealt_by(found).splitlines() if "hashpartitioning(o1" in line)
    found = object_tools.related_objects(log)
    assert {(r.oid, r.type): r.n for r in found.collect()} == {k: len(v) for k, v in related.items()}
    assert f"{N})" in next(line for line in dealt_by(found).splitlines() if "hashpartitioning(oid" in line and "other" in line)


def test_relations_and_objects_of_the_catalog_are_dealt_in_shares(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 10_000)
    log = catalog.object_log(spark, "/root/testdata/sf0.001")
    n = tables.many(log.relations)[0]
    assert n > 4
    assert log.relations.rdd.getNumPartitions() == n
    assert log.objects.rdd.getNumPartitions() == n
    assert object_tools.consistent(log).relations.rdd.getNumPartitions() == n  # no other exchange
    assert object_tools.without_duplicates(log).relations.rdd.getNumPartitions() <= n


def test_features_of_objects_go_through_relations_once(tiny_shares):
    pairs, log = tiny_shares
    known = [o for o in sorted({o for _, o in pairs}) if o != "a1"]
    log = objects.ObjectLog(log.events, log.objects.where("oid <> 'a1'").union(log.objects.where("oid = 'b2'")), log.relations)  # "a1" counts at its events only, "b2" once
    at, lives = defaultdict(set), defaultdict(list)
    for e, o in pairs:
        at[e].add(o)
        lives[o].append((e // 4, e))
    first, last = ({o: f(lives[o]) for o in known} for f in (min, max))
    expected = {
        (o, len(lives[o]), len({"xyz"[e % 3] for _, e in lives[o]}), first[o][0], last[o][0], (last[o][0] - first[o][0]) / 1e6)
        + (list(first.values()).count(first[o]), list(last.values()).count(last[o]), max(len(at[e]) for _, e in lives[o]))
        for o in known
    }
    found = object_tools.object_features(log)
    plan = dealt_by(found)
    assert plan.count("Scan parquet") == 1  # each of three aggregations went through them, and again for the objects at an event
    assert {tuple(r) for r in found.collect()} == expected
    assert f"{N})" in next(line for line in plan.splitlines() if "hashpartitioning(oid" in line)


def test_items_of_the_catalog_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 10_000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of any size
    try:
        log = catalog.object_log(spark, "/root/testdata/sf0.001")
        plan = dealt_by(log.relations)
        n = tables.many(log.relations)[0]
        assert plan.count("Exchange hashpartitioning") == 3 and plan.count(f", {n})") >= 3  # orders, items, customers of orders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
