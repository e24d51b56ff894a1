"""Transitive closure, reach and the object-centric tools on it, against plain searches."""

import random

import pytest

from caseloom.functions.closure import reach_from, transitive_closure
from caseloom.operators import object_tools
from caseloom.operators.objects import ObjectLog


def plain_reach(links):
    to = {}
    for a, b in links:
        to.setdefault(a, set()).add(b)
    out = {}
    for a in to:
        seen, front = set(), set(to[a])
        while front:
            seen |= front
            front = {y for x in front for y in to.get(x, ())} - seen
        out[a] = seen
    return out


def graph(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("links", [graph(1, 30, 35), graph(2, 40, 90), [(0, 0), (1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (5, 1), (5, 5)], [(i, (i + 1) % 50) for i in range(50)] + [(7, 100), (100, 101)]])
def test_closure_with_cycles(spark, links):
    df = spark.createDataFrame([*links, links[0], (None, 3)], "x int, y int").repartition(3)
    found = transitive_closure(df, "x", "y")
    want = plain_reach(links)
    assert sorted(map(tuple, found.expanded().collect())) == sorted((a, b) for a, seen in want.items() for b in seen)
    nodes = {x for link in links for x in link}
    part = {a: min([a, *(b for b in want.get(a, ()) if a in want.get(b, ()))]) for a in nodes}
    assert {(r.id, r.part, r.cyclic) for r in found.members.collect()} == {(a, part[a], a in want.get(a, ())) for a in nodes}
    some = sorted(nodes)[::3]
    reached = reach_from(df.toDF("a", "b"), spark.createDataFrame([(s,) for s in some], "id int"))
    assert sorted(map(tuple, reached.collect())) == sorted((s, b) for s in some for b in want.get(s, ()))


def test_closure_of_a_long_chain(spark):
    found = transitive_closure(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a int, b int"), "a", "b")
    assert found.pairs.count() == 1000 * 1001 // 2 and found.members.where("cyclic").count() == 0
    assert transitive_closure(spark.createDataFrame([], "a int, b int"), "a", "b").expanded().count() == 0


def object_log(spark, rows, types):
    """rows: (eid, activity, us, oids)."""
    events = spark.createDataFrame([r[:3] for r in rows], "eid long, activity string, us long")
    relations = spark.createDataFrame([(r[0], o) for r in rows for o in r[3]], "eid long, oid string")
    return ObjectLog(events, spark.createDataFrame(list(types.items()), "oid string, type string"), relations)


def test_duplicates_merge_along_chains(spark):
    log = object_log(spark, [(1, "a", 5, ["o1"]), (2, "a", 5, ["o1", "o2"]), (3, "a", 5, ["o2"]), (4, "a", 6, ["o2"]), (5, "b", 5, ["o2"]), (6, "a", 5, ["o9"])], {"o1": "x", "o2": "x", "o9": "y"})
    merged = object_tools.merged_duplicates(log)
    assert sorted(map(tuple, merged.relations.collect())) == [(1, "o1"), (1, "o2"), (4, "o2"), (5, "o2"), (6, "o9")]
    assert sorted(r.eid for r in merged.events.collect()) == [1, 4, 5, 6]


def test_relatives_and_chains(spark):
    rows = [(1, "a", 1, ["x1", "p1"]), (2, "a", 2, ["x1", "p2"]), (3, "a", 3, ["p2", "x2"]), (4, "a", 4, ["x2", "p3"]), (5, "a", 9, ["x3"])]
    log = object_log(spark, rows, {"x1": "x", "x2": "x", "x3": "x", "p1": "p", "p2": "p", "p3": "p"})
    found = {}
    for r in object_tools.relatives(log, "x").collect():
        found.setdefault(r.central, set()).add(r.oid)
    # x1 and p1 begin together, so x1, of the type, is the parent; x1 -> p2 -> x2 -> p3.
    assert found == {"x1": {"x1", "p1", "p2", "x2", "p3"}, "x2": {"x1", "p2", "x2", "p3"}, "x3": {"x3"}}
    events = spark.createDataFrame([(1, 1, "a", "b"), (2, 2, "b", "c"), (3, 3, "b", "a"), (4, 0, "z", "b"), (5, 5, None, None)], "eid long, us long, i string, o string")
    links = object_tools.first_links(events, "o", "i")
    assert sorted(map(tuple, links.collect())) == [(1, 2), (4, 2)]
    more = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 9)], "eid long, eid_2 long")
    assert len(object_tools.linked_chains(more).collect()) == 12
