"""Pairs along ways by lists, against plain searches; and what chains of events must leave out, told from calls and plans."""

import random

import pytest
from test_closure import plain_reach

from caseloom.functions import closure
from caseloom.operators import object_tools


def chain(*nodes):
    return list(zip(nodes, nodes[1:], strict=False))


def tree(seed, n):
    rng = random.Random(seed)
    return [(i, rng.randrange(i)) for i in range(1, n)]


GRAPHS = {
    "chains": chain(*range(40)) + chain(*range(100, 103)) + chain(900, 800),
    "long chain": chain(*range(300)),
    "ends at full lists": [link for n in (64, 65, 66, 128, 129) for link in chain(*range(n * 1000, n * 1000 + n))],
    "tree": tree(5, 400),
    "long tree": chain(*range(150)) + chain(*range(1000, 1090), 75) + chain(*range(2000, 2003), 1050),
    "fork at the end": chain(*range(150)) + [(149, 200), (149, 201)] + chain(201, *range(300, 400)),
    "fork in the middle": chain(*range(200)) + [(100, 1000)] + chain(*range(1000, 1100)),
    "forks that meet": [(0, 1), (0, 2), (1, 3), (2, 3)] + chain(*range(3, 90)),
    "loop": chain(1, 2, 3, 3) + chain(7, 8),
    "cycles": [(i, (i + 1) % 130) for i in range(130)] + [(200 + i, 200 + (i + 1) % 64) for i in range(64)] + chain(*range(500, 600), 3) + chain(700, 701, 700) + chain(*range(800, 880)),
    "mixed": [(random.Random(i).randrange(60), random.Random(-i).randrange(60)) for i in range(1, 45)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_path_pairs_equal_a_plain_version(spark, name):
    links = GRAPHS[name]
    df = spark.createDataFrame([*links, *links[:2], (None, 3), (4, None)], "x long, y long").repartition(3)
    found = sorted(map(tuple, closure.path_pairs(df, "x", "y").collect()))
    assert found == sorted((a, b) for a, seen in plain_reach(links).items() for b in seen)


def test_path_pairs_with_short_lists(spark, monkeypatch):
    monkeypatch.setattr(closure, "LIST", 4)  # steps of steps of steps
    links = chain(*range(100)) + chain(*range(200, 230), 50) + [(i, 300 + (i - 299) % 37) for i in range(300, 337)] + chain(400, 401, 310)
    df = spark.createDataFrame(links, "x long, y long")
    found = sorted(map(tuple, closure.path_pairs(df, "x", "y").collect()))
    assert found == sorted((a, b) for a, seen in plain_reach(links).items() for b in seen)


def test_chains_without_forks_join_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(closure, "transitive_closure", lambda *a: pytest.fail("ways without forks need no closure"))
    monkeypatch.setattr(object_tools, "transitive_closure", lambda *a: pytest.fail("ways without forks need no closure"), raising=False)
    links = spark.createDataFrame(chain(*range(30)) + chain(50, 51, 20), "eid long, eid_2 long")
    found = object_tools.linked_chains(links)
    assert found.count() == 30 * 29 // 2 + 11 + 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # pairs come from the lists where they lie


def test_first_links_go_through_a_value_once(spark):
    rows = [(e, (e * 7) % 20 // 2, f"v{e % 3}", f"v{e % 4}") for e in range(40)] + [(3, 5, "v1", "v1"), (90, 1, None, "v0"), (91, 1, "v0", None)]
    events = spark.createDataFrame(rows, "eid long, us long, i string, o string")
    found = object_tools.first_links(events, "o", "i")
    into = sorted((us, e, i) for e, us, i, _ in rows if i)
    want = [(e, next((x for u, x, i in into if i == o and (u, x) > (us, e)), None)) for e, us, _, o in rows if o]
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a, b in want if b is not None)
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan  # each row would look through all that follow it
