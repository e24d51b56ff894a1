"""Label splitting against a plain version of its graph and on planted contexts."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators.labels import communities, contexts, similar_contexts, split_labels


def log_of(spark, traces):
    rows = [(f"c{k}", a, i, i) for k, t in enumerate(traces) for i, a in enumerate(t)]
    return spark.createDataFrame(rows, "case_id string, activity string, us long, event_idx long")


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def around(traces):
    found = {}
    for t in traces:
        for i, a in enumerate(t):
            key = a, (*t[max(0, i - 2) : i], *t[i + 1 : i + 3])
            found[key] = found.get(key, 0) + 1
    return found


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.8])
def test_likeness_equals_all_pairs(spark, least):
    pick = random.Random(int(least * 10))
    traces = [[pick.choice("abcde") for _ in range(pick.randint(1, 7))] for _ in range(40)]
    nodes = contexts(log_of(spark, traces))
    rows = {r.node: (r.activity, tuple(r.context)) for r in nodes.collect()}
    plain = around(traces)
    assert {(r.activity, tuple(r.context)): r.n for r in nodes.collect()} == plain
    assert [rows[k] for k in sorted(rows)] == sorted(plain)
    expected = {}
    for u, (a, x) in rows.items():
        for v, (b, y) in rows.items():
            if u < v and a == b:
                weight = 1 - distance(x, y) / max(len(x), len(y))
                if weight > least:
                    expected[u, v] = round(weight, 9)
    assert {(r.u, r.v): round(r.weight, 9) for r in similar_contexts(nodes, least).collect()} == expected


def test_two_contexts_are_split_and_others_stay(spark):
    one, two = ["a", "b", "check", "c", "d"], ["p", "q", "check", "r", "s"]
    traces = [one] * 6 + [["a", "b", "check", "c", "e"]] * 2 + [two] * 3 + [["o", "q", "check", "r", "s"]]
    log = log_of(spark, traces).withColumn("row", F.lit("own")).withColumn("context", F.lit(7))
    out = split_labels(log)
    assert out.columns == [*log.columns, "label"]
    rows = out.collect()
    assert len(rows) == sum(map(len, traces)) and {(r.row, r.context) for r in rows} == {("own", 7)}
    label = {int(r.case_id[1:]): r.label for r in rows if r.activity == "check"}
    assert label == {k: "check_0" if k < 8 else "check_1" for k in range(12)}
    assert {r.label for r in rows if r.activity == "b"} == {"b"} and {r.label for r in rows if r.activity == "q"} == {"q"}
    only = split_labels(log, activities=["a"], column="activity").where("activity LIKE 'check%'")
    assert {r.activity for r in only.collect()} == {"check"} and only.columns == [c for c in log.columns if c != "activity"] + ["activity"]


def plain_communities(n, links, moves):
    """moves(turn, node) says who may move."""
    label, near = {k: k for k in n}, {k: [] for k in n}
    for (u, v), w in links.items():
        near[u].append((v, w * n[v]))
        near[v].append((u, w * n[u]))
    for turn in range(20):
        to = {}
        for u, others in near.items():
            told = {}
            for v, w in others:
                told[label[v]] = told.get(label[v], 0) + w
            told = {k: round(x, 6) for k, x in told.items()}
            if told:
                best = min(told, key=lambda k: (-told[k], k))
                if told[best] > told.get(label[u], 0):
                    to[u] = best
        if not to:
            break
        label |= {u: x for u, x in to.items() if moves(turn, u)}
    first = {}
    for u in sorted(label):
        first.setdefault(label[u], u)
    return {u: first[x] for u, x in label.items()}


def test_communities_equal_a_plain_version(spark):
    pick = random.Random(5)
    n = {k: pick.randint(1, 9) for k in range(30)}
    links = {(u, v): pick.choice([0.25, 0.5, 0.75]) for u in n for v in n if u < v and pick.random() < (0.5 if u % 3 == v % 3 else 0.05)}
    links = {k: w for k, w in links.items() if 29 not in k}
    spark.range(20).createOrReplaceTempView("turns")
    spark.range(30).createOrReplaceTempView("places")
    may = {(r[0], r[1]) for r in spark.sql("SELECT CAST(turns.id AS INT), places.id FROM turns CROSS JOIN places WHERE pmod(xxhash64(CAST(turns.id AS INT), places.id), 2) = 0").collect()}
    nodes = spark.createDataFrame(list(n.items()), "node long, n long")
    edges = spark.createDataFrame([(*k, w) for k, w in links.items()], "u long, v long, weight double")
    found = {r.node: r.community for r in communities(nodes, edges).collect()}
    assert found == plain_communities(n, links, lambda turn, u: (turn, u) in may)
    assert found[29] == 29 and len(set(found.values())) < 15


def test_empty_log_and_lone_events(spark):
    empty = log_of(spark, [["a"]]).where("false")
    assert split_labels(empty).count() == 0
    lone = split_labels(log_of(spark, [["a"], ["a"], ["b"]]))
    assert sorted(r.label for r in lone.collect()) == ["a", "a", "b"]
