"""Nearest variants, matched times, drift, gapped segments and roles against plain versions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions.order import indexed
from caseloom.operators import drift, matching, organisation, segments
from caseloom.schema import EventSchema, canonical

SCHEMA = EventSchema("case", "act", "t", "i", "r", start="b")


def log_of(spark, traces, resource=None):
    rows, k = [], 0
    for c, trace in enumerate(traces):
        for p, a in enumerate(trace):
            rows.append((c, a, k, 1000 * c + p, resource(a, k) if resource else None))
            k += 1
    df = spark.createDataFrame(rows, "case long, act string, i long, s long, r string").withColumn("t", F.timestamp_seconds("s"))
    return canonical(df.withColumn("b", F.col("t")), SCHEMA)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("pivots", [1, 4])
def test_nearest_variants(spark, pivots):
    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("ABCD") for _ in range(rng.randint(1, most)))
    mine, theirs = [word(9) for _ in range(60)] + ["E" * 20], [word(9) for _ in range(40)] + ["ABCD", "A", "A"]
    mine += theirs[:3]
    found = matching.nearest_variants(log_of(spark, mine), log_of(spark, theirs), pivots)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    expected = {m: min((edit(m, t), list(t)) for t in set(theirs)) for m in set(mine)}
    assert {"".join(r.variant): (r.distance, r.nearest) for r in found.collect()} == expected
    assert matching.nearest_variants(log_of(spark, mine), log_of(spark, theirs).limit(0)).count() == 0


def plain_matched(events, lifo):
    """events: (activity, end, start); both directions of each pair."""
    out = []
    names = sorted({a for a, *_ in events})
    for a, b in itertools.permutations(names, 2):
        line = sorted([(t, 0, i) for i, (x, t, _) in enumerate(events) if x == a] + [(s, 1, i) for i, (x, _, s) in enumerate(events) if x == b])
        waiting = []
        for t, side, _ in line:
            if side == 0:
                waiting.append(t)
            elif waiting:
                out.append((a, b, waiting.pop(-1 if lifo else 0), t))
    return sorted(out)


@pytest.mark.parametrize("lifo", [False, True])
def test_matched_times(spark, lifo):
    rng = random.Random(8)
    events = [(rng.choice("ABC"), t + rng.randrange(4), t) for t in (rng.randrange(60) for _ in range(90))]  # many ties
    rows = [(1, a, i, e, s) for i, (a, e, s) in enumerate(events)]
    df = spark.createDataFrame(rows, "case long, act string, i long, e long, s long").withColumns({"t": F.timestamp_seconds("e"), "b": F.timestamp_seconds("s"), "r": F.lit("x")})
    found = matching.matched_times(canonical(df.repartition(3), SCHEMA), lifo)
    assert sorted((r.a, r.b, r.a_us // 10**6, r.b_us // 10**6) for r in found.collect()) == plain_matched(events, lifo)


def test_index_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice([5, rng.randrange(1000)]), i) for i in range(500)]
    found = indexed(spark.createDataFrame(rows, "a int, b int").repartition(5), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r["index"])] == sorted(rows) and sorted(r["index"] for r in found) == list(range(500))


def plain_features(traces, names):
    out = []
    for b in names:
        always = some = 0
        for a in names:
            own = [t for t in traces if a in t]
            m = sum(a in t and b in t and t.index(a) < len(t) - 1 - t[::-1].index(b) for t in own)
            always += bool(own) and m == len(own)
            some += 0 < m < len(own)
        out += [always, some, len(names) - always - some]
    return out


def test_drift_is_found_at_its_case(spark):
    rng = random.Random(3)
    early = lambda: "".join(rng.sample("ABC", 3)) + "D"
    late = lambda: "D" + "".join(rng.sample("ABC", 3))
    traces = [early() for _ in range(120)] + [late() for _ in range(120)]
    log = log_of(spark, traces)
    found = drift.drift_points(log, 10, 4, 200, 0.05).collect()
    assert [r["sub"] for r in found] == [12] and found[0].us == 120_000 * 10**6
    vectors = np.array([plain_features(traces[i : i + 10], "ABCD") for i in range(0, 240, 10)], float)
    tests = drift.window_tests(drift.follows_features(log, drift.sub_logs(log, 10)), 4, 200, 1).collect()
    assert {r["sub"]: (r.distance, r.p_value) for r in tests} == {c: drift.permutation_p(vectors[c - 4 : c + 4], 4, 200, [1, c]) for c in range(4, 21)}
    d, p = drift.permutation_p(vectors[8:16], 4, 200, [1, 12])
    assert d == pytest.approx(np.linalg.norm(vectors[8:12].mean(0) - vectors[12:16].mean(0))) and p < 0.05
    steady = log_of(spark, ["ABC", "ACB"] * 60)
    assert drift.drift_points(steady, 10, 4, 100, 0.05).count() == 0 and drift.drift_points(log.limit(0)).count() == 0


def test_segments(spark):
    rng = random.Random(6)
    traces = ["".join(rng.choice("ABC") for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["ABCA"] * 5
    found = {"".join(r.segment): r.n for r in segments.frequent_segments(log_of(spark, traces), 9).collect()}
    counts = Counter(s for t in traces for s in {"".join(c) for k in range(1, len(t) + 1) for c in itertools.combinations(t, k)})
    assert found == {s: n for s, n in counts.items() if n >= 9} and max(map(len, found)) > 2
    short = segments.frequent_segments(log_of(spark, traces), 9, 2).collect()
    assert {"".join(r.segment) for r in short} == {s for s in found if len(s) <= 2}


def plain_roles(work, threshold):
    """work: {activity: Counter of resources}; rounds of pairs that choose each other."""
    roles = {a: (set(a), Counter(r)) for a, r in work.items()}

    def like(x, y):
        a, b = roles[x][1], roles[y][1]
        m = sum(min(a[r] / a.total(), b[r] / b.total()) for r in a)
        return round(m / (2 - m), 9)

    while True:
        best = {}
        for x in roles:
            others = [(-like(x, y), min(x, y), max(x, y), y) for y in roles if y != x and like(x, y) > threshold]
            if others:
                best[x] = min(others)[3]
        pairs = [(x, y) for x, y in best.items() if x < y and best.get(y) == x]
        if not pairs:
            return sorted((x, a) for x, (acts, _) in roles.items() for a in acts)
        for x, y in pairs:
            acts, counts = roles.pop(y)
            roles[x] = (roles[x][0] | acts, roles[x][1] + counts)


@pytest.mark.parametrize("threshold", [0.1, 0.65])
def test_roles_merge(spark, threshold):
    rng = random.Random(9)
    traces = ["".join(rng.choice("ABCDEFGH") for _ in range(30)) for _ in range(12)]
    pick = lambda a, k: None if k % 17 == 0 else f"r{(ord(a) - 65) // 3 * 2 + (k * 7919) % 3}"
    log = log_of(spark, traces, pick)
    work = {}
    for r in log.where("resource IS NOT NULL").collect():
        work.setdefault(r.activity, Counter())[r.resource] += 1
    found = sorted((r.role, r.activity) for r in organisation.similar_roles(log, threshold).collect())
    assert found == plain_roles(work, threshold) and len({r for r, _ in found}) < 5
