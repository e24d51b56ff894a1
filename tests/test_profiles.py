"""Temporal profiles of events with lengths against all pairs, log skeletons against their definition."""

import random
import statistics

import pytest

from caseloom.operators.conformance import skeleton_conformance
from caseloom.operators.declarative import skeleton
from caseloom.operators.relations import point_profile, temporal_profile


def intervals(spark, seed, cases=12, atomic=False):
    pick = random.Random(seed)
    rows = []
    for c in range(cases):
        for i in range(pick.randint(1, 9)):
            end = pick.randint(0, 12) * 1_000_000 + 10**15
            rows.append((f"c{c}", pick.choice("abc"), end, i, end if atomic else end - pick.choice([0, 0, 1, 3]) * 1_000_000))
    return rows, spark.createDataFrame(rows, "case_id string, activity string, us long, event_idx long, start_us long")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("atomic", [False, True])
def test_profile_equals_all_pairs(spark, seed, atomic):
    rows, log = intervals(spark, seed, atomic=atomic)
    gaps = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[3]))
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                if x[2] <= y[4]:
                    gaps.setdefault((x[1], y[1]), []).append((y[4] - x[2]) / 1e6)
    expected = {k: (len(g), round(statistics.fmean(g), 9), round(statistics.stdev(g) if len(g) > 1 else 0.0, 7)) for k, g in gaps.items()}
    for profile in (temporal_profile, point_profile) if atomic else (temporal_profile,):
        assert {(r.a, r.b): (r.n, round(r.mean_s, 9), round(r.stdev_s, 7)) for r in profile(log).collect()} == expected


def test_short_gaps_late_in_a_long_case_keep_their_digits(spark):
    day = 86_400_000_000
    rows = [("c", "a", 0, 0, 0), ("c", "x", 3000 * day, 1, 3000 * day), ("c", "y", 3000 * day + 1000, 2, 3000 * day + 1000), ("c", "y", 3000 * day + 3000, 3, 3000 * day + 3000)]
    log = spark.createDataFrame(rows, "case_id string, activity string, us long, event_idx long, start_us long")
    found = {(r.a, r.b): r for r in temporal_profile(log).collect()}
    assert found["x", "y"].n == 2 and found["x", "y"].mean_s == pytest.approx(0.002) and found["x", "y"].stdev_s == pytest.approx(statistics.stdev([0.001, 0.003]))


def plain_skeleton(traces, noise):
    events = {a: sum(t.count(a) for t in traces) for t in traces for a in t}
    found = set()
    for a in events:
        for b in events:
            later = sum(any(x == a and y == b for i, x in enumerate(t) for y in t[i + 1 :]) for t in traces)
            sooner = sum(any(x == b and y == a for i, x in enumerate(t) for y in t[i + 1 :]) for t in traces)
            counts = {
                "equivalence": 0 if a == b else sum(t.count(a) for t in traces if t.count(a) == t.count(b)),
                "always_after": later,
                "always_before": sooner,
                "never_together": 0 if a == b else events[a] - sum(a in t and b in t for t in traces),
                "directly_follows": sum(x == a and y == b for t in traces for x, y in zip(t, t[1:], strict=False)),
            }
            found |= {(k, a, b) for k, n in counts.items() if n > 0 and n >= events[a] * (1 - noise)}
    return found


@pytest.mark.parametrize("noise", [0.0, 0.25, 0.5, 1.0])
def test_skeleton_equals_its_definition(spark, noise):
    pick = random.Random(3)
    traces = ["".join(pick.choice("abcd") for _ in range(pick.randint(1, 5))) for _ in range(15)] + ["xy", "xy", "xzy"]
    rows = [(str(c), a, i, i, i) for c, t in enumerate(traces) for i, a in enumerate(t)]
    log = spark.createDataFrame(rows, "case_id string, activity string, us long, event_idx long, start_us long")
    assert {tuple(r) for r in skeleton(log, noise).select("relation", "a", "b").collect()} == plain_skeleton(traces, noise)


def test_numbers_of_occurrences_are_constraints(spark):
    rows = [("1", "a", 0, 0), ("1", "b", 1, 1), ("2", "b", 0, 0), ("2", "b", 1, 1), ("3", "q", 0, 0)]
    log = spark.createDataFrame(rows, "case_id string, activity string, us long, event_idx long")
    model = spark.createDataFrame([("always_after", "a", "b")], "relation string, a string, b string")
    times = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "activity string, times long")
    found = {r.case_id: (r.n_constraints, r.n_deviations, r.is_fit) for r in skeleton_conformance(log, model, times).collect()}
    assert found == {"1": (3, 0, True), "2": (1, 1, False), "3": (2, 2, False)}
