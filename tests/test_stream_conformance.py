"""Streamed conformance against its batch forms, however the stream is cut."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import conformance, relations
from caseloom.schema import EventSchema, canonical
from caseloom.streaming import conformance as streamed
from caseloom.streaming.replay import replayed

SCHEMA = EventSchema("case", "act", "t", "i")
RULES = [(t, a, b) for t in (*conformance.BY_A, *conformance.BY_B, *conformance.BY_EITHER) for a, b in (("A", "B"), ("B", "C"), ("C", "A"), ("A", "Z"))]
RULES += [(t, a, None) for t in conformance.UNARY for a in "ABZ"]
BASE = 1_700_000_000


def events_of(seed, n_cases=14):
    rng = random.Random(seed)
    out = []
    for c in range(n_cases):
        t = rng.randrange(400)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            t += rng.choice([0, 1, 7, 40, 90])
            out.append((c, rng.choice("ABC"), len(out), t))
    return out


def frame(spark, events):
    return spark.createDataFrame([(str(c), a, i, BASE + t) for c, a, i, t in events], "case string, act string, i long, s long").withColumn("t", F.timestamp_seconds("s"))


def slices_of(spark, events, cuts, late, seed):
    """The events in arrival order (each up to ``late`` seconds late) cut into batches, then a row that moves the watermark on."""
    rng = random.Random(seed)
    arrived = sorted(events, key=lambda e: (e[3] + rng.uniform(0, late), rng.random()))
    at = sorted(rng.sample(range(1, len(arrived)), cuts))
    rows = lambda part: frame(spark, part).selectExpr("case AS case_id", "act AS activity", "t AS ts", "i AS event_idx")
    parts = [rows(arrived[a:b]) for a, b in zip([0, *at], [*at, len(arrived)], strict=True)]
    last = max(e[3] for e in events)
    return [*parts, rows([(0, None, 0, last + 5000)]).withColumn("case_id", F.lit(None).cast("string"))]


@pytest.mark.parametrize("seed,cuts", [(1, 1), (2, 3)])
def test_declare_stream_equals_batch(spark, seed, cuts):
    events = events_of(seed)
    model = spark.createDataFrame(RULES, "template string, a string, b string")
    found = replayed(slices_of(spark, events, cuts, 60, seed), lambda s: streamed.stream_declare_deviations(s, model, "2000 seconds", "90 seconds")).collect()
    log = canonical(frame(spark, events), SCHEMA)
    expected = sorted(map(tuple, conformance.declare_deviations(log, model).collect()), key=repr)
    assert sorted(((r.case_id, r.template, r.a, r.b) for r in found), key=repr) == expected
    # A breach that is not final stays whatever follows: every longer prefix of the case has it.
    assert {r.final for r in found} == {True, False}
    for r in found:
        own = sorted((t, i, a) for c, a, i, t in events if str(c) == r.case_id)
        if r.final:
            assert r.us == (BASE + own[-1][0]) * 1_000_000
        else:
            assert r.us in [(BASE + t) * 1_000_000 for t, *_ in own]


def test_certain_breaches_are_told_early(spark):
    events = [(1, "B", 0, 0), (1, "A", 1, 10), (1, "A", 2, 20), (1, "B", 3, 500)]
    model = spark.createDataFrame([("precedence", "A", "B"), ("absence", "A", None), ("exactly_one", "A", None), ("response", "A", "B"), ("init", "A", None), ("existence", "C", None)], "template string, a string, b string")
    parts = slices_of(spark, events, 1, 0, 1)
    found = {r.template: (r.us // 1_000_000 - BASE, r.final) for r in replayed(parts, lambda s: streamed.stream_declare_deviations(s, model, "2000 seconds", "1 second")).collect()}
    assert found == {"precedence": (0, False), "init": (0, False), "absence": (10, False), "exactly_one": (20, False), "existence": (500, True)}


def test_footprints_and_times_of_a_stream_equal_batch(spark):
    events = events_of(5, 20)
    log = canonical(frame(spark, events), SCHEMA)
    steps = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "C")], "a string, b string")
    ends = spark.createDataFrame([("A",), ("C",)], "activity string")
    parts = slices_of(spark, events, 2, 60, 5)
    found = replayed(parts, lambda s: streamed.stream_footprint_deviations(s, steps, ends, ends, "2000 seconds", "90 seconds"))
    expected = conformance.footprint_deviations(log, steps, ends, ends)
    order = lambda df: sorted((tuple(r) for r in df.select("case_id", "kind", "a", "b", "us").collect()), key=repr)
    assert order(found) == order(expected) and {k for _, k, *_ in order(found)} == {"start", "step", "end"}
    profile = relations.temporal_profile(log)
    found = replayed(parts, lambda s: streamed.stream_temporal_deviations(s, profile, 1, "2000 seconds", "90 seconds"))
    key = lambda r: (r.case_id, r.a, r.b, round(r.gap, 6), round(r.score or 0, 6))
    rows = sorted(map(key, relations.temporal_deviations(log, profile, 1).collect()))
    assert rows and sorted(map(key, found.collect())) == rows


def test_a_model_that_is_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(streamed, "MOST_RULES", 2)
    with pytest.raises(ValueError):
        streamed._rows(spark.range(3), "id")
