"""Calls of the state store that a streamed case makes: each goes from the worker to the JVM."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from caseloom.plans import stream_catalog
from caseloom.streaming.conformance import DeclareMonitor, FootprintMonitor, TemporalMonitor

MONITORS = [
    lambda idle: DeclareMonitor([("response", "A", "B"), ("absence", "C", None)], idle),
    lambda idle: FootprintMonitor({("A", "B")}, {"A"}, {"B"}, idle),
    lambda idle: TemporalMonitor({("A", "B"): (1.0, 0.1)}, 2, idle),
]


class Store:
    """A handle with one value state; any other state is an error."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


def at(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


@pytest.mark.parametrize("made", MONITORS)
def test_a_batch_reads_and_writes_a_case_once(made):
    store, monitor = Store(), made("10 seconds")
    monitor.init(store)
    event = lambda s, a: Row(us=s * 1_000_000, event_idx=s, activity=a)
    assert list(monitor.handleInputRows(("c",), iter([event(1, "A"), event(2, "C")]), at(0))) == []
    assert store.calls == ["get", "update", "timer"] or store.calls == ["get", "timer", "update"]
    out = list(monitor.handleInputRows(("c",), iter([event(9, "B")]), at(5000)))
    assert store.calls[3:] == ["get", "update"]
    (timer,) = store.timers
    assert timer == 12_001
    # The case has gone on meanwhile: its timer is moved on to 10 s after its last event, and it stays.
    out += monitor.handleExpiredTimer(("c",), at(timer), None)
    assert store.calls[5:] == ["get", "timer"] and store.timers[1] == 19_001 and store.value is not None
    out += monitor.handleExpiredTimer(("c",), at(19_001), None)
    assert store.calls[7:] == ["get", "clear"] and store.value is None
    if isinstance(monitor, DeclareMonitor):
        assert [(r.template, r.us, r.final) for r in out] == [("absence", 2_000_000, False)]
    elif isinstance(monitor, FootprintMonitor):
        assert [(r.kind, r.a, r.b) for r in out] == [("step", "A", "C"), ("step", "C", "B")]
    else:
        assert [(r.a, r.b, r.gap) for r in out] == [("A", "B", 8.0)]


def test_models_are_made_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(stream_catalog, "replayed", lambda slices, transform: [transform(None) for _ in range(4)])
    monkeypatch.setattr(stream_catalog.streamed, "stream_footprint_deviations", lambda stream, *model: calls.append([m.inputFiles() for m in model[:3]]))
    stream_catalog.QUERIES["stream_footprint_deviations"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 4 and all("/model-" in f for c in calls for files in c for f in files)
    assert all(c == calls[0] for c in calls)
