"""Conformance of cases while their events arrive: declare constraints, footprints, temporal profiles.

Events of a case are taken in event-time order whatever their order of arrival: those above the watermark wait in the case's state.
A case is closed by an event-time timer once it is idle for a bound; then its last verdicts come out and its state goes.  What
comes out over a stream equals the batch operators' rows for the same events, however the stream is cut into batches, as long as
no event is later than the watermark allows and no case pauses longer than the bound (it would begin anew).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conformance import BY_A, BY_B, UNARY

MOST_RULES = 100_000
SEEN_A, SEEN_B, FIRST_B, LAST_A, UNEVEN, BROKEN_CHAIN, MANY_A, TOLD = (1 << k for k in range(8))
BREACHES = "case_id string, template string, a string, b string, us long, final boolean"
DEVIATIONS = "case_id string, kind string, a string, b string, us long"
SCORES = "case_id string, a string, b string, gap double, score double, us long"


class Ordered(StatefulProcessor):
    """Feeds a case's events in order to feed() and ends it with ended(); both give out rows.

    All that is known of a case is one value, read and written once a batch: each call of the state store goes from the worker to the JVM.
    Its timer is moved on when it fires before the case is due, not with every batch.
    """

    holds = "int"  # type of what feed() holds of a case

    def __init__(self, idle: str) -> None:
        self.idle = int(pd.Timedelta(idle).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", f"first string, last string, us long, due long, waiting array<struct<us: long, idx: long, activity: string>>, held {self.holds}")

    def feed(self, case: str, events: list[tuple[int, int, str]], first: str | None, last: str | None, held) -> tuple[Iterable[Row], object]:
        """Rows for (us, idx, activity) that follow the activity last, and what is held then; first is the case's first one, None at its begin."""
        raise NotImplementedError

    def ended(self, case: str, first: str, last: str, us: int, held) -> Iterable[Row]:
        raise NotImplementedError

    def _fed(self, case: str, events: list[tuple[int, int, str]], first: str | None, last: str | None, us: int | None, held) -> tuple[Iterable[Row], str | None, str | None, int | None, object]:
        if not events:
            return [], first, last, us, held
        out, held = self.feed(case, events, first, last, held)
        return out, first or events[0][2], events[-1][2], events[-1][0], held

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, state = timerValues.getCurrentWatermarkInMs(), self.case.get()
        first, last, us, due, waiting, held = state or (None, None, None, 0, [], None)
        events = sorted([*map(tuple, waiting), *((r.us, r.event_idx, r.activity) for r in rows if r.activity is not None and key[0] is not None)])
        if not events and state is None:
            return
        ripe = [e for e in events if e[0] <= now * 1000]
        out, first, last, us, held = self._fed(key[0], ripe, first, last, us, held)
        due = max(due, max(now, (events[-1][0] if events else us or 0) // 1000 + self.idle) + 1)
        if state is None:
            self.handle.registerTimer(due)
        self.case.update((first, last, us, due, events[len(ripe) :], held))
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, us, due, waiting, held = self.case.get()
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        out, first, last, us, held = self._fed(key[0], [tuple(e) for e in waiting], first, last, us, held)
        yield from out
        yield from self.ended(key[0], first, last, us, held)
        self.case.clear()

    def close(self) -> None:
        pass


def doomed(template: str, f: int) -> bool:
    """Whether a case with these marks breaks a constraint whatever follows."""
    if template in ("precedence", "succession"):
        return bool(f & FIRST_B)
    if template == "non_coexistence":
        return f & (SEEN_A | SEEN_B) == SEEN_A | SEEN_B
    if template in ("absence", "exactly_one"):
        return bool(f & (SEEN_A if template == "absence" else MANY_A))
    if template.startswith("alternate_") or template.startswith("chain_"):
        decided = SEEN_A if template in BY_A else SEEN_B if template in BY_B else SEEN_A | SEEN_B
        return bool(f & (UNEVEN if template.startswith("alternate_") else BROKEN_CHAIN)) and bool(f & decided)
    return False


def broken(template: str, f: int) -> bool:
    """Whether a case that ends with these marks breaks a relation constraint or existence."""
    if template == "existence":
        return not f & SEEN_A
    if template in UNARY:
        return doomed(template, f)
    if not f & (SEEN_A if template in BY_A else SEEN_B if template in BY_B else SEEN_A | SEEN_B):
        return False
    both = f & (SEEN_A | SEEN_B) == SEEN_A | SEEN_B
    kind = template.removeprefix("non_")
    if kind in ("responded_existence", "coexistence"):
        met = both
    elif kind in ("response", "precedence", "succession"):
        met = both and not (kind != "precedence" and f & LAST_A) and not (kind != "response" and f & FIRST_B)
    else:
        met = both and not f & (LAST_A | (UNEVEN if kind.startswith("alternate_") else BROKEN_CHAIN))
    return met if template.startswith("non_") else not met


class DeclareMonitor(Ordered):
    """Marks for each constraint a case has touched."""

    holds = "array<struct<rule: int, marks: int>>"

    def __init__(self, rules: list[tuple[str, str, str | None]], idle: str) -> None:
        super().__init__(idle)
        self.rules = rules
        self.by: dict[str, list[int]] = {}
        for k, (_, a, b) in enumerate(rules):
            for x in {a, b} - {None}:
                self.by.setdefault(x, []).append(k)

    def feed(self, case, events, first, last, held):
        marks, out = dict(map(tuple, held or [])), []

        def tell(k: int, us: int) -> None:
            out.append(Row(case_id=case, template=self.rules[k][0], a=self.rules[k][1], b=self.rules[k][2], us=us, final=False))

        for us, _, act in events:
            if first is None:
                first = act
                for k, (template, a, _) in enumerate(self.rules):
                    if template == "init" and a != act:
                        marks[k] = TOLD
                        tell(k, us)
            for k in {*self.by.get(act, ()), *(self.by.get(last, ()) if last is not None else ())}:
                template, a, b = self.rules[k]
                f = marks.get(k, 0)
                if last == a and act != b:
                    f |= BROKEN_CHAIN
                if act == a:
                    f |= SEEN_A | LAST_A | (UNEVEN if f & LAST_A else 0) | (MANY_A if f & SEEN_A else 0)
                elif act == b:
                    f |= SEEN_B | (0 if f & SEEN_A else FIRST_B) | (0 if f & LAST_A else UNEVEN) | (0 if last == a else BROKEN_CHAIN)
                    f &= ~LAST_A
                if not f & TOLD and doomed(template, f):
                    f |= TOLD
                    tell(k, us)
                marks[k] = f
            last = act
        return out, [*marks.items()]

    def ended(self, case, first, last, us, held):
        marks = dict(map(tuple, held or []))
        for k, (template, a, b) in enumerate(self.rules):
            f = marks.get(k, 0)
            if not f & TOLD and template != "init" and broken(template, f):
                yield Row(case_id=case, template=template, a=a, b=b, us=us, final=True)


class FootprintMonitor(Ordered):
    """Steps, first and last activities that the footprints don't have; the case's last activity is all it needs."""

    def __init__(self, steps: set[tuple[str, str]], starts: set[str], ends: set[str], idle: str) -> None:
        super().__init__(idle)
        self.steps, self.starts, self.ends = steps, starts, ends

    def feed(self, case, events, first, last, held):
        out = []
        for us, _, act in events:
            if last is None and act not in self.starts:
                out.append(Row(case_id=case, kind="start", a=None, b=act, us=us))
            elif last is not None and (last, act) not in self.steps:
                out.append(Row(case_id=case, kind="step", a=last, b=act, us=us))
            last = act
        return out, None

    def ended(self, case, first, last, us, held):
        if last not in self.ends:
            yield Row(case_id=case, kind="end", a=last, b=None, us=us)


class TemporalMonitor(Ordered):
    """Every event against all earlier ones of its case, whose times are held until the case is closed."""

    holds = "array<struct<activity: string, us: long>>"

    def __init__(self, profile: dict[tuple[str, str], tuple[float, float]], zeta: float, idle: str) -> None:
        super().__init__(idle)
        self.profile, self.zeta = profile, zeta

    def feed(self, case, events, first, last, held):
        before, out = [tuple(e) for e in held or []], []
        for us, _, act in events:
            for other, at in before:
                mean, spread = self.profile.get((other, act), (None, None))
                gap = (us - at) / 1e6
                if mean is not None and abs(gap - mean) > self.zeta * spread:
                    out.append(Row(case_id=case, a=other, b=act, gap=gap, score=abs(gap - mean) / spread if spread else None, us=us))
            before.append((act, us))
        return out, before

    def ended(self, case, first, last, us, held):
        return []


def _rows(model: DataFrame, *names: str) -> list[Row]:
    """The rows of a model, which every task holds: an error above MOST_RULES."""
    rows = model.select(*names).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a model of more than {MOST_RULES} rows")
    return rows


def _monitored(events: DataFrame, monitor: Ordered, schema: str, late: str) -> DataFrame:
    rows = events.select(F.col("case_id").cast("string").alias("case_id"), "activity", F.col("ts").cast("timestamp").alias("ts"), F.col("event_idx").cast("long").alias("event_idx")).withWatermark("ts", late)
    # Rows without case or activity go as far as the monitor: a filter would be pushed below the watermark, which they move on.
    rows = rows.where("ts IS NOT NULL").select("case_id", "activity", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_idx", F.lit(0)).alias("event_idx"))
    return rows.groupBy("case_id").transformWithState(monitor, schema, "append", "eventTime")


def stream_declare_deviations(events: DataFrame, model: DataFrame, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """(case_id, template, a, b, us, final) of each constraint of the model (template, a, b) that a case breaks.

    A breach that nothing can mend comes at the event (us) that makes it certain, the others (final) when the case is closed.
    events has case_id, activity, ts and event_idx (the order of equal times); rows that lack one of the first three are no events,
    but move the watermark on.  Relation constraints have two different activities.
    """
    rules = [tuple(r) for r in _rows(model, "template", "a", "b")]
    return _monitored(events, DeclareMonitor(rules, idle), BREACHES, late)


def stream_footprint_deviations(events: DataFrame, footprints: DataFrame, starts: DataFrame, ends: DataFrame, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """(case_id, kind, a, b, us): steps (a, b) outside the footprints, first activities b and last activities a the model lacks."""
    steps = {(r.a, r.b) for r in _rows(footprints, "a", "b")}
    names = lambda t: {r.activity for r in _rows(t, "activity")}
    return _monitored(events, FootprintMonitor(steps, names(starts), names(ends), idle), DEVIATIONS, late)


def stream_temporal_deviations(events: DataFrame, profile: DataFrame, zeta: float, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """(case_id, a, b, gap, score, us) of an event and each earlier one of its case whose gap is beyond zeta deviations of the profile's mean."""
    known = {(r.a, r.b): (r.mean_s, r.stdev_s or 0.0) for r in _rows(profile, "a", "b", "mean_s", "stdev_s")}
    return _monitored(events, TemporalMonitor(known, zeta, idle), SCORES, late)
