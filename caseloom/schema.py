"""The event table: one row per event with case, activity, time and a tie-breaking index, under fixed names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventSchema:
    """Columns (or SQL expressions) of a table that play the parts of an event log."""

    case: str = "case:concept:name"
    activity: str = "concept:name"
    timestamp: str = "time:timestamp"
    index: str | None = None
    resource: str | None = None
    start: str | None = None
    extra: tuple[str, ...] = ()


EVENTS = EventSchema("user_id", "event_type", "ts", "event_id", "get_json_object(props, '$.k')", extra=("value",))


def canonical(df: DataFrame, schema: EventSchema) -> DataFrame:
    """case_id, activity, ts, event_idx, us (microseconds since 1970), start_us, resource and the extra columns.

    Rows without case, activity or time are dropped, as no operator can place them.  Without an index column rows with one
    time are ordered by their contents' hash, so that reruns agree.
    """
    ts = F.expr(schema.timestamp) if "(" in schema.timestamp else F.col(f"`{schema.timestamp}`")
    part = lambda x: F.expr(x) if "(" in x else F.col(f"`{x}`")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    out = df.select(
        part(schema.case).alias("case_id"),
        part(schema.activity).cast("string").alias("activity"),
        ts.alias("ts"),
        (part(schema.index).cast("long") if schema.index else F.xxhash64(*df.columns)).alias("event_idx"),
        us(ts).alias("us"),
        us(part(schema.start)).alias("start_us") if schema.start else us(ts).alias("start_us"),
        (part(schema.resource).cast("string") if schema.resource else F.lit(None).cast("string")).alias("resource"),
        *[part(x).alias(x) for x in schema.extra],
    )
    return out.where("case_id IS NOT NULL AND activity IS NOT NULL AND ts IS NOT NULL")


def unused(log: DataFrame, name: str) -> str:
    """A name for a helper column that the log doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in log.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_case() -> WindowSpec:
    """A case's events in order."""
    return Window.partitionBy("case_id").orderBy("us", "event_idx")


def position() -> Column:
    """Position of an event in its case, from 0."""
    return F.row_number().over(in_case()) - 1


def trace() -> Column:
    """Aggregate: a case's activities in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("us", "event_idx", "activity"))), lambda x: x["activity"])


def cases(log: DataFrame) -> DataFrame:
    """(case_id, n_events, first_us, last_us, first_activity, last_activity): partial aggregation, one shuffle."""
    at = F.struct("us", "event_idx")
    return log.groupBy("case_id").agg(
        F.count("*").alias("n_events"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min_by("activity", at).alias("first_activity"),
        F.max_by("activity", at).alias("last_activity"),
    )


def variants(log: DataFrame) -> DataFrame:
    """(case_id, variant: array of activities)."""
    return log.groupBy("case_id").agg(trace().alias("variant"))
