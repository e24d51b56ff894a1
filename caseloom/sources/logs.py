"""Readers and writers of event logs: delimited files, XES and directly-follows graphs."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import dropped, kept
from .objects import read_object_json as read_ocel2_json  # noqa: F401

KINDS = ("string", "date", "int", "float", "boolean", "id")
_VALUE = {"string": "string", "id": "string", "date": "timestamp", "int": "long", "float": "double", "boolean": "boolean"}


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header under an explicit schema, so that the file is read once."""
    return spark.read.csv(path, schema=schema, header=True, sep=separator, encoding=encoding)


def read_xes(spark: SparkSession, path: str, case_key: str = "concept:name", columns: dict[str, str] | None = None, case_columns: dict[str, str] | None = None) -> DataFrame:
    """An event a row: case:<case_key>, event_idx, the event's attributes of ``columns`` (name: XES kind) and, as case:<name>, its trace's of ``case_columns``.

    Files are split at their traces by Spark's XML source; a compressed file is one task.  Attributes that an event or trace
    lacks are null.  Traces without case_key and events inside them are left out.
    """
    columns = columns or {"concept:name": "string", "time:timestamp": "date", "org:resource": "string"}
    attribute = "array<struct<_key: string, _value: string>>"
    nested, own = ", ".join(f"`{k}`: {attribute}" for k in KINDS), ", ".join(f"`{k}` {attribute}" for k in KINDS)
    traces = spark.read.format("xml").option("rowTag", "trace").schema(f"{own}, event array<struct<{nested}>>").load(path)

    def value(held: str, name: str, kind: str):
        found = F.get(F.filter(F.col(held), lambda x: x["_key"] == name), F.lit(0))["_value"]
        return F.try_to_timestamp(found) if kind == "date" else found.cast(_VALUE[kind])

    of_case = [value(f"`{k}`", n, k).alias(f"case:{n}") for n, k in (case_columns or {}).items()]
    events = traces.select(value("`string`", case_key, "string").alias("case"), *of_case, F.posexplode("event").alias("position", "event")).where("case IS NOT NULL")
    named = [F.col(f"`case:{n}`") for n in case_columns or {}]
    return events.select(F.col("case").alias(f"case:{case_key}"), F.col("position").cast("long").alias("event_idx"), *[value(f"event.`{k}`", n, k).alias(n) for n, k in columns.items()], *named)


def _kind(dtype: str) -> str:
    kinds = {"timestamp": "date", "timestamp_ntz": "date", "date": "date", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "boolean"}
    return "float" if dtype.startswith("decimal") else kinds.get(dtype, "string")


def write_xes(log: DataFrame, path: str, attributes: Sequence[str] = ()) -> None:
    """Canonical events (case_id, activity, us, event_idx, resource) as XES, a file a partition, each a log of its own.

    ``attributes`` are further columns to write, of the kind of their type (other types as text); those named case:... are the traces',
    of their first event that has one.  Null values are left out.
    """
    types = dict(log.dtypes)
    quote = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    item = lambda kind, key, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{kind} key={quoteattr(key)} value=\""), quote(c), F.lit('"/>'))).otherwise(F.lit(""))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

    def further(name: str, key: str):
        kind, c = _kind(types[name]), F.col(f"`{name}`")
        return item(kind, key, iso(c.cast("timestamp")) if kind == "date" else c)

    ours = [a for a in attributes if not a.startswith("case:")]
    event = F.concat(F.lit("<event>"), item("string", "concept:name", F.col("activity")), item("date", "time:timestamp", iso(F.timestamp_micros("us"))), item("string", "org:resource", F.col("resource")), *[further(a, a) for a in ours], F.lit("</event>"))
    of_case = [a for a in attributes if a.startswith("case:")]
    at = F.struct("us", "event_idx")
    firsts = [F.min_by(further(a, a[5:]), F.when(F.col(f"`{a}`").isNotNull(), at)).alias(f"attribute_{i}") for i, a in enumerate(of_case)]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_idx", event.alias("xml")))), lambda x: x["xml"])
    traces = log.groupBy("case_id").agg(ordered.alias("events"), *firsts)
    marks = [F.coalesce(f"attribute_{i}", F.lit("")) for i in range(len(of_case))]
    body = F.concat(F.lit("<trace>"), item("string", "concept:name", F.col("case_id")), *marks, F.array_join("events", ""), F.lit("</trace>"))
    part = F.spark_partition_id()
    rows = traces.select(body.alias("value"), part.alias("part"))
    edges = rows.select("part").distinct().select("part", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit('<log xes.version="1.0">').alias("value")), F.struct(F.lit(2).alias("k"), F.lit("</log>").alias("value")))).alias("x"))
    lines = rows.select("part", F.lit(1).alias("k"), "value").unionByName(edges.select("part", "x.k", "x.value"))
    lines.repartition("part").sortWithinPartitions("part", "k").select("value").write.text(path)


def write_dfg(edges: DataFrame, starts: DataFrame, ends: DataFrame, path: str) -> None:
    """A directly-follows graph (a, b, n), (activity, n), (activity, n) as one text file in the folder ``path``.

    The number of activities and their names, a line each, in order; the number of start activities and lines ``place x count``; the same for
    ends; then ``place > place x count`` for each edge, without blanks, places counted from 0.  The file is as small as the alphabet squared, so one task
    writes it.  Names must not hold line breaks.
    """
    names = edges.select(F.col("a").alias("activity")).union(edges.select("b")).union(starts.select("activity")).union(ends.select("activity")).distinct()
    names = kept(names.select("activity", (F.row_number().over(Window.orderBy("activity")) - 1).alias("i")), "names")  # the alphabet
    named = lambda c, i: names.select(F.col("activity").alias(c), F.col("i").alias(i))
    text = lambda c: F.col(c).cast("string")
    line = lambda df, section, i, value: df.select(F.lit(section).alias("section"), i.alias("i"), F.lit(0).alias("j"), value.alias("value"))
    size = lambda df, section: line(df.agg(F.count("*").alias("k")), section, F.lit(0), text("k"))
    parts = size(names, 0).union(line(names, 1, F.col("i"), F.col("activity")))
    for section, table in ((2, starts), (4, ends)):
        placed = table.join(names, "activity")
        parts = parts.union(size(table, section)).union(line(placed, section + 1, F.col("i"), F.concat(text("i"), F.lit("x"), text("n"))))
    placed = edges.join(named("a", "i"), "a").join(named("b", "j"), "b")
    parts = parts.union(placed.select(F.lit(6), "i", "j", F.concat(text("i"), F.lit(">"), text("j"), F.lit("x"), text("n"))))
    parts.repartition(1).sortWithinPartitions("section", "i", "j").select("value").write.text(path)
    dropped(names)


def read_dfg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, starts, ends) of a file as write_dfg() writes it (or a folder of one); blank lines at the end are no edges."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    count = lambda at: F.trim(F.get("lines", at)).cast("int")
    rows = whole.withColumn("k", count(F.lit(0)))
    rows = rows.withColumn("s", count(F.col("k") + 1)).withColumn("e", count(F.col("k") + F.col("s") + 2))
    after = F.col("k") + F.col("s") + F.col("e") + 4
    rows = rows.select(
        F.transform(F.slice("lines", F.lit(2), F.col("k")), F.trim).alias("names"),
        F.slice("lines", F.col("k") + 3, F.col("s")).alias("starts"),
        F.slice("lines", F.col("k") + F.col("s") + 4, F.col("e")).alias("ends"),
        F.slice("lines", after, F.greatest(F.lit(0), F.size("lines") - after + 1)).alias("edges"),
    )
    name = lambda part: F.get("names", part.cast("int"))

    def ends(column: str) -> DataFrame:
        parts = F.split(F.trim("line"), "x")
        return rows.select("names", F.explode(column).alias("line")).select(name(parts[0]).alias("activity"), parts[1].cast("long").alias("n"))

    parts = F.split(F.trim("line"), "[>x]")
    lines = rows.select("names", F.explode("edges").alias("line")).where("trim(line) <> ''")
    return lines.select(name(parts[0]).alias("a"), name(parts[1]).alias("b"), parts[2].cast("long").alias("n")), ends("starts"), ends("ends")
