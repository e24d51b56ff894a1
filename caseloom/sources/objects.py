"""Readers and writers of object-centric logs: XML, JSON and delimited files, with attributes, qualifiers, links and changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import kept, many
from ..operators.objects import ObjectLog
from .object_xml import RECORDS, RELATED, ObjectXml

#: Declared attribute types and the column types that hold them.
KINDS = {"string": "string", "time": "timestamp", "integer": "bigint", "float": "double", "boolean": "boolean"}
DECLARED = {"timestamp": "time", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "float", "float": "float", "boolean": "boolean"}
TIME, START = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "1970-01-01T00:00:00Z"
DOCUMENT_ROWS = 100_000  # rows of a log's tables in a JSON document that is written: one task reads it whole, at 4 or 5 MB
_FIXED = {"event": ("eid", "activity", "us"), "object": ("oid", "type")}


def column_names(names: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """A column for each attribute; names that a fixed column or another attribute has (whatever its case) get a number."""
    used, out = {t.lower() for t in taken}, {}
    for name in sorted(names):
        column, k = name, 2
        while column.lower() in used:
            column, k = f"{name}_{k}", k + 1
        used.add(column.lower())
        out[name] = column
    return out


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time as text, in UTC where it names no zone; null if it is none."""
    zoned = F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def _typed(value: Column, kind: str) -> Column:
    if kind == "time":
        return F.timestamp_micros(micros(value))
    return value if kind == "string" else value.try_cast(KINDS[kind])


def _log_of(records: DataFrame, name: str) -> ObjectLog:
    """The six tables of records; they are written to the shared folder once."""
    records = kept(records, name)
    # The names of attributes and their declared types: a row a name and type, as the columns need them.
    listed = records.select(F.substring_index("kind", "-", 1).alias("level"), F.col("kind").endswith("-type").alias("declared"), F.explode("attributes").alias("x"))
    found = listed.select("level", "x.name", F.when(F.col("declared"), F.col("x.value")).alias("kind")).distinct().collect()
    kinds: dict[str, dict[str, set]] = {"event": {}, "object": {}}
    for r in found:
        if r["name"] is not None:
            kinds[r["level"]].setdefault(r["name"], set()).update({r["kind"]} - {None})
    kind_of = {level: {n: next(iter(k)) if len(k) == 1 and next(iter(k)) in KINDS else "string" for n, k in names.items()} for level, names in kinds.items()}
    at_start = lambda x: x["time"].isNull() | (x["time"] == "0") | x["time"].startswith("1970-01-01T00:00:00")

    def wide(level: str) -> list[Column]:
        names = column_names(kind_of[level], _FIXED[level])
        of = lambda n: F.try_element_at(F.filter("attributes", lambda x: (x["name"] == n) & (at_start(x) if level == "object" else F.lit(True))), F.lit(-1))["value"]
        return [_typed(of(n), kind_of[level][n]).alias(column) for n, column in names.items()]

    events, objects = records.where("kind = 'event'"), records.where("kind = 'object'")
    pairs = lambda rows, a, column, b: rows.select(F.col("id").alias(a), F.explode(column).alias("x")).select(a, F.col("x.id").alias(b), "x.qualifier").distinct()
    changes = objects.select(F.col("id").alias("oid"), "type", F.explode(F.filter("attributes", lambda x: ~at_start(x))).alias("x"))
    return ObjectLog(
        events.select(F.col("id").alias("eid"), F.col("type").alias("activity"), micros(F.col("time")).alias("us"), *wide("event")),
        objects.select(F.col("id").alias("oid"), "type", *wide("object")),
        pairs(events, "eid", "objects", "oid"),
        pairs(objects, "oid", "objects", "oid_2"),
        pairs(events, "eid", "events", "eid_2"),
        changes.select("oid", "type", micros(F.col("x.time")).alias("us"), F.col("x.name").alias("field"), "x.value"),
    )


def read_object_xml(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> ObjectLog:
    """Object-centric XML, version 1.0 or 2.0, from a file or a folder of files; files are read by ranges of split_bytes.

    Attributes become columns of their declared types (text where none is declared, or several); values of an object's
    attribute at 1970-01-01 or without a time are its columns, the others changes (oid, type, us, field, value as text).
    """
    spark.dataSource.register(ObjectXml)
    return _log_of(spark.read.format("object_xml").option("splitbytes", split_bytes).load(path), "object-xml")


_RELATIONS = "array<struct<objectId: string, eventId: string, qualifier: string>>"
_TYPES = "array<struct<name: string, attributes: array<struct<name: string, type: string>>>>"
_THINGS = f"array<struct<id: string, type: string, time: string, attributes: array<struct<name: string, time: string, value: string>>, relationships: {_RELATIONS}>>"


def read_object_json(spark: SparkSession, path: str) -> ObjectLog:
    """Object-centric JSON 2.0: a file is one document and one task's, a folder may hold many."""
    whole = spark.read.schema(f"objectTypes {_TYPES}, eventTypes {_TYPES}, objects {_THINGS}, events {_THINGS}").json(path, multiLine=True, recursiveFileLookup=True)
    none = F.lit(None).cast("string")
    empty = F.array().cast(RELATED)

    whole_array = lambda c: F.coalesce(c, F.array().cast(f"array<struct<{RECORDS}>>"))
    related = lambda x, key: F.coalesce(F.transform(F.filter(x["relationships"], lambda r: r[key].isNotNull()), lambda r: F.struct(r[key].alias("id"), r["qualifier"].alias("qualifier"))), empty)

    def things(column: str, kind: str) -> Column:
        return whole_array(F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["id"].alias("id"), x["type"].alias("type"), x["time"].alias("time"), x["attributes"].alias("attributes"), related(x, "objectId").alias("objects"), related(x, "eventId").alias("events"))))

    def types(column: str, kind: str) -> Column:
        made = lambda x: F.transform(x["attributes"], lambda a: F.struct(a["name"].alias("name"), none.alias("time"), a["type"].alias("value")))
        return whole_array(F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), none.alias("id"), x["name"].alias("type"), none.alias("time"), made(x).alias("attributes"), empty.alias("objects"), empty.alias("events"))))

    # One list of all four sections: a document is parsed once.
    rows = whole.select(F.inline(F.concat(things("events", "event"), things("objects", "object"), types("eventTypes", "event-type"), types("objectTypes", "object-type"))))
    return _log_of(rows, "object-json")


_FIRST_EVENT = "struct<`ocel:activity`: string, `ocel:timestamp`: string, `ocel:omap`: array<string>, `ocel:vmap`: map<string, string>>"
_FIRST_OBJECT = "struct<`ocel:type`: string, `ocel:ovmap`: map<string, string>>"


def read_object_json1(spark: SparkSession, path: str) -> ObjectLog:
    """Object-centric JSON 1.0; attributes are text, as it declares no types."""
    whole = spark.read.schema(f"`ocel:events` map<string, {_FIRST_EVENT}>, `ocel:objects` map<string, {_FIRST_OBJECT}>").json(path, multiLine=True, recursiveFileLookup=True)
    none, empty = F.lit(None).cast("string"), F.array().cast(RELATED)
    values = lambda c: F.coalesce(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("name"), none.alias("time"), e["value"].alias("value"))), F.array())
    events = whole.select(F.explode("ocel:events").alias("id", "x"))
    objects = F.transform("x.ocel:omap", lambda o: F.struct(o.alias("id"), none.alias("qualifier")))
    rows = events.select(F.lit("event").alias("kind"), "id", F.col("x.`ocel:activity`").alias("type"), F.col("x.`ocel:timestamp`").alias("time"), values(F.col("x.`ocel:vmap`")).alias("attributes"), objects.alias("objects"), empty.alias("events"))
    things = whole.select(F.explode("ocel:objects").alias("id", "x"))
    things = things.select(F.lit("object").alias("kind"), "id", F.col("x.`ocel:type`").alias("type"), none.alias("time"), values(F.col("x.`ocel:ovmap`")).alias("attributes"), empty.alias("objects"), empty.alias("events"))
    return _log_of(rows.unionByName(things), "object-json")


def read_object_csv(spark: SparkSession, path: str, objects: str | None = None, relations: str | None = None, o2o: str | None = None, e2e: str | None = None, changes: str | None = None, kinds: dict[str, str] | None = None) -> ObjectLog:
    """An extended table: ocel:eid, ocel:activity, ocel:timestamp, a column ocel:type:<name> of id lists for each type, attributes.

    The other tables are files of their own, where there are any: objects (ocel:oid, ocel:type, attributes), relations with qualifiers
    in place of the lists, o2o, e2e and changes as write_object_csv() writes them.  kinds gives attributes other types than text.
    Files are split at line breaks, so values hold none; an empty value is null.
    """
    kinds = kinds or {}
    read = lambda p: spark.read.csv(p, header=True, escape='"', inferSchema=False)
    table = read(path)
    lists = {c: c.removeprefix("ocel:type:") for c in table.columns if c.startswith("ocel:type:")}
    ids = lambda c: F.from_json(F.col(f"`{c}`"), "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    attributes = lambda t, level: [_typed(F.col(f"`{n}`"), kinds.get(n, "string")).alias(c) for n, c in column_names([x for x in t.columns if not x.startswith("ocel:")], _FIXED[level]).items()]
    eid = F.col("`ocel:eid`").alias("eid")
    events = table.select(eid, F.col("`ocel:activity`").alias("activity"), micros(F.replace(F.col("`ocel:timestamp`"), F.lit(" "), F.lit("T"))).alias("us"), *attributes(table, "event"))
    listed = F.array(*[F.struct(F.lit(t).alias("type"), ids(c).alias("oids")) for c, t in lists.items()]) if lists else F.array().cast("array<struct<type: string, oids: array<string>>>")
    pairs = table.select(eid, F.inline(listed)).select("eid", "type", F.explode("oids").alias("oid"))
    if objects:
        own = read(objects)
        things = own.select(F.col("`ocel:oid`").alias("oid"), F.col("`ocel:type`").alias("type"), *attributes(own, "object"))
    else:
        things = pairs.select("oid", "type").distinct()
    if relations:
        related = read(relations).select("eid", "oid", "qualifier")
    else:
        related = pairs.select("eid", "oid", F.lit(None).cast("string").alias("qualifier")).distinct()
    other = lambda p, *names: read(p).select(*names) if p else None
    moved = read(changes).select("oid", "type", F.col("us").cast("long").alias("us"), "field", "value") if changes else None
    return ObjectLog(events, things, related, other(o2o, "oid", "oid_2", "qualifier"), other(e2e, "eid", "eid_2", "qualifier"), moved)


def _text(c: Column, kind: str) -> Column:
    return F.date_format(c, TIME) if kind == "timestamp" else c.cast("string")


def _attributes(df: DataFrame, level: str) -> dict[str, str]:
    return {n: t for n, t in df.dtypes if n not in _FIXED[level]}


def _qualified(pairs: DataFrame | None, key: str, other: str, out: str) -> DataFrame | None:
    """(key, out: array of (id, qualifier)) of each key of pairs; a row holds all of one event or object, as its record does."""
    if pairs is None:
        return None
    qualifier = F.col("qualifier") if "qualifier" in pairs.columns else F.lit(None)
    rows = pairs.select(F.col(key).cast("string").alias(key), F.struct(F.col(other).cast("string").alias("id"), qualifier.cast("string").alias("qualifier")).alias("x"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias(out))


def _records(log: ObjectLog) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """Rows as RECORDS of all events and objects, and the attributes' column types."""
    columns = {"event": _attributes(log.events, "event"), "object": _attributes(log.objects, "object")}
    none, empty = F.lit(None).cast("string"), F.array().cast(RELATED)

    def values(level: str, time: Column) -> Column:
        made = [F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.lit(n).alias("name"), time.alias("time"), _text(F.col(f"`{n}`"), t).alias("value"))) for n, t in columns[level].items()]
        return F.array_compact(F.array(*made)) if made else F.array().cast("array<struct<name: string, time: string, value: string>>")

    iso = lambda us: F.date_format(F.timestamp_micros(us), TIME)
    events = log.events.select(F.col("eid").cast("string").alias("id"), F.col("activity").alias("type"), iso(F.col("us")).alias("time"), values("event", none).alias("attributes"))
    for found in (_qualified(log.relations, "eid", "oid", "objects"), _qualified(log.e2e, "eid", "eid_2", "events")):
        events = events.join(found.withColumnRenamed("eid", "id"), "id", "left") if found is not None else events.withColumn("events", empty)
    objects = log.objects.select(F.col("oid").cast("string").alias("id"), "type", none.alias("time"), values("object", F.lit(START)).alias("own"))
    links = _qualified(log.o2o, "oid", "oid_2", "objects")
    objects = objects.join(links.withColumnRenamed("oid", "id"), "id", "left") if links is not None else objects.withColumn("objects", empty)
    if log.changes is not None:
        moved = log.changes.select(F.col("oid").cast("string").alias("id"), F.struct(F.col("field").alias("name"), iso(F.col("us")).alias("time"), F.col("value").cast("string").alias("value")).alias("x"))
        objects = objects.join(moved.groupBy("id").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(F.struct(a["time"], a["name"], a["value"]) < F.struct(b["time"], b["name"], b["value"]), -1).otherwise(1)).alias("moved")), "id", "left")
        objects = objects.withColumn("attributes", F.concat("own", F.coalesce("moved", F.array())))
    else:
        objects = objects.withColumnRenamed("own", "attributes")
    order = ("kind", "id", "type", "time", "attributes", "objects", "events")
    events = events.withColumn("kind", F.lit("event"))
    objects = objects.withColumns({"kind": F.lit("object"), "events": empty})
    rows = events.select(*order).unionByName(objects.select(*order))
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("objects", "events")}), columns


def _parts(log: ObjectLog) -> int:
    """How many documents: as many as tasks run at once, more where the log's files are large."""
    return max(log.events.sparkSession.sparkContext.defaultParallelism, *many(log.relations), 1)


def _json_parts(log: ObjectLog) -> int:
    """How many JSON documents: as many as tasks run at once, and as many as bound a document's rows, whatever the size of the log."""
    rows = sum(t.count() for t in (log.events, log.objects, log.relations, log.o2o, log.e2e, log.changes) if t is not None)
    return max(log.events.sparkSession.sparkContext.defaultParallelism, -(-rows // DOCUMENT_ROWS), 1)


def _types(log: ObjectLog, parts: int) -> tuple[DataFrame, DataFrame]:
    """(name, part) of activities and of object types, each for every document."""
    spread = log.events.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    every = lambda t, c: t.select(F.col(c).alias("name")).distinct().crossJoin(F.broadcast(spread))  # noqa: E731  the types, once a document
    return every(log.events, "activity"), every(log.objects, "type")


def quoted(c: Column) -> Column:
    """Text as an XML attribute or element, line breaks as references; characters that XML can't hold are left out."""
    c = F.regexp_replace(c.cast("string"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def write_object_xml(log: ObjectLog, path: str, parts: int | None = None) -> None:
    """All six tables as object-centric XML 2.0, in ``parts`` documents (as many as tasks run at once, more for large logs), each well formed.

    Links between events, for which the format has no place, stand in an element ``events`` beside an event's objects.
    """
    parts = parts or _parts(log)
    rows, columns = _records(log)
    at = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), quoted(c), F.lit('"'))).otherwise("")
    inside = lambda tag, items: F.when(F.size(items) > 0, F.concat(F.lit(f"<{tag}>"), F.array_join(items, ""), F.lit(f"</{tag}>"))).otherwise("")
    attributes = F.transform("attributes", lambda a: F.concat(F.lit("<attribute"), at("name", a["name"]), at("time", a["time"]), F.lit(">"), quoted(a["value"]), F.lit("</attribute>")))
    related = lambda c, key: F.transform(c, lambda r: F.concat(F.lit("<relationship"), at(key, r["id"]), at("qualifier", r["qualifier"]), F.lit("/>")))
    body = F.concat(inside("attributes", attributes), inside("objects", related("objects", "object-id")), inside("events", related("events", "event-id")))
    value = F.concat(F.lit("<"), F.col("kind"), at("id", F.col("id")), at("type", F.col("type")), at("time", F.col("time")), F.lit(">"), body, F.lit("</"), F.col("kind"), F.lit(">"))
    lines = rows.select("id", F.when(F.col("kind") == "object", 2).otherwise(3).alias("section"), value.alias("value"))

    def declared(names: DataFrame, level: str, section: int) -> DataFrame:
        own = "".join(f'<attribute name="{_quoted(n)}" type="{DECLARED.get(t, "string")}"/>' for n, t in columns[level].items())
        made = F.concat(F.lit(f'<{level}-type name="'), quoted(F.col("name")), F.lit(f'"><attributes>{own}</attributes></{level}-type>'))
        return names.select("part", F.lit(section).alias("section"), made.alias("value"))

    activities, kinds = _types(log, parts)
    headers = declared(kinds, "object", 0).unionByName(declared(activities, "event", 1))
    sections = ['<?xml version="1.0" encoding="UTF-8"?><log><object-types>', "</object-types><event-types>", "</event-types><objects>", "</objects><events>", "</events></log>"]
    _documents(lines, headers, sections, parts, path)


def _quoted(name: str) -> str:
    for plain, other in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        name = name.replace(plain, other)
    return name


def _documents(lines: DataFrame, headers: DataFrame, sections: list[str], parts: int, path: str, comma: str = "") -> None:
    """Writes lines (id, section, value) and headers (part, section, value) as ``parts`` documents.

    Section k stands between sections[k] and sections[k + 1]; its lines are parted by ``comma``.
    """
    spark = lines.sparkSession
    dealt = lines.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "section", "id", "value")
    rows = dealt.unionByName(headers.select("part", "section", F.col("value").alias("id"), "value"))
    fixed = spark.createDataFrame([(2 * k, s) for k, s in enumerate(sections)], "k int, value string")
    edges = spark.range(parts).select(F.col("id").cast("int").alias("part")).crossJoin(F.broadcast(fixed)).select("part", "k", F.lit("").alias("id"), "value")  # a few rows a document
    rows = rows.select("part", (2 * F.col("section") + 1).alias("k"), "id", "value").unionByName(edges)
    rows = rows.repartition(*((parts,) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()), "part")
    if comma:  # the window leaves the rows of a document in this order
        before = F.lag("k").over(Window.partitionBy("part").orderBy("k", "id", "value"))
        rows = rows.withColumn("value", F.concat(F.when(before == F.col("k"), comma).otherwise(""), "value"))
    else:
        rows = rows.sortWithinPartitions("part", "k", "id")
    rows.select("part", "value").write.partitionBy("part").text(path)


def write_object_json(log: ObjectLog, path: str, parts: int | None = None) -> None:
    """All six tables as object-centric JSON 2.0, in ``parts`` documents (one for each DOCUMENT_ROWS rows); links between events name an eventId."""
    parts = parts or _json_parts(log)
    rows, columns = _records(log)
    related = lambda c, key: F.transform(c, lambda r: F.struct(r["id"].alias(key), r["qualifier"].alias("qualifier")))
    bare = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)
    both = F.array_join(F.array_compact(F.array(*[F.when(F.size(c) > 0, bare(F.to_json(related(c, k)))) for c, k in (("objects", "objectId"), ("events", "eventId"))])), ",")
    head = F.to_json(F.struct("id", "type", "time", F.transform("attributes", lambda a: F.struct(a["name"].alias("name"), a["time"].alias("time"), a["value"].alias("value"))).alias("attributes")))
    value = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"relationships":['), both, F.lit("]}"))
    lines = rows.select("id", F.when(F.col("kind") == "object", 2).otherwise(3).alias("section"), value.alias("value"))

    def declared(names: DataFrame, level: str, section: int) -> DataFrame:
        own = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(DECLARED.get(t, "string")).alias("type")) for n, t in columns[level].items()])
        return names.select("part", F.lit(section).alias("section"), F.to_json(F.struct("name", own.alias("attributes"))).alias("value"))

    activities, kinds = _types(log, parts)
    headers = declared(kinds, "object", 0).unionByName(declared(activities, "event", 1))
    _documents(lines, headers, ['{"objectTypes":[', '],"eventTypes":[', '],"objects":[', '],"events":[', "]}"], parts, path, ",")


def write_object_csv(log: ObjectLog, path: str) -> None:
    """Folders events (the extended table), objects and, where the log has them, relations with qualifiers, o2o, e2e and changes.

    The types' columns need their names: the driver asks for them, one row a type.
    """
    names = sorted(r[0] for r in log.objects.select("type").distinct().collect())
    lists = log.joined().groupBy("eid").pivot("type", names).agg(F.to_json(F.array_sort(F.collect_set(F.col("oid").cast("string")))))
    lists = lists.select("eid", *[F.when(F.col(f"`{n}`") != "[]", F.col(f"`{n}`")).alias(f"ocel:type:{n}") for n in names])
    text = lambda df, level: [_text(F.col(f"`{n}`"), t).alias(n) for n, t in _attributes(df, level).items()]
    time = F.date_format(F.timestamp_micros("us"), TIME).alias("ocel:timestamp")
    table = log.events.join(lists, "eid", "left").select(F.col("eid").cast("string").alias("ocel:eid"), time, F.col("activity").alias("ocel:activity"), *[f"`ocel:type:{n}`" for n in names], *text(log.events, "event"))
    objects = log.objects.select(F.col("oid").cast("string").alias("ocel:oid"), F.col("type").alias("ocel:type"), *text(log.objects, "object"))
    tables = {"events": table, "objects": objects, "o2o": log.o2o, "e2e": log.e2e, "changes": log.changes, "relations": log.relations if "qualifier" in log.relations.columns else None}
    for name, df in tables.items():
        if df is not None:
            df.write.csv(f"{path}/{name}", header=True, escape='"')
