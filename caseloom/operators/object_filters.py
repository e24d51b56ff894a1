"""Filters of object-centric logs. What is filtered in one table goes through to the others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import components, kept
from .objects import ObjectLog, born_and_gone, of_events, of_objects


def of_relations(log: ObjectLog, relations: DataFrame) -> ObjectLog:
    """The log of the given relations (eid, oid): events and objects that stand in none of them go."""
    events, objects = log.events.join(relations, "eid", "left_semi"), log.objects.join(relations, "oid", "left_semi")
    return _linked(replace(log, events=events, objects=objects, relations=relations))


def _linked(log: ObjectLog) -> ObjectLog:
    """Links between objects or events, and changes, whose ends are still there."""
    o2o, e2e, changes = log.o2o, log.e2e, log.changes
    oids, eids = log.objects.select("oid"), log.events.select("eid")
    if o2o is not None:
        o2o = o2o.join(oids, "oid", "left_semi").join(oids.withColumnRenamed("oid", "oid_2"), "oid_2", "left_semi")
    if e2e is not None:
        e2e = e2e.join(eids, "eid", "left_semi").join(eids.withColumnRenamed("eid", "eid_2"), "eid_2", "left_semi")
    if changes is not None:
        changes = changes.join(oids, "oid", "left_semi")
    return replace(log, o2o=o2o, e2e=e2e, changes=changes)


def events_where(log: ObjectLog, condition: Column, positive: bool = True) -> ObjectLog:
    """Events whose attributes fulfil a condition, or those that don't (unknown counts as not)."""
    met = F.coalesce(condition, F.lit(False))
    return _linked(of_events(log, log.events.where(met if positive else ~met)))


def objects_where(log: ObjectLog, condition: Column, positive: bool = True) -> ObjectLog:
    """Objects whose attributes fulfil a condition, or those that don't."""
    met = F.coalesce(condition, F.lit(False))
    return _linked(of_objects(log, log.objects.where(met if positive else ~met)))


def in_time(log: ObjectLog, from_us: int, to_us: int) -> ObjectLog:
    """Events between two times, both included."""
    return events_where(log, F.col("us").between(from_us, to_us))


def types(log: ObjectLog, kinds: Sequence[str], positive: bool = True) -> ObjectLog:
    return objects_where(log, F.col("type").isin(list(kinds)), positive)


def activities_of_types(log: ObjectLog, allowed: Mapping[str, Sequence[str]]) -> ObjectLog:
    """Relations of the named types at the activities that are allowed to each."""
    met = F.lit(False)
    for kind, activities in allowed.items():
        met = met | ((F.col("type") == kind) & F.col("activity").isin(list(activities)))
    return of_relations(log, log.joined().where(met).select("eid", "oid"))


def least_objects(log: ObjectLog, least: Mapping[str, int]) -> ObjectLog:
    """Events with so many objects of each type named, at least."""
    counts = log.joined().groupBy("eid").agg(*[F.count_if(F.col("type") == k).alias(f"n{i}") for i, k in enumerate(least)])
    met = F.lit(True)
    for i, n in enumerate(least.values()):
        met = met & (F.col(f"n{i}") >= n)
    return _linked(of_events(log, counts.where(met)))


def end_events(log: ObjectLog, kind: str, last: bool = False) -> ObjectLog:
    """Events that are the first (or last) of some object of a type."""
    ends = born_and_gone(log).join(log.objects.where(F.col("type") == kind), "oid", "left_semi")
    return _linked(of_events(log, ends.select(F.col("last_eid" if last else "first_eid").alias("eid"))))


def activities_seen_with(log: ObjectLog, kind: str) -> ObjectLog:
    """Relations at activities that occur with a type."""
    seen = log.joined(kind).select("activity").distinct()
    return of_relations(log, log.joined().join(seen, "activity", "left_semi").select("eid", "oid"))


def object_components(log: ObjectLog) -> DataFrame:
    """(oid, component): the smallest object reachable over shared events, for objects that share some.

    An event links its objects to its smallest one, the hub: that gives the components of the interaction graph without its pairs.
    An object stands under the smallest of its hubs; one of a single hub adds no more to the graph, so only the hubs
    of objects with several are linked and contracted.
    """
    at = Window.partitionBy("eid")
    hubs = log.relations.where("eid IS NOT NULL AND oid IS NOT NULL").select("oid", F.min("oid").over(at).alias("hub"), (F.min("oid").over(at) != F.max("oid").over(at)).alias("shared"))
    under = kept(hubs.groupBy("oid").agg(F.min("hub").alias("hub"), F.max("hub").alias("last"), F.max("shared").alias("shared")), "hubs")
    several = under.where("hub <> last").select("oid", F.col("hub").alias("first"))
    if several.isEmpty():
        return under.where("shared").select("oid", F.col("hub").alias("component"))
    links = hubs.join(several, "oid").where("hub <> first").select("first", "hub")
    core = components(links, "first", "hub").select(F.col("id").alias("hub"), "component_id")
    return under.where("shared").join(core, "hub", "left").select("oid", F.coalesce("component_id", "hub").alias("component"))


def component_of(log: ObjectLog, oid: str) -> ObjectLog:
    """The component of an object, or the object alone."""
    found = object_components(log)
    own = found.join(found.where(F.col("oid") == oid).select("component"), "component", "left_semi").select("oid")
    return _linked(of_objects(log, own.union(log.objects.where(F.col("oid") == oid).select("oid"))))


def components_of_size(log: ObjectLog, least: int, most: int) -> ObjectLog:
    found = object_components(log)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return _linked(of_objects(log, found.join(sizes, "component", "left_semi")))


def components_with(log: ObjectLog, objects: DataFrame) -> ObjectLog:
    """The components that hold one of the objects (oid)."""
    found = object_components(log)
    wanted = found.join(objects.select("oid"), "oid", "left_semi").select("component").distinct()
    return _linked(of_objects(log, found.join(wanted, "component", "left_semi")))


def components_with_type(log: ObjectLog, kind: str, positive: bool = True) -> ObjectLog:
    met = F.col("type") == kind
    return components_with(log, log.objects.where(met if positive else ~met))


def components_with_activity(log: ObjectLog, activity: str) -> ObjectLog:
    return components_with(log, log.relations.join(log.events.where(F.col("activity") == activity), "eid", "left_semi"))
