"""Object-centric logs: enrichment, sampling, clean-up, conversion and features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.closure import path_pairs, reach_from
from ..functions.tables import components, kept, many
from .object_filters import object_components
from .objects import ObjectLog, _life, of_events, of_objects


def attribute_names(log: ObjectLog) -> DataFrame:
    """(level, name) of the attributes of events and objects that have a value somewhere."""
    made = []
    for level, table, own in (("event", log.events, {"eid", "activity", "us"}), ("object", log.objects, {"oid", "type"})):
        names = [c for c in table.columns if c not in own]
        held = F.array(*[F.when(F.count(f"`{c}`") > 0, F.lit(c)) for c in names]).cast("array<string>")
        made.append(table.agg(held.alias("names")).select(F.lit(level).alias("level"), F.explode(F.array_compact("names")).alias("name")))
    return made[0].union(made[1])


def attributes_by_kind(table: DataFrame, kind: str, skip: tuple[str, ...]) -> DataFrame:
    """(kind, name): attributes that have a value for an activity (of events) or a type (of objects)."""
    names = [c for c in table.columns if c not in (kind, *skip)]
    held = F.array(*[F.when(F.count(f"`{c}`") > 0, F.lit(c)) for c in names]).cast("array<string>")
    return table.groupBy(F.col(kind).alias("kind")).agg(held.alias("names")).select("kind", F.explode(F.array_compact("names")).alias("name"))


def merged_duplicates(log: ObjectLog) -> ObjectLog:
    """Events of one activity and time that share objects, also over other such events, become the one with the smallest id.

    It has the objects of all of them.
    """
    rows = log.joined().select("eid", "oid", "activity", "us")
    least = rows.groupBy("oid", "activity", "us").agg(F.min("eid").alias("first"))
    links = rows.join(least, ["oid", "activity", "us"]).where("eid <> first").select("eid", "first")
    to = components(links, "eid", "first").select(F.col("id").alias("eid"), F.col("component_id").alias("to"))
    relations = log.relations.join(to, "eid", "left").withColumn("eid", F.coalesce("to", "eid")).select(*log.relations.columns).distinct()
    return replace(log, events=log.events.join(relations, "eid", "left_semi"), relations=relations)


def without_duplicates(log: ObjectLog) -> ObjectLog:
    """Of an object's events of one activity and time only the one with the smallest id keeps the relation."""
    rows = log.joined().groupBy("oid", "activity", "us").agg(F.min("eid").alias("eid"))
    relations = rows.select("eid", "oid").distinct()
    return replace(log, events=log.events.join(relations, "eid", "left_semi"), relations=relations)


def with_index_time(log: ObjectLog, step_us: int = 1) -> ObjectLog:
    """Times raised by the event's rank among the events of its time, so that no two of a time are equal."""
    rank = F.row_number().over(Window.partitionBy("us").orderBy("eid")) - 1
    return replace(log, events=log.events.withColumn("us", F.col("us") + rank * step_us))


def sample(log: ObjectLog, share: float, of: str = "object", seed: int = 0) -> ObjectLog:
    """A part of the objects, events or components, chosen by a hash of their ids: reruns agree, and nothing is sorted."""
    chosen = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.col(c).cast("string")), F.lit(1 << 20)) < share * (1 << 20)
    if of == "object":
        return of_objects(log, log.objects.where(chosen("oid")))
    if of == "event":
        return of_events(log, log.events.where(chosen("eid")))
    return of_objects(log, object_components(log).where(chosen("component")))


def renamed_objects(log: ObjectLog) -> DataFrame:
    """(oid, name): the type and the rank among its objects by first event, last event and id."""
    life = log.joined().groupBy("oid", "type").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy("first", "last", "oid"))
    return life.select("oid", F.concat("type", F.lit("_"), rank).alias("name"))


def consistent(log: ObjectLog) -> ObjectLog:
    """Without rows whose keys are null or empty, and one row for each event, object and relation."""
    def whole(table: DataFrame, *columns: str) -> DataFrame:
        met = F.lit(True)
        for c in columns:
            met = met & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return table.where(met)

    return replace(
        log,
        events=whole(log.events, "eid", "activity").dropDuplicates(["eid"]),
        objects=whole(log.objects, "oid", "type").dropDuplicates(["oid"]),
        relations=whole(log.relations, "eid", "oid").dropDuplicates(["eid", "oid"]),
    )


def attribute_as_type(log: ObjectLog, name: str) -> ObjectLog:
    """The values of an event attribute become objects of a type of its name."""
    value = F.col(name).cast("string")
    made = log.events.where(F.col(name).isNotNull()).select("eid", value.alias("oid"))
    objects = log.objects.unionByName(made.select("oid", F.lit(name).alias("type")).distinct(), allowMissingColumns=True)
    return replace(log, events=log.events.drop(name), objects=objects, relations=log.relations.unionByName(made))


def parents(log: ObjectLog, child: str, parent: str) -> DataFrame:
    """(oid, parent): of a child's events with parents the last, of its parents there the one with the largest id."""
    of = log.joined(parent).groupBy("eid").agg(F.max("oid").alias("parent"))
    rows = log.joined(child).join(of, "eid")
    return rows.groupBy("oid").agg(F.max_by("parent", F.struct("us", "eid")).alias("parent"))


def around(log: ObjectLog, after: bool = False) -> DataFrame:
    """(eid, oid, n, nearest): how many of the object's events come before (after) the event, and the nearest of them."""
    w = _life()
    n = F.count("*").over(Window.partitionBy("oid")) - F.row_number().over(w) if after else F.row_number().over(w) - 1
    nearest = F.lead("eid").over(w) if after else F.lag("eid").over(w)
    return log.joined().select("eid", "oid", n.alias("n"), nearest.alias("nearest"))


def life_variants(log: ObjectLog, kind: str) -> DataFrame:
    """(life: activities in order, n_objects) of a type: objects with one life are equivalent."""
    rows = log.joined(kind).groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "eid", "activity"))), lambda x: x["activity"]).alias("life"))
    return rows.groupBy("life").agg(F.count("*").alias("n_objects"))


def component_profiles(log: ObjectLog) -> DataFrame:
    """(profile, n): components by their numbers of objects of each type and events of each activity."""
    found = object_components(log)
    kinds = log.objects.join(found, "oid").select("component", F.concat(F.lit("type "), "type").alias("what"))
    one = log.relations.groupBy("eid").agg(F.min("oid").alias("oid"))  # the objects of an event are of one component
    acts = one.join(log.events.select("eid", "activity"), "eid").join(found, "oid").select("component", F.concat(F.lit("activity "), "activity").alias("what"))
    counts = kinds.union(acts).groupBy("component", "what").agg(F.count("*").alias("n"))
    profile = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "what", "n"))), ", ")
    return counts.groupBy("component").agg(profile.alias("profile")).groupBy("profile").agg(F.count("*").alias("n"))


def split_by_component(log: ObjectLog) -> DataFrame:
    """(component, eid): each event under the component of its objects, events of a lone object under that."""
    rows = log.relations.join(object_components(log), "oid", "left").select(F.coalesce("component", "oid").alias("component"), "eid")
    return rows.distinct()


def related_objects(log: ObjectLog) -> DataFrame:
    """(oid, type, n): for each object how many others of a type share an event with it."""
    typed = log.relations.join(log.objects.select("oid", "type"), "oid").select("eid", F.col("oid").alias("other"), "type")
    pairs = log.relations.select("eid", "oid").join(typed, "eid").where("oid <> other").select("oid", "other", "type")
    return pairs.repartition(*many(log.relations), "oid", "other").distinct().groupBy("oid", "type").agg(F.count("*").alias("n"))


def linked_events(log: ObjectLog, attribute: str) -> DataFrame:
    """(eid, eid_2): an event and the next one, in time, with the same value of an attribute."""
    after = F.lead("eid").over(Window.partitionBy(attribute).orderBy("us", "eid"))
    return log.events.where(F.col(attribute).isNotNull()).select("eid", after.alias("eid_2")).where("eid_2 IS NOT NULL")


def interleavings(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(direction, a, b, n): of paired cases (left_case, right_case) the steps from an event of one log to the next of the other.

    left and right are event tables (case_id, activity, us, event_idx); a pair's events are put in one order, and steps that change
    the log count.
    """
    l = pairs.join(left, pairs["left_case"] == left["case_id"]).select("left_case", "right_case", F.lit("l").alias("side"), "us", "event_idx", "activity")  # noqa: E741
    r = pairs.join(right, pairs["right_case"] == right["case_id"]).select("left_case", "right_case", F.lit("r").alias("side"), "us", "event_idx", "activity")
    w = Window.partitionBy("left_case", "right_case").orderBy("us", "side", "event_idx")
    rows = l.union(r).withColumn("b", F.lead("activity").over(w)).withColumn("to", F.lead("side").over(w)).where("to <> side")
    return rows.groupBy(F.concat("side", "to").alias("direction"), F.col("activity").alias("a"), "b").agg(F.count("*").alias("n"))


def log_to_objects(log: DataFrame, columns: dict[str, str]) -> ObjectLog:
    """An object-centric log whose objects are the values of columns of an event table, under the types given for them; ids are type:value."""
    events = log.select(F.col("event_idx").alias("eid"), "activity", "us")
    made = [log.where(F.col(c).isNotNull()).select(F.col("event_idx").alias("eid"), F.concat(F.lit(f"{t}:"), F.col(c).cast("string")).alias("oid"), F.lit(t).alias("type")) for c, t in columns.items()]
    rows = made[0]
    for more in made[1:]:
        rows = rows.union(more)
    rows = rows.distinct()
    return ObjectLog(events, rows.select("oid", "type").distinct(), rows.select("eid", "oid"))


def object_features(log: ObjectLog) -> DataFrame:
    """(oid, n_events, n_activities, first_us, last_us, lifetime_s, n_starts, n_ends, n_together): a row an object.

    n_starts and n_ends count the objects that begin or end at its first and last event, n_together the largest number of objects
    at one of its events.  Relations are gone through once: they get what they need of their event, are dealt by object in partitions that
    grow with the files, and only rows of objects are dealt by first and last event.
    """
    rows = log.relations.select("oid", "eid", F.count("*").over(Window.partitionBy("eid")).alias("together")).join(log.events.select("eid", "activity", "us"), "eid")
    at = F.struct("us", "eid")
    lives = rows.repartition(*many(log.relations), "oid").groupBy("oid").agg(
        F.count("*").alias("n_events"), F.size(F.collect_set("activity")).cast("long").alias("n_activities"),  # the alphabet at most
        F.min(at).alias("first"), F.max(at).alias("last"), F.max("together").alias("n_together"),
    )
    lives = lives.join(log.objects.select("oid"), "oid", "left_semi").select("oid", "n_events", "n_activities", "first", "last", "n_together")
    beside = lambda c: F.count("*").over(Window.partitionBy(f"{c}.eid"))
    out = lives.withColumn("n_starts", beside("first")).withColumn("n_ends", beside("last"))
    return out.select("oid", "n_events", "n_activities", F.col("first.us").alias("first_us"), F.col("last.us").alias("last_us"), ((F.col("last.us") - F.col("first.us")) / 1e6).alias("lifetime_s"), "n_starts", "n_ends", "n_together")


def event_features(log: ObjectLog) -> DataFrame:
    """(eid, activity, n_objects, n_types, n_new, n_gone): objects at an event, those that appear with it first and last."""
    w = Window.partitionBy("oid")
    at = F.struct("us", "eid")
    rows = log.joined().withColumn("first", F.min(at).over(w)["eid"]).withColumn("last", F.max(at).over(w)["eid"])
    return rows.groupBy("eid", "activity").agg(
        F.count("*").alias("n_objects"), F.count_distinct("type").alias("n_types"), F.count_if(F.col("first") == F.col("eid")).alias("n_new"), F.count_if(F.col("last") == F.col("eid")).alias("n_gone")
    )


def link_analysis(events: DataFrame, out_col: str | Column, in_col: str | Column) -> DataFrame:
    """(eid, eid_2): events whose out value is another event's in value."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    a = events.select("eid", as_col(out_col).alias("value")).where("value IS NOT NULL")
    b = events.select(F.col("eid").alias("eid_2"), as_col(in_col).alias("value")).where("value IS NOT NULL")
    return a.join(b, "value").where("eid <> eid_2").select("eid", "eid_2").distinct()


def linked_chains(links: DataFrame) -> DataFrame:
    """(eid, eid_2) of events that a chain of links (eid, eid_2) leads between: the flow that link_analysis() gives step by step."""
    pairs = path_pairs(links, "eid", "eid_2")
    return pairs.select(F.col("a").alias("eid"), F.col("b").alias("eid_2"))


def first_links(events: DataFrame, out_col: str | Column, in_col: str | Column) -> DataFrame:
    """(eid, eid_2): each event and the first later one (by us, eid) whose in value is its out value.

    Both sides are sorted together by value, last first, and the last target seen is kept: no pairs are made, no rows looked through again.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    out = events.select(as_col(out_col).alias("value"), "us", "eid", F.lit(False).alias("target"))
    into = events.select(as_col(in_col).alias("value"), "us", "eid", F.lit(True).alias("target"))
    w = Window.partitionBy("value").orderBy(F.desc("us"), F.desc("eid"), "target").rowsBetween(Window.unboundedPreceding, -1)
    rows = out.unionByName(into).where("value IS NOT NULL").withColumn("eid_2", F.last(F.when(F.col("target"), F.col("eid")), ignorenulls=True).over(w))
    return rows.where("NOT target AND eid_2 IS NOT NULL").select("eid", "eid_2")


def relatives(log: ObjectLog, kind: str) -> DataFrame:
    """(central, oid): each object of a type with its ancestors and descendants, itself included.

    An object is a parent of those that share an event with it and begin later; of two that begin together, one of the type is a parent
    of the other.
    """
    rows = log.joined()
    begin = rows.groupBy("oid").agg(F.min("us").alias("us"), F.max(F.col("type") == kind).alias("own"))
    pairs = log.relations.select("eid", F.col("oid").alias("x")).join(log.relations.select("eid", F.col("oid").alias("y")), "eid").where("x <> y").select("x", "y").distinct()
    side = lambda c: begin.select(F.col("oid").alias(c), F.col("us").alias(f"{c}_us"), F.col("own").alias(f"{c}_own"))
    rows = pairs.join(side("x"), "x").join(side("y"), "y")
    links = rows.where((F.col("x_us") < F.col("y_us")) | ((F.col("x_us") == F.col("y_us")) & F.col("x_own"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = kept(links, "parents")
    central = log.objects.where(F.col("type") == kind).select(F.col("oid").alias("id"))
    both = reach_from(links, central).unionByName(reach_from(links.select(F.col("b").alias("a"), F.col("a").alias("b")), central))
    return both.select(F.col("source").alias("central"), F.col("id").alias("oid")).unionByName(central.select(F.col("id").alias("central"), F.col("id").alias("oid"))).distinct()
