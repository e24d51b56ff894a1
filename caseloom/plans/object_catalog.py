"""Registered queries over object-centric logs with attributes, and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import kept, shared_dir
from ..operators import object_filters as of
from ..operators import object_tools as tools
from ..operators import objects
from ..sources import objects as files
from .catalog import QUERIES, SQL, E, log_of, object_log
from .catalog import O as PLAIN

#: The object log of the plain catalog with attributes; comp: components over shared events, by rounds of least names.
O = (  # noqa: E741
    PLAIN.replace("epoch_us(o_orderdate) AS us FROM orders", "epoch_us(o_orderdate) AS us, o_totalprice::DOUBLE AS total, o_orderpriority AS priority FROM orders", 1)
    + """, obj AS (SELECT DISTINCT oid, type, balance FROM rel JOIN (SELECT 'c' || c_custkey AS oid, c_acctbal::DOUBLE AS balance FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal::DOUBLE FROM supplier) USING (oid)),
few AS (SELECT o_orderkey AS eid, 'c' || o_custkey AS oid, 'customer' AS type FROM orders
  UNION SELECT l_orderkey, 'i' || l_orderkey || '-' || l_linenumber || l_returnflag, 'item ' || l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
"""
)
OUT = " SELECT eid, oid FROM "


def rich_log(spark: SparkSession, sf_dir: str) -> objects.ObjectLog:
    """Orders with total and priority, customers and suppliers with their balance."""
    plain = object_log(spark, sf_dir)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").withColumnsRenamed({"o_orderkey": "eid", "o_orderstatus": "activity", "o_orderpriority": "priority"})
    events = orders.select("eid", "activity", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.col("o_totalprice").cast("double").alias("total"), "priority")
    balance = read("customer").select(F.concat(F.lit("c"), "c_custkey").alias("oid"), F.col("c_acctbal").cast("double").alias("balance"))
    balance = balance.union(read("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("oid"), F.col("s_acctbal").cast("double").alias("balance")))
    return replace(plain, events=events, objects=plain.objects.join(balance, "oid"))


def sparse_log(spark: SparkSession, sf_dir: str) -> objects.ObjectLog:
    """Orders as events; customers and the items of orders as objects: a component for each customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    events = orders.select(F.col("o_orderkey").alias("eid"), F.col("o_orderstatus").alias("activity"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    customers = orders.select(F.col("o_orderkey").alias("eid"), F.concat(F.lit("c"), "o_custkey").alias("oid"), F.lit("customer").alias("type"))
    parts = items.select(F.col("l_orderkey").alias("eid"), F.concat(F.lit("i"), "l_orderkey", F.lit("-"), "l_linenumber", "l_returnflag").alias("oid"), F.concat(F.lit("item "), "l_returnflag").alias("type"))
    rows = customers.union(parts).repartition("eid").distinct()  # dealt by event once: what follows by event needs no other shuffle
    return objects.ObjectLog(events, rows.select("oid", "type").distinct(), rows.select("eid", "oid"))


def add(name: str, sql: str, f: Callable[[objects.ObjectLog], DataFrame], source=rich_log, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(source(spark, sf_dir))
    SQL[name] = (O.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else O) + sql


def filtered(name: str, sql: str, f: Callable[[objects.ObjectLog], objects.ObjectLog], **options) -> None:
    """The relations of a filtered log; sql is the condition on rel or a query."""
    add(name, "x AS (SELECT 1)" + (sql if sql.startswith(",") else OUT + "rel WHERE " + sql), lambda log: f(log).relations.select("eid", "oid"), **options)


# Filters: attributes, types, activities, counts, ends, time
filtered("oc_filter_event_attribute", "eid IN (SELECT eid FROM ev WHERE priority IN ('1-URGENT', '2-HIGH'))", lambda log: of.events_where(log, F.col("priority").isin("1-URGENT", "2-HIGH")))
filtered("oc_filter_event_number", "eid NOT IN (SELECT eid FROM ev WHERE total > 150000)", lambda log: of.events_where(log, F.col("total") > 150000, positive=False))
filtered("oc_filter_object_attribute", ", y AS (SELECT oid FROM obj WHERE balance > 5000) SELECT eid, oid FROM rel JOIN y USING (oid)", lambda log: of.objects_where(log, F.col("balance") > 5000))
filtered("oc_filter_types", "type = 'supplier'", lambda log: of.types(log, ["supplier"]))
filtered("oc_filter_objects", "oid IN ('c1', 'c7', 's3', 's10')", lambda log: of.objects_where(log, F.col("oid").isin("c1", "c7", "s3", "s10")))
filtered("oc_filter_events", "eid % 10 = 0", lambda log: of.events_where(log, F.col("eid") % 10 == 0))
filtered(
    "oc_filter_allowed_activities",
    ", y AS (SELECT * FROM j WHERE type = 'customer' AND activity = 'F' OR type = 'supplier' AND activity IN ('O', 'P')) SELECT eid, oid FROM y",
    lambda log: of.activities_of_types(log, {"customer": ["F"], "supplier": ["O", "P"]}),
)
filtered("oc_filter_type_counts", "eid IN (SELECT eid FROM rel GROUP BY eid HAVING count(*) FILTER (type = 'customer') >= 1 AND count(*) FILTER (type = 'supplier') >= 4)", lambda log: of.least_objects(log, {"customer": 1, "supplier": 4}))
filtered("oc_filter_start_events", ", y AS (SELECT DISTINCT first_eid AS eid FROM ends WHERE oid LIKE 'c%') SELECT eid, oid FROM rel JOIN y USING (eid)", lambda log: of.end_events(log, "customer"))
filtered("oc_filter_end_events", ", y AS (SELECT DISTINCT last_eid AS eid FROM ends WHERE oid LIKE 's%') SELECT eid, oid FROM rel JOIN y USING (eid)", lambda log: of.end_events(log, "supplier", last=True))
filtered("oc_filter_time", "eid IN (SELECT eid FROM ev WHERE us BETWEEN 800000000000000 AND 850000000000000)", lambda log: of.in_time(log, 800_000_000_000_000, 850_000_000_000_000))
filtered("oc_filter_connected_activities", ", y AS (SELECT DISTINCT activity FROM j WHERE type = 'supplier') SELECT eid, oid FROM j JOIN y USING (activity)", lambda log: of.activities_seen_with(log, "supplier"))
filtered("oc_filter_relations", "type = 'customer' AND eid % 2 = 0", lambda log: of.of_relations(log, log.joined("customer").where("eid % 2 = 0").select("eid", "oid")))

# Components over shared events (SQL: reachability from every object, by rounds)
COMP = """hub AS (SELECT DISTINCT oid, min(oid) OVER (PARTITION BY eid) AS hub FROM few), links AS (SELECT oid AS a, hub AS b FROM hub WHERE oid <> hub UNION SELECT hub, oid FROM hub WHERE oid <> hub),
reach(oid, other) AS (SELECT a, a FROM links UNION SELECT reach.oid, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT oid, min(other) AS component FROM reach GROUP BY oid)
"""
FEW = "SELECT eid, oid FROM few WHERE oid IN "
add("oc_components", COMP + "SELECT oid, component FROM comp", of.object_components, sparse_log, True)
add("oc_component_of_object", COMP + FEW + "(SELECT oid FROM comp WHERE component = (SELECT component FROM comp WHERE oid = 'c7')) OR oid = 'c7'", lambda log: of.component_of(log, "c7").relations.select("eid", "oid"), sparse_log, True)
add("oc_components_of_size", COMP + FEW + "(SELECT oid FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) BETWEEN 2 AND 40))", lambda log: of.components_of_size(log, 2, 40).relations.select("eid", "oid"), sparse_log, True)
add("oc_components_with_type", COMP + FEW + "(SELECT oid FROM comp WHERE component IN (SELECT component FROM comp JOIN few USING (oid) WHERE type = 'item R'))", lambda log: of.components_with_type(log, "item R").relations.select("eid", "oid"), sparse_log, True)
add("oc_components_with_activity", COMP + FEW + "(SELECT oid FROM comp WHERE component IN (SELECT component FROM comp JOIN few USING (oid) JOIN ev USING (eid) WHERE activity = 'P'))", lambda log: of.components_with_activity(log, "P").relations.select("eid", "oid"), sparse_log, True)
add("oc_split_by_component", COMP + "SELECT DISTINCT coalesce(component, oid) AS component, eid FROM few LEFT JOIN comp USING (oid)", tools.split_by_component, sparse_log, True)
add(
    "oc_component_profiles",
    COMP + """SELECT profile, count(*) AS n FROM (SELECT component, string_agg(what || '=' || n, ', ' ORDER BY what || '=' || n) AS profile FROM (
  SELECT component, what, count(DISTINCT id) AS n FROM (SELECT component, 'type ' || type AS what, oid AS id FROM few JOIN comp USING (oid)
    UNION ALL SELECT component, 'activity ' || activity, eid::VARCHAR FROM few JOIN comp USING (oid) JOIN ev USING (eid)) GROUP BY ALL) GROUP BY component) GROUP BY profile""",
    tools.component_profiles, sparse_log, True,
)

# Tools
X = "x AS (SELECT 1) "
add("oc_attribute_names", X + "SELECT * FROM (VALUES ('event', 'total'), ('event', 'priority'), ('object', 'balance')) t(level, name)", tools.attribute_names)
add("oc_attributes_by_activity", X + "SELECT activity AS kind, name FROM (SELECT DISTINCT activity FROM ev) CROSS JOIN (VALUES ('total'), ('priority')) t(name)", lambda log: tools.attributes_by_kind(log.events, "activity", ("eid", "us")))
LEAST = X + ", least AS (SELECT oid, activity, us, min(eid) AS keep FROM j GROUP BY ALL)"
MERGED = """, pair AS (SELECT DISTINCT eid AS a, keep AS b FROM j JOIN least USING (oid, activity, us) WHERE eid <> keep), links AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach(eid, other) AS (SELECT a, a FROM links UNION SELECT reach.eid, links.b FROM reach JOIN links ON links.a = reach.other), to_ AS (SELECT eid, min(other) AS keep FROM reach GROUP BY eid)
SELECT DISTINCT coalesce(keep, eid) AS eid, oid FROM rel LEFT JOIN to_ USING (eid)"""
add("oc_merged_duplicates", LEAST + MERGED, lambda log: tools.merged_duplicates(log).relations, recursive=True)
add("oc_without_duplicates", LEAST + " SELECT DISTINCT keep AS eid, oid FROM least", lambda log: tools.without_duplicates(log).relations)
add("oc_index_time", X + "SELECT eid, us + row_number() OVER (PARTITION BY us ORDER BY eid) - 1 AS us FROM ev", lambda log: tools.with_index_time(log).events.select("eid", "us"))
add("oc_renamed_objects", X + "SELECT oid, type || '_' || row_number() OVER (PARTITION BY type ORDER BY a, b, oid) AS name FROM (SELECT oid, type, min(us) AS a, max(us) AS b FROM j GROUP BY ALL)", tools.renamed_objects)
add("oc_consistent", X + "SELECT eid, oid FROM rel", lambda log: tools.consistent(replace(log, relations=log.relations.union(log.relations).union(log.relations.selectExpr("eid", "nullif(oid, oid)")))).relations)
add("oc_attribute_as_type", X + "SELECT oid, type FROM obj UNION SELECT DISTINCT priority, 'priority' FROM ev", lambda log: tools.attribute_as_type(log, "priority").objects.select("oid", "type"))
add("oc_parents", X + "SELECT oid, arg_max(p, (us, eid)) AS parent FROM (SELECT eid, max(oid) AS p FROM rel WHERE type = 'customer' GROUP BY eid) JOIN j USING (eid) WHERE type = 'supplier' GROUP BY oid", lambda log: tools.parents(log, "supplier", "customer"))
add("oc_prefixes", X + "SELECT eid, oid, row_number() OVER w - 1 AS n, lag(eid) OVER w AS nearest FROM j WINDOW w AS (PARTITION BY oid ORDER BY us, eid)", tools.around)
add("oc_suffixes", X + "SELECT eid, oid, count(*) OVER (PARTITION BY oid) - row_number() OVER w AS n, lead(eid) OVER w AS nearest FROM j WINDOW w AS (PARTITION BY oid ORDER BY us, eid)", lambda log: tools.around(log, after=True))
add("oc_equivalent_objects", X + "SELECT array_to_string(life, ',') AS life, count(*) AS n_objects FROM (SELECT list(activity ORDER BY us, eid) AS life FROM j WHERE type = 'customer' GROUP BY oid) GROUP BY life", lambda log: tools.life_variants(log, "customer").withColumn("life", F.array_join("life", ",")))
add("oc_related_objects", X + "SELECT oid, type, count(*) AS n FROM (SELECT DISTINCT a.oid, b.type, b.oid AS other FROM rel a JOIN rel b USING (eid) WHERE a.oid <> b.oid) GROUP BY ALL", tools.related_objects)
add("oc_linked_events", X + "SELECT * FROM (SELECT eid, lead(eid) OVER (PARTITION BY priority ORDER BY us, eid) AS eid_2 FROM ev) WHERE eid_2 IS NOT NULL", lambda log: tools.linked_events(log, "priority"))
add(
    "oc_object_features",
    X + """, many AS (SELECT eid, count(*) AS k FROM rel GROUP BY eid), f AS (SELECT oid, count(*) AS n_events, count(DISTINCT activity) AS n_activities, min(us) AS first_us, max(us) AS last_us, max(k) AS n_together FROM j JOIN many USING (eid) GROUP BY oid)
SELECT oid, n_events, n_activities, first_us, last_us, (last_us - first_us) / 1e6 AS lifetime_s, count(*) OVER (PARTITION BY first_eid) AS n_starts, count(*) OVER (PARTITION BY last_eid) AS n_ends, n_together FROM f JOIN ends USING (oid)""",
    tools.object_features,
)
add(
    "oc_event_features",
    X + """SELECT eid, activity, count(*) AS n_objects, count(DISTINCT type) AS n_types, count(*) FILTER (eid = first_eid) AS n_new, count(*) FILTER (eid = last_eid) AS n_gone FROM j JOIN ends USING (oid) GROUP BY ALL""",
    tools.event_features,
)
add(
    "oc_link_analysis",
    X + "SELECT DISTINCT a.eid, b.eid AS eid_2 FROM ev a JOIN ev b ON a.eid + 1 = b.eid - 1 AND a.eid <> b.eid",
    lambda log: tools.link_analysis(log.events, F.col("eid") + 1, F.col("eid") - 1),
)

NEXT = "nxt AS (SELECT * FROM (SELECT eid, lead(eid) OVER (PARTITION BY oid ORDER BY us, eid) AS eid_2 FROM j WHERE type = 'customer') WHERE eid_2 IS NOT NULL)"
add("oc_first_links", NEXT + " SELECT eid, eid_2 FROM nxt", lambda log: tools.first_links(_customers(log), "customer", "customer"))
add("oc_linked_chains", NEXT + ", chain(eid, eid_2) AS (SELECT eid, eid_2 FROM nxt UNION SELECT chain.eid, nxt.eid_2 FROM chain JOIN nxt ON nxt.eid = chain.eid_2) SELECT eid, eid_2 FROM chain", lambda log: tools.linked_chains(tools.first_links(_customers(log), "customer", "customer")), recursive=True)


def _customers(log: objects.ObjectLog) -> DataFrame:
    return log.joined("customer").select("eid", "us", F.col("oid").alias("customer"))


def _priorities(spark: SparkSession, sf_dir: str) -> objects.ObjectLog:
    """Orders as events; their priorities and customers as objects."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    events = orders.select(F.col("o_orderkey").alias("eid"), F.col("o_orderstatus").alias("activity"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    rows = orders.select(F.col("o_orderkey").alias("eid"), F.concat(F.lit("c"), "o_custkey").alias("oid"), F.lit("customer").alias("type")).union(orders.select("o_orderkey", "o_orderpriority", F.lit("priority"))).distinct()
    return objects.ObjectLog(events, rows.select("oid", "type").distinct(), rows.select("eid", "oid"))


add(
    "oc_relatives",
    """r AS (SELECT o_orderkey AS eid, 'c' || o_custkey AS oid, epoch_us(o_orderdate) AS us, false AS own FROM orders UNION SELECT o_orderkey, o_orderpriority, epoch_us(o_orderdate), true FROM orders),
st AS (SELECT oid, own, min(us) AS us FROM r GROUP BY ALL), up AS (SELECT DISTINCT x.oid AS a, y.oid AS b FROM r x JOIN r y ON x.eid = y.eid AND x.oid <> y.oid JOIN st sx ON sx.oid = x.oid JOIN st sy ON sy.oid = y.oid WHERE sx.us < sy.us OR sx.us = sy.us AND sx.own),
des(central, oid) AS (SELECT oid, oid FROM st WHERE own UNION SELECT central, b FROM des JOIN up ON a = oid), anc(central, oid) AS (SELECT oid, oid FROM st WHERE own UNION SELECT central, a FROM anc JOIN up ON b = oid)
SELECT central, oid FROM des UNION SELECT central, oid FROM anc""",
    lambda log: tools.relatives(log, "priority"), _priorities, True,
)


def _interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events and the others of each user, taken as two logs of paired cases."""
    log = log_of(spark, sf_dir)
    pairs = log.select(F.col("case_id").alias("left_case"), F.col("case_id").alias("right_case")).distinct()
    return tools.interleavings(log.where("activity = 'click'"), log.where("activity <> 'click'"), pairs)


QUERIES["log_interleavings"] = _interleaved
SQL["log_interleavings"] = E + """SELECT side || other AS direction, activity AS a, b, count(*) AS n FROM (
  SELECT activity, side, lead(activity) OVER w AS b, lead(side) OVER w AS other FROM (SELECT *, CASE WHEN activity = 'click' THEN 'l' ELSE 'r' END AS side FROM e)
  WINDOW w AS (PARTITION BY case_id ORDER BY us, side, event_idx)) WHERE other <> side GROUP BY ALL"""
QUERIES["log_to_objects"] = lambda spark, sf_dir: tools.log_to_objects(log_of(spark, sf_dir), {"case_id": "user", "resource": "key"}).joined().groupBy("type", "activity").agg(F.count("*").alias("n"), F.count_distinct("oid").alias("objects"))
SQL["log_to_objects"] = E + "SELECT type, activity, count(*) AS n, count(DISTINCT oid) AS objects FROM (SELECT event_idx, activity, case_id::VARCHAR AS oid, 'user' AS type FROM e UNION SELECT event_idx, activity, resource, 'key' FROM e WHERE resource IS NOT NULL) GROUP BY ALL"


def _sampled(of_: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tools.sample(sparse_log(spark, sf_dir), 0.5, of_).relations.select("eid", "oid")


for _kind in ("object", "event", "component"):  # chosen by a hash that SQL lacks: tested for shares and whole components
    QUERIES[f"oc_sample_{_kind}s"] = _sampled(_kind)


def _round_trip(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rich log written to the shared folder and read again: its relations with the attributes of both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, log = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}", rich_log(spark, sf_dir)
        relations = kept(log.relations, "relations")  # the writers go over the log several times
        log = replace(log, relations=relations, objects=kept(log.objects, "objects"))
        if kind == "xml":
            files.write_object_xml(log, path)
            back = files.read_object_xml(spark, path, 4 << 20)
        elif kind == "json":
            files.write_object_json(log, path)
            back = files.read_object_json(spark, path)
        else:
            files.write_object_csv(log, path)
            back = files.read_object_csv(spark, f"{path}/events", f"{path}/objects", kinds={"total": "float", "balance": "float"})
        # Relations lie in their events' records, of whose number a file's size tells little: Spark would broadcast them all.
        rows = back.relations.hint("merge").join(back.events, "eid").join(back.objects.hint("merge"), "oid")
        return rows.select("eid", "oid", "type", "activity", "us", "priority", F.round("total", 2).alias("total"), F.round("balance", 2).alias("balance"))

    return run


for _kind in ("xml", "json", "csv"):
    QUERIES[f"oc_{_kind}_round_trip"] = _round_trip(_kind)
    SQL[f"oc_{_kind}_round_trip"] = O + X + "SELECT eid::VARCHAR AS eid, oid, obj.type, activity, us, priority, round(total, 2) AS total, round(balance, 2) AS balance FROM rel JOIN ev USING (eid) JOIN obj USING (oid)"
