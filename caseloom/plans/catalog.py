"""Registered queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import many
from ..operators import declarative, discovery, features, filters, objects, organisation, relations, statistics
from ..schema import EVENTS, EventSchema, canonical

ORDERS = EventSchema("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey", "o_orderpriority")
ACTIVITIES = ("click", "error", "purchase", "signup", "view")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The canonical events table, then e with order-dependent columns.
E = """WITH e AS (SELECT user_id AS case_id, event_type AS activity, ts, event_id AS event_idx, epoch_us(ts) AS us, json_extract_string(props, '$.k') AS resource, value FROM events),
s AS (SELECT *, row_number() OVER w - 1 AS p, lead(activity) OVER w AS b, lead(us) OVER w AS us2, lead(resource) OVER w AS rb, lag(activity) OVER w AS pa FROM e WINDOW w AS (PARTITION BY case_id ORDER BY us, event_idx)),
c AS (SELECT case_id, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us, arg_min(activity, (us, event_idx)) AS first_activity, arg_max(activity, (us, event_idx)) AS last_activity FROM e GROUP BY case_id),
v AS (SELECT case_id, list(activity ORDER BY us, event_idx) AS variant FROM e GROUP BY case_id)
"""
KEPT = "SELECT case_id, event_idx, activity FROM e WHERE case_id "
O = """WITH ev AS (SELECT o_orderkey AS eid, o_orderstatus AS activity, epoch_us(o_orderdate) AS us FROM orders),
rel AS (SELECT o_orderkey AS eid, 'c' || o_custkey AS oid, 'customer' AS type FROM orders
  UNION SELECT l_orderkey, 's' || l_suppkey, 'supplier' FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
j AS (SELECT * FROM rel JOIN ev USING (eid)),
ends AS (SELECT oid, max(eid) FILTER (r = 1) AS first_eid, max(eid) FILTER (z = 1) AS last_eid FROM
  (SELECT oid, eid, row_number() OVER (PARTITION BY oid ORDER BY us, eid) AS r, row_number() OVER (PARTITION BY oid ORDER BY us DESC, eid DESC) AS z FROM j) GROUP BY oid)
"""  # noqa: E741


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark.read.parquet(f"{sf_dir}/events.parquet"), EVENTS)


def object_log(spark: SparkSession, sf_dir: str) -> objects.ObjectLog:
    """Orders as events; customers and suppliers as objects.

    Relations are dealt by event once, objects by object, in partitions whose number grows with the tables.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = many(orders, lines)
    items = lines.select(F.col("l_orderkey").alias("eid"), F.concat(F.lit("s"), "l_suppkey").alias("oid"))
    events = orders.select(F.col("o_orderkey").alias("eid"), F.col("o_orderstatus").alias("activity"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    customers = orders.select(F.col("o_orderkey").alias("eid"), F.concat(F.lit("c"), "o_custkey").alias("oid"))
    known = events.select("eid").repartition(*parts, "eid").distinct()  # a left_semi join would be put before the items are dealt, which deals them twice
    items = items.repartition(*parts, "eid").join(known, "eid")
    relations_ = customers.repartition(*parts, "eid").union(items).distinct()
    kinds = relations_.select("oid").distinct().repartition(*parts, "oid").select("oid", F.when(F.col("oid").startswith("c"), "customer").otherwise("supplier").alias("type"))
    return objects.ObjectLog(events, kinds, relations_)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(log_of(spark, sf_dir))
        if sql:
            SQL[name] = E + sql
        return f

    return add


def kept(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda log: f(log).select("case_id", "event_idx", "activity"))


def object_query(name: str, sql: str, f: Callable[[objects.ObjectLog], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(object_log(spark, sf_dir))
    SQL[name] = O + sql


# Relations
query("dfg", "SELECT activity AS a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL")(relations.dfg)
query("dfg_once_per_case", "SELECT activity AS a, b, count(DISTINCT case_id) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL")(lambda log: relations.dfg(log, once_per_case=True))
query("dfg_window2", "SELECT a, b, count(*) AS n FROM (SELECT activity AS a, lead(activity, 2) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS b FROM e) WHERE b IS NOT NULL GROUP BY ALL")(lambda log: relations.dfg(log, 2))
GAP = "SELECT activity AS a, b, (us2 - us) / 1e6 AS g FROM s WHERE b IS NOT NULL"
query(
    "performance_dfg",
    f"SELECT a, b, count(*) AS n, round(avg(g), 3) AS mean_s, min(g) AS min_s, max(g) AS max_s, round(stddev_samp(g), 3) AS stdev_s, round(median(g), 3) AS median_s FROM ({GAP}) GROUP BY ALL",
)(lambda log: relations.performance_dfg(log).select("a", "b", "n", F.round("mean_s", 3).alias("mean_s"), "min_s", "max_s", F.round("stdev_s", 3).alias("stdev_s"), F.round("median_s", 3).alias("median_s")))
query("frequent_triples", "SELECT activity AS a, b, d AS c, count(*) AS n FROM (SELECT *, lead(activity, 2) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS d FROM s) WHERE d IS NOT NULL GROUP BY ALL")(relations.triples)
query("start_activities", "SELECT first_activity AS activity, count(*) AS n FROM c GROUP BY ALL")(relations.endpoints)
query("end_activities", "SELECT last_activity AS activity, count(*) AS n FROM c GROUP BY ALL")(lambda log: relations.endpoints(log, "last_activity"))
PAIRS = "SELECT x.case_id, x.activity AS a, y.activity AS b, (y.us - x.us) / 1e6 AS gap FROM e x JOIN e y ON x.case_id = y.case_id AND (x.us, x.event_idx) < (y.us, y.event_idx)"
query("eventually_follows", f"SELECT a, b, count(*) AS n FROM ({PAIRS}) GROUP BY ALL")(relations.eventually_follows)
query("edges_by_value", "SELECT activity AS a, b, resource AS value, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL")(lambda log: relations.case_attribute_edges(log, "resource"))
FOOT = "d AS (SELECT activity AS a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL)"
query("footprints", f", {FOOT} SELECT x.a, x.b, CASE WHEN y.n IS NULL THEN 'sequence' ELSE 'parallel' END AS relation FROM d x LEFT JOIN d y ON x.a = y.b AND x.b = y.a")(relations.footprints)
query("causal_dependency", f", {FOOT} SELECT x.a, x.b, (x.n - coalesce(y.n, 0)) / (x.n + coalesce(y.n, 0) + 1)::DOUBLE AS dependency FROM d x LEFT JOIN d y ON x.a = y.b AND x.b = y.a")(relations.causal)
query("temporal_profile", f"SELECT a, b, count(*) AS n, round(avg(gap), 2) AS mean_s, round(coalesce(stddev_samp(gap), 0), 2) AS stdev_s FROM ({PAIRS}) GROUP BY ALL")(
    lambda log: relations.temporal_profile(log).select("a", "b", "n", F.round("mean_s", 2).alias("mean_s"), F.round("stdev_s", 2).alias("stdev_s"))
)
query(
    "temporal_deviations",
    f", q AS ({PAIRS}), t AS (SELECT a, b, avg(gap) AS m, coalesce(stddev_samp(gap), 0) AS d FROM q GROUP BY ALL) SELECT a, b, count(*) AS n FROM q JOIN t USING (a, b) WHERE abs(gap - m) > 3 * d GROUP BY ALL",
)(lambda log: relations.temporal_deviations(log, relations.temporal_profile(log), 3).groupBy("a", "b").agg(F.count("*").alias("n")))
query("self_distance", "SELECT activity, min(q - p - 1) AS distance FROM (SELECT activity, p, lead(p) OVER (PARTITION BY case_id, activity ORDER BY p) AS q FROM s) WHERE q IS NOT NULL GROUP BY ALL")(relations.self_distance)

# Filters
kept("filter_events_values", "SELECT case_id, event_idx, activity FROM e WHERE activity IN ('click', 'purchase')", lambda log: filters.events_with(log, "activity", ["click", "purchase"]))
kept("filter_cases_without_value", KEPT + "NOT IN (SELECT case_id FROM e WHERE resource = '7')", lambda log: filters.cases_with(log, "resource", ["7"], keep=False))
kept("filter_numeric_events", "SELECT case_id, event_idx, activity FROM e WHERE value BETWEEN 10 AND 20", lambda log: filters.events_between(log, "value", 10, 20))
kept("filter_numeric_cases", KEPT + "IN (SELECT case_id FROM e WHERE value BETWEEN 0 AND 1 AND activity = 'error')", lambda log: filters.cases_between(log, "value", 0, 1, activity="error"))
kept("filter_frequent_activities", "SELECT case_id, event_idx, activity FROM e WHERE activity IN (SELECT activity FROM e GROUP BY activity HAVING count(*) >= 2000)", lambda log: filters.frequent_activities(log, 2000))
kept("filter_top_activities", "SELECT case_id, event_idx, activity FROM e WHERE activity IN (SELECT activity FROM e GROUP BY activity ORDER BY count(*) DESC, activity LIMIT 2)", lambda log: filters.top_activities(log, 2))
kept("filter_relative_occurrence", "SELECT case_id, event_idx, activity FROM e WHERE resource IN (SELECT resource FROM e GROUP BY resource HAVING count(DISTINCT case_id) >= 0.5 * (SELECT count(DISTINCT case_id) FROM e))", lambda log: filters.relative_occurrence(log, "resource", 0.5))
kept("filter_start", KEPT + "IN (SELECT case_id FROM c WHERE first_activity = 'view')", lambda log: filters.starting_with(log, ["view"]))
kept("filter_end", KEPT + "IN (SELECT case_id FROM c WHERE last_activity IN ('click', 'error'))", lambda log: filters.ending_with(log, ["click", "error"]))
kept("filter_frequent_starts", KEPT + "IN (SELECT case_id FROM c WHERE first_activity IN (SELECT first_activity FROM c GROUP BY ALL HAVING count(*) >= 31))", lambda log: filters.frequent_ends(log, 31))
kept("filter_frequent_ends", KEPT + "IN (SELECT case_id FROM c WHERE last_activity IN (SELECT last_activity FROM c GROUP BY ALL HAVING count(*) >= 31))", lambda log: filters.frequent_ends(log, 31, "last_activity"))
T1, T2 = 1_704_240_000_000_000, 1_706_400_000_000_000  # 2024-01-03 and 2024-01-28
kept("filter_time_contained", KEPT + f"IN (SELECT case_id FROM c WHERE first_us >= {T1} AND last_us <= {T2})", lambda log: filters.cases_in_time(log, T1, T2))
kept("filter_time_intersecting", KEPT + f"IN (SELECT case_id FROM c WHERE (first_us > {T1} AND first_us < {T2}) OR (last_us > {T1} AND last_us < {T2}) OR (first_us < {T1} AND last_us > {T2}))", lambda log: filters.cases_in_time(log, T1, T2, "intersecting"))
kept("filter_time_starting", KEPT + f"IN (SELECT case_id FROM c WHERE first_us BETWEEN {T1} AND {T2})", lambda log: filters.cases_in_time(log, T1, T2, "starting"))
kept("filter_time_completing", KEPT + f"IN (SELECT case_id FROM c WHERE last_us BETWEEN {T1} AND {T2})", lambda log: filters.cases_in_time(log, T1, T2, "completing"))
kept("filter_largest_cases", KEPT + "IN (SELECT case_id FROM c ORDER BY n_events DESC, case_id LIMIT 20)", lambda log: filters.largest_cases(log, 20))
kept("filter_case_size", KEPT + "IN (SELECT case_id FROM c WHERE n_events BETWEEN 60 AND 70)", lambda log: filters.case_size(log, 60, 70))
kept("filter_case_duration", KEPT + "IN (SELECT case_id FROM c WHERE (last_us - first_us) / 1e6 BETWEEN 0 AND 2500000)", lambda log: filters.case_duration(log, 0, 2_500_000))
kept("filter_variants_top", KEPT + "IN (SELECT case_id FROM v WHERE variant IN (SELECT variant FROM v GROUP BY variant ORDER BY count(*) DESC, variant DESC LIMIT 5))", lambda log: filters.top_variants(log, 5))
kept("filter_path", KEPT + "NOT IN (SELECT case_id FROM s WHERE activity = 'purchase' AND b = 'signup')", lambda log: filters.with_path(log, [("purchase", "signup")], keep=False))
kept("filter_path_performance", KEPT + "IN (SELECT case_id FROM s WHERE activity = 'error' AND b = 'click' AND (us2 - us) / 1e6 BETWEEN 0 AND 600)", lambda log: filters.with_path(log, [("error", "click")], low_s=0, high_s=600))
kept("filter_eventually_follows", KEPT + "IN (SELECT x.case_id FROM s x JOIN s y ON x.case_id = y.case_id AND x.p < y.p JOIN s z ON y.case_id = z.case_id AND y.p < z.p WHERE x.activity = 'signup' AND y.activity = 'error' AND z.activity = 'purchase')", lambda log: filters.eventually_follows(log, ["signup", "error", "purchase"]))
kept("filter_four_eyes", KEPT + "IN (SELECT case_id FROM (SELECT case_id, arg_max(resource, (us, event_idx)) AS rb FROM e WHERE activity = 'purchase' GROUP BY 1) l JOIN (SELECT case_id, list(resource) AS ra FROM e WHERE activity = 'signup' GROUP BY 1) r USING (case_id) WHERE NOT list_contains(ra, rb))", lambda log: filters.four_eyes(log, "signup", "purchase"))
kept("filter_different_persons", KEPT + "IN (SELECT case_id FROM e WHERE activity = 'error' GROUP BY 1 HAVING count(DISTINCT resource) > 1)", lambda log: filters.different_persons(log, "error"))
kept("filter_rework", KEPT + "IN (SELECT case_id FROM e WHERE activity = 'purchase' GROUP BY 1 HAVING count(*) >= 15)", lambda log: filters.value_repeats(log, "activity", "purchase", 15))
FIRST = "(SELECT case_id, min((us, event_idx)) AS f FROM e WHERE activity = 'error' GROUP BY 1)"
kept("filter_prefixes", f"SELECT case_id, event_idx, activity FROM e JOIN {FIRST} USING (case_id) WHERE (us, event_idx) < f", lambda log: filters.prefixes(log, "error"))
kept("filter_suffixes", f"SELECT case_id, event_idx, activity FROM e JOIN {FIRST} USING (case_id) WHERE (us, event_idx) > f", lambda log: filters.suffixes(log, "error"))
kept("filter_starts_with", KEPT + "IN (SELECT case_id FROM v WHERE variant[1:2] = ['view', 'click'])", lambda log: filters.starts_with(log, ["view", "click"]))
kept("filter_ends_with", KEPT + "IN (SELECT case_id FROM v WHERE variant[-2:] = ['click', 'error'])", lambda log: filters.ends_with(log, ["click", "error"]))
kept("filter_collapse_runs", "SELECT case_id, event_idx, activity FROM s WHERE pa IS DISTINCT FROM activity", filters.collapse_runs)
query("split_at_activity", "SELECT case_id || '##@@' || sum(CASE WHEN activity = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS case_id, event_idx FROM e")(
    lambda log: filters.split_at(log, "signup").select("case_id", "event_idx")
)

# Statistics
query("variants", "SELECT variant, count(*) AS n FROM v GROUP BY ALL")(statistics.variant_counts)
query("stochastic_language", "SELECT variant, count(*) / (SELECT count(*) FROM v)::DOUBLE AS probability FROM v GROUP BY ALL")(statistics.language)
query("case_durations", "SELECT case_id, n_events, first_us / 1e6 AS start_s, last_us / 1e6 AS end_s, (last_us - first_us) / 1e6 AS duration_s FROM c")(statistics.case_durations)
query("duration_quantiles", "SELECT quantile_cont((last_us - first_us) / 1e6, 0.25) AS q1_s, median((last_us - first_us) / 1e6) AS median_s, round(avg((last_us - first_us) / 1e6), 3) AS mean_s FROM c")(
    lambda log: statistics.duration_quantiles(log).select("q1_s", "median_s", F.round("mean_s", 3).alias("mean_s"))
)
query("case_arrival", "SELECT (max(first_us) - min(first_us)) / 1e6 / (count(*) - 1) AS mean_gap_s FROM c")(statistics.arrival)
query("case_dispersion", "SELECT (max(last_us) - min(last_us)) / 1e6 / (count(*) - 1) AS mean_gap_s FROM c")(lambda log: statistics.arrival(log, end=True))
query("rework_cases", "SELECT activity, count(*) AS n_cases FROM (SELECT activity, case_id FROM e GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL")(statistics.rework)
query("case_rework", "SELECT case_id, count(*) AS n_events, count(*) - count(DISTINCT activity) AS n_rework FROM e GROUP BY ALL")(statistics.case_rework)
query("attribute_values", "SELECT resource AS value, count(DISTINCT case_id) AS n FROM e WHERE resource IS NOT NULL GROUP BY ALL")(lambda log: statistics.attribute_values(log, "resource", once_per_case=True))
query("events_by_hour", "SELECT h AS value, count(activity) AS n FROM range(24) r(h) LEFT JOIN e ON hour(ts) = h GROUP BY ALL")(lambda log: statistics.events_distribution(log, "hours"))
query("events_by_weekday", "SELECT h AS value, count(activity) AS n FROM range(7) r(h) LEFT JOIN e ON isodow(ts) - 1 = h GROUP BY ALL")(statistics.events_distribution)
query("case_overlap", "SELECT x.case_id, count(*) AS n_open FROM c x JOIN c y ON y.first_us <= x.last_us AND y.last_us >= x.first_us GROUP BY ALL")(statistics.case_overlap)
query("activity_positions", "SELECT p AS position, count(*) AS n FROM s WHERE activity = 'error' GROUP BY ALL")(lambda log: statistics.positions(log, "error"))
query("successors", "SELECT b AS activity, count(*) AS n, round(avg((us2 - us) / 1e6), 3) AS mean_s FROM s WHERE activity = 'error' AND b IS NOT NULL GROUP BY ALL")(lambda log: statistics.around(log, "error").withColumn("mean_s", F.round("mean_s", 3)))
query("successor_entropy", "SELECT activity, round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT activity, count(*) / sum(count(*)) OVER (PARTITION BY activity)::DOUBLE AS p FROM s GROUP BY activity, coalesce(b, '')) GROUP BY ALL")(
    lambda log: statistics.successor_entropy(log).withColumn("entropy", F.round("entropy", 9))
)
query(
    "batches",
    ", r AS (SELECT *, CASE WHEN lag(us) OVER w + 3600000000 >= us THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY activity, resource ORDER BY us, event_idx)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY activity, resource ORDER BY us, event_idx) AS g FROM r) SELECT activity, resource, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM k GROUP BY activity, resource, g HAVING count(*) >= 2",
)(lambda log: statistics.batches(log, 3600))

# Declarative models
OCC = ", o AS (SELECT case_id, activity, list(p ORDER BY p) AS pl FROM s GROUP BY ALL), t AS (SELECT count(*) AS total FROM c), k AS (SELECT activity, count(*) AS n FROM o GROUP BY ALL)"
query(
    "declare_unary",
    OCC
    + """, h AS (SELECT activity AS a, count(*) AS have, count(*) FILTER (len(pl) = 1) AS once, count(*) FILTER (pl[1] = 0) AS first FROM o GROUP BY ALL)
SELECT 'existence' AS template, a, total AS support, have / total::DOUBLE AS confidence FROM h, t UNION ALL SELECT 'absence', a, total, (total - have) / total::DOUBLE FROM h, t
UNION ALL SELECT 'exactly_one', a, have, once / have::DOUBLE FROM h UNION ALL SELECT 'init', a, total, first / total::DOUBLE FROM h, t""",
)(declarative.declare_unary)
query(
    "declare_binary",
    OCC
    + """, y AS (SELECT x.activity AS a, z.activity AS b, x.pl AS pa, z.pl AS pb FROM o x JOIN o z ON x.case_id = z.case_id AND x.activity <> z.activity),
q AS (SELECT a, b, count(*) AS both_, count(*) FILTER (pa[-1] < pb[-1]) AS r, count(*) FILTER (pa[1] < pb[1]) AS pr, count(*) FILTER (pa[-1] < pb[-1] AND pa[1] < pb[1]) AS su,
 count(*) FILTER (len(pa) = len(pb) AND len(list_filter(range(1, len(pa) + 1), lambda i: pa[i] < pb[i] AND (i = len(pa) OR pb[i] < pa[i + 1]))) = len(pa)) AS al,
 count(*) FILTER (len(pa) = len(pb) AND len(list_filter(range(1, len(pa) + 1), lambda i: pb[i] = pa[i] + 1)) = len(pa)) AS ch FROM y GROUP BY ALL),
z AS (SELECT ka.activity AS a, kb.activity AS b, ka.n AS ka, kb.n AS kb FROM k ka JOIN k kb ON ka.activity <> kb.activity),
m AS (SELECT a, b, ka, kb, coalesce(both_, 0) AS both_, coalesce(r, 0) AS r, coalesce(pr, 0) AS pr, coalesce(su, 0) AS su, coalesce(al, 0) AS al, coalesce(ch, 0) AS ch, ka + kb - coalesce(both_, 0) AS ei FROM z LEFT JOIN q USING (a, b))
SELECT u.template, a, b, u.support, u.hits / u.support::DOUBLE AS confidence FROM (SELECT a, b, unnest([
 {'template': 'responded_existence', 'support': ka, 'hits': both_}, {'template': 'response', 'support': ka, 'hits': r}, {'template': 'alternate_response', 'support': ka, 'hits': al}, {'template': 'chain_response', 'support': ka, 'hits': ch},
 {'template': 'precedence', 'support': kb, 'hits': pr}, {'template': 'alternate_precedence', 'support': kb, 'hits': al}, {'template': 'chain_precedence', 'support': kb, 'hits': ch},
 {'template': 'succession', 'support': ei, 'hits': su}, {'template': 'alternate_succession', 'support': ei, 'hits': al}, {'template': 'chain_succession', 'support': ei, 'hits': ch}, {'template': 'coexistence', 'support': ei, 'hits': both_},
 {'template': 'non_coexistence', 'support': ei, 'hits': ei - both_}, {'template': 'non_succession', 'support': ei, 'hits': ei - su}, {'template': 'non_chain_succession', 'support': ei, 'hits': ei - ch}]) AS u FROM m)""",
)(declarative.declare_binary)
query("activity_frequencies", OCC + ", f AS (SELECT activity, len(pl) AS times, count(*) AS n_cases FROM o GROUP BY ALL UNION ALL SELECT activity, 0, total - n FROM k, t WHERE n < total) SELECT * FROM f")(declarative.activity_frequencies)

# Organisation
query("handover", ", h AS (SELECT resource AS source, rb AS target, count(*) AS n FROM s WHERE resource IS NOT NULL AND rb IS NOT NULL GROUP BY ALL) SELECT source, target, n, n / (sum(n) OVER ())::DOUBLE AS share FROM h")(organisation.handover)
OWN = ", w AS (SELECT DISTINCT case_id, resource FROM e WHERE resource IS NOT NULL)"
query("working_together", OWN + " SELECT x.resource AS a, y.resource AS b, count(*) AS n_cases, count(*) / (SELECT count(*) FROM e)::DOUBLE AS share FROM w x JOIN w y ON x.case_id = y.case_id AND x.resource < y.resource GROUP BY ALL")(organisation.working_together)
query(
    "subcontracting",
    ", r AS (SELECT resource AS a, rb AS b, lead(resource, 2) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS back FROM s) SELECT a, b, count(*) AS n, count(*) / (SELECT count(*) FROM c)::DOUBLE AS share FROM r WHERE a = back AND a <> b GROUP BY ALL",
)(organisation.subcontracting)
query("resource_profile", "SELECT resource, count(*) AS n_events, count(DISTINCT activity) AS n_activities, count(DISTINCT case_id) AS n_cases, count(DISTINCT case_id) / (SELECT count(*) FROM c)::DOUBLE AS share_of_cases FROM e WHERE resource IS NOT NULL GROUP BY ALL")(organisation.resource_profile)
query("activity_share", "SELECT resource, activity, n, n / sum(n) OVER (PARTITION BY resource)::DOUBLE AS share FROM (SELECT resource, activity, count(*) AS n FROM e WHERE resource IS NOT NULL GROUP BY resource, activity)")(organisation.activity_share)
query("social_position", OWN + ", m AS (SELECT x.resource, count(DISTINCT y.resource) AS k FROM w x LEFT JOIN w y ON x.case_id = y.case_id AND x.resource <> y.resource GROUP BY ALL) SELECT resource, k / (SELECT count(DISTINCT resource) FROM w)::DOUBLE AS share FROM m")(organisation.social_position)
query(
    "joint_activities",
    ", n AS (SELECT a.activity, r.resource, count(e.event_idx)::DOUBLE AS n FROM (SELECT DISTINCT activity FROM e) a CROSS JOIN (SELECT DISTINCT resource FROM e WHERE resource IS NOT NULL) r LEFT JOIN e ON e.activity = a.activity AND e.resource = r.resource GROUP BY ALL) SELECT x.resource AS a, y.resource AS b, round(corr(x.n, y.n), 9) AS similarity FROM n x JOIN n y ON x.activity = y.activity AND x.resource < y.resource GROUP BY ALL",
)(lambda log: organisation.joint_activities(log).withColumn("similarity", F.round("similarity", 9)))

# Features
query("case_features", "SELECT case_id, count(*) AS n_events, (max(us) - min(us)) / 1e6 AS duration_s, " + ", ".join(f"count(*) FILTER (activity = '{a}') AS act_{a}" for a in ACTIVITIES) + ", count(*) FILTER (activity = 'view' AND b = 'click') AS edge_0 FROM s GROUP BY ALL")(
    lambda log: features.case_features(log, ACTIVITIES, [("view", "click")])
)
query("remaining_time", "SELECT case_id, event_idx, p AS position, (us - first_us) / 1e6 AS elapsed_s, (last_us - us) / 1e6 AS remaining_s, b AS next_activity FROM s JOIN c USING (case_id)")(features.remaining_time)
query("time_pivot", "SELECT case_id, " + ", ".join(f"count(*) FILTER (month(ts) = {k}) AS m{k}" for k in range(1, 13)) + " FROM e GROUP BY ALL")(features.time_pivot)
query(
    "process_cube",
    ", d AS (SELECT n_events AS n, (last_us - first_us) / 1e6 AS d FROM c), g AS (SELECT min(n) AS a0, max(n) AS a1, min(d) AS b0, max(d) AS b1 FROM d) SELECT least(floor((n - a0) / (a1 - a0)::DOUBLE * 4), 3)::BIGINT AS size_bin, least(floor((d - b0) / (b1 - b0) * 4), 3)::BIGINT AS duration_bin, count(*) AS n_cases, round(avg(d), 3) AS mean_duration_s FROM d, g GROUP BY ALL",
)(lambda log: features.cube(log).withColumn("mean_duration_s", F.round("mean_duration_s", 3)))

# Object-centric logs
object_query("oc_flatten", "SELECT oid AS case_id, activity, us, eid AS event_idx FROM j WHERE type = 'customer'", lambda log: objects.flatten(log, "customer"))
object_query("oc_type_activities", "SELECT type, activity, count(DISTINCT eid) AS n_events, count(DISTINCT oid) AS n_objects, count(*) AS n_relations FROM j GROUP BY ALL", objects.type_activities)
object_query(
    "oc_dfg",
    ", l AS (SELECT type, oid, eid, us, activity AS a, lead(activity) OVER w AS b, lead(eid) OVER w AS e2, lead(us) OVER w AS u2 FROM j WINDOW w AS (PARTITION BY oid ORDER BY us, eid)) SELECT type, a, b, count(DISTINCT (eid, e2)) AS n_couples, count(DISTINCT oid) AS n_objects, count(*) AS n_total, round(avg((u2 - us) / 1e6), 3) AS mean_s FROM l WHERE b IS NOT NULL GROUP BY ALL",
    lambda log: objects.object_dfg(log).withColumn("mean_s", F.round("mean_s", 3)),
)
object_query("oc_objects_summary", "SELECT oid, type, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us, count(DISTINCT activity) AS n_activities FROM j GROUP BY ALL", objects.objects_summary)
object_query("oc_temporal_summary", "SELECT us, count(DISTINCT eid) AS n_events, count(DISTINCT oid) AS n_objects FROM j GROUP BY ALL", objects.temporal_summary)
PER = "SELECT activity, type, min(k) AS least, median(k) AS median, max(k) AS most FROM (SELECT {0}, activity, type, count(*) AS k FROM j GROUP BY ALL) GROUP BY ALL"
object_query("oc_objects_per_event", PER.format("eid"), objects.objects_per_event)
object_query("oc_events_per_object", PER.format("oid"), objects.events_per_object)
object_query("oc_divergence", f"SELECT activity, type, 'convergence' AS diagnosis FROM ({PER.format('eid')}) WHERE median > 1 UNION ALL SELECT activity, type, 'divergence' FROM ({PER.format('oid')}) WHERE median > 1", objects.divergence)
object_query("oc_interactions", "SELECT x.oid AS o1, y.oid AS o2, count(*) AS n_events FROM rel x JOIN rel y ON x.eid = y.eid AND x.oid < y.oid GROUP BY ALL", objects.interactions)
object_query("oc_cobirth", "SELECT x.oid AS o1, y.oid AS o2 FROM ends x JOIN ends y ON x.first_eid = y.first_eid AND x.oid < y.oid", objects.cobirth)
object_query("oc_codeath", "SELECT x.oid AS o1, y.oid AS o2 FROM ends x JOIN ends y ON x.last_eid = y.last_eid AND x.oid < y.oid", lambda log: objects.cobirth(log, death=True))
object_query("oc_inheritance", ", i AS (SELECT DISTINCT x.oid AS o1, y.oid AS o2 FROM ends x JOIN ends y ON x.last_eid = y.first_eid AND x.oid <> y.oid) SELECT * FROM i WHERE (o2, o1) NOT IN (SELECT (o1, o2) FROM i)", objects.inheritance)
object_query("oc_descendants", "SELECT DISTINCT rel.oid AS o1, y.oid AS o2 FROM ends y JOIN rel ON rel.eid = y.first_eid JOIN ends x ON x.oid = rel.oid WHERE x.first_eid <> rel.eid", objects.descendants)
object_query("oc_lifecycle", "SELECT eid, oid, CASE WHEN eid = first_eid THEN 'created' WHEN eid = last_eid THEN 'terminated' ELSE 'other' END AS qualifier FROM rel JOIN ends USING (oid)", objects.lifecycle)

# Discovery
STATE = "coalesce(array_to_string({}, ','), '')"
query(
    "transition_system",
    f"SELECT {STATE.format('x')} AS source, activity, {STATE.format('y')} AS target, count(*) AS n FROM (SELECT activity, list(activity) OVER (PARTITION BY case_id ORDER BY us, event_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS x, list(activity) OVER (PARTITION BY case_id ORDER BY us, event_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS y FROM e) GROUP BY ALL",
)(discovery.transition_system)
query("prefix_tree", "SELECT array_to_string(variant[1:d], ',') AS prefix, d::INT AS depth, count(*) AS n_cases, count(*) FILTER (d = len(variant)) AS n_final FROM (SELECT variant, unnest(range(1, len(variant) + 1)) AS d FROM v) GROUP BY ALL")(discovery.prefix_tree)
NAMES = "SELECT x.activity AS a, y.activity AS b FROM (SELECT DISTINCT activity FROM e) x CROSS JOIN (SELECT DISTINCT activity FROM e) y"
query(
    "alpha_relations",
    f", {FOOT} SELECT p.a, p.b, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN 'parallel' WHEN x.n IS NOT NULL THEN 'causal' WHEN y.n IS NOT NULL THEN 'inverse' ELSE 'none' END AS relation FROM ({NAMES}) p LEFT JOIN d x ON x.a = p.a AND x.b = p.b LEFT JOIN d y ON y.a = p.b AND y.b = p.a",
)(discovery.alpha_relations)
query(
    "heuristics_dependencies",
    f", {FOOT} SELECT * FROM (SELECT x.a, x.b, x.n, CASE WHEN x.a = x.b THEN x.n / (x.n + 1)::DOUBLE ELSE (x.n - coalesce(y.n, 0)) / (x.n + coalesce(y.n, 0) + 1)::DOUBLE END AS dependency FROM d x LEFT JOIN d y ON x.a = y.b AND x.b = y.a) WHERE dependency >= 0.05",
)(lambda log: discovery.heuristics_dependencies(log, 0.05))
query("loops_of_two", "SELECT a, b, n, n / (n + 1)::DOUBLE AS dependency FROM (SELECT least(activity, b) AS a, greatest(activity, b) AS b, count(*) AS n FROM (SELECT activity, b, lead(activity, 2) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS c FROM s) WHERE activity = c AND activity <> b GROUP BY ALL) WHERE n / (n + 1)::DOUBLE >= 0.5")(discovery.loops_of_two)
query(
    "dfg_conformance",
    "SELECT *, 1 - n_deviations / n_moves::DOUBLE AS fitness FROM (SELECT case_id, count(*) + 1 AS n_moves, count(*) FILTER (activity = b) + count(*) FILTER (p = 0 AND activity = 'error') AS n_deviations FROM s GROUP BY ALL)",
)(lambda log: discovery.dfg_conformance(log, relations.dfg(log).where("a <> b"), relations.endpoints(log).where("activity <> 'error'"), relations.endpoints(log, "last_activity")))
query(
    "dfg_precision",
    ", st AS (SELECT prefix, activity, count(*) AS n, count(DISTINCT b) AS taken FROM (SELECT array_to_string(list(activity) OVER (PARTITION BY case_id ORDER BY us, event_idx), ',') AS prefix, activity, b FROM s) GROUP BY ALL), al AS (SELECT activity AS a, count(DISTINCT b) AS allowed FROM s WHERE b IS NOT NULL GROUP BY ALL) SELECT 1 - sum(n * (allowed - least(taken, allowed)))::DOUBLE / sum(n * allowed)::DOUBLE AS precision FROM st JOIN al ON a = activity",
)(lambda log: discovery.dfg_precision(log, relations.dfg(log)))
