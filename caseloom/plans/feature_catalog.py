"""Registered queries of conformance by case, graph filters, further features and filters, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import case_tables as tables
from ..operators import conformance, declarative, dfgs, features, filters, relations, statistics
from .catalog import OCC, SQL, E, kept, query

MODEL = (
    ("response", "view", "click"), ("precedence", "signup", "purchase"), ("non_coexistence", "error", "purchase"), ("chain_succession", "view", "click"), ("coexistence", "view", "signup"),
    ("alternate_response", "click", "view"), ("alternate_precedence", "view", "error"), ("chain_response", "signup", "view"), ("responded_existence", "error", "view"), ("succession", "signup", "purchase"),
    ("non_succession", "purchase", "signup"), ("non_chain_succession", "error", "error2"), ("existence", "view", None), ("absence", "error", None), ("exactly_one", "signup", None), ("init", "signup", None),
)
SKELETON = (("equivalence", "view", "click"), ("always_after", "signup", "view"), ("always_before", "purchase", "signup"), ("never_together", "error", "purchase"), ("directly_follows", "error", "view"))


def _values(rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows) + ")"


def _model(log, rows=MODEL, names="template string, a string, b string"):
    return log.sparkSession.createDataFrame(list(rows), names)


# Conformance by case; the SQL tests every case with every constraint
PAIRED = OCC + f", model AS (SELECT * FROM {_values(MODEL)} t(template, a, b)), y AS (SELECT c.case_id, first_activity, template, a, b, x.pl AS pa, z.pl AS pb FROM c CROSS JOIN model LEFT JOIN o x ON x.case_id = c.case_id AND x.activity = a LEFT JOIN o z ON z.case_id = c.case_id AND z.activity = b)"
ALTERNATE = "(len(pa) = len(pb) AND len(list_filter(range(1, len(pa) + 1), lambda i: pa[i] < pb[i] AND (i = len(pa) OR pb[i] < pa[i + 1]))) = len(pa))"
CHAIN = "(len(pa) = len(pb) AND len(list_filter(range(1, len(pa) + 1), lambda i: pb[i] = pa[i] + 1)) = len(pa))"
RESPONSE, PRECEDENCE = "(pa[-1] < pb[-1])", "(pa[1] < pb[1])"
BROKEN = f"""CASE template
 WHEN 'response' THEN pa IS NOT NULL AND NOT coalesce({RESPONSE}, false) WHEN 'responded_existence' THEN pa IS NOT NULL AND pb IS NULL
 WHEN 'alternate_response' THEN pa IS NOT NULL AND NOT coalesce({ALTERNATE}, false) WHEN 'chain_response' THEN pa IS NOT NULL AND NOT coalesce({CHAIN}, false)
 WHEN 'precedence' THEN pb IS NOT NULL AND NOT coalesce({PRECEDENCE}, false) WHEN 'alternate_precedence' THEN pb IS NOT NULL AND NOT coalesce({ALTERNATE}, false)
 WHEN 'coexistence' THEN (pa IS NULL) <> (pb IS NULL) WHEN 'non_coexistence' THEN pa IS NOT NULL AND pb IS NOT NULL
 WHEN 'succession' THEN (pa IS NOT NULL OR pb IS NOT NULL) AND NOT coalesce({RESPONSE} AND {PRECEDENCE}, false) WHEN 'non_succession' THEN coalesce({RESPONSE} AND {PRECEDENCE}, false)
 WHEN 'chain_succession' THEN (pa IS NOT NULL OR pb IS NOT NULL) AND NOT coalesce({CHAIN}, false) WHEN 'non_chain_succession' THEN coalesce({CHAIN}, false)
 WHEN 'existence' THEN pa IS NULL WHEN 'absence' THEN pa IS NOT NULL WHEN 'exactly_one' THEN coalesce(len(pa) <> 1, false) WHEN 'init' THEN first_activity <> a END"""
query("declare_deviations", PAIRED + f" SELECT case_id, template, a, b FROM y WHERE {BROKEN}")(lambda log: conformance.declare_deviations(log, _model(log)))
FIT = " SELECT case_id, n AS n_constraints, d AS n_deviations, CASE WHEN n > 0 THEN 1 - d / n::DOUBLE ELSE 1 END AS fitness, d = 0 AS is_fit FROM "
query("declare_conformance", PAIRED + FIT + f"(SELECT case_id, count(*) AS n, count(*) FILTER ({BROKEN}) AS d FROM y GROUP BY case_id)")(lambda log: conformance.declare_conformance(log, _model(log)))
SKEL = """CASE template WHEN 'equivalence' THEN NOT coalesce(len(pa) = len(pb), false) WHEN 'always_after' THEN NOT coalesce(pa[1] < pb[-1], false) WHEN 'always_before' THEN NOT coalesce(pb[1] < pa[-1], false)
 WHEN 'never_together' THEN pb IS NOT NULL ELSE pb IS NULL OR len(list_filter(pa, lambda i: list_contains(pb, i + 1))) = 0 END"""
query("skeleton_conformance", PAIRED.replace(_values(MODEL), _values(SKELETON)) + FIT + f"(SELECT case_id, count(pa) AS n, count(*) FILTER (pa IS NOT NULL AND {SKEL}) AS d FROM y GROUP BY case_id)")(
    lambda log: conformance.skeleton_conformance(log, _model(log, SKELETON, "relation string, a string, b string"))
)
FREQUENCIES = (("view", 1), ("view", 2), ("view", 3), ("click", 0), ("click", 1), ("click", 2), ("signup", 1), ("error", 0), ("error", 1))
FREQ = f", fm AS (SELECT activity, times::BIGINT AS times FROM {_values(FREQUENCIES)} f(activity, times)), need AS (SELECT activity FROM fm GROUP BY activity HAVING min(times) > 0)"
query(
    "skeleton_conformance_frequencies",
    PAIRED.replace(_values(MODEL), _values(SKELETON)) + FREQ + f""", r AS (SELECT case_id, {SKEL} AS broken FROM y WHERE pa IS NOT NULL
 UNION ALL SELECT case_id, (activity, len(pl)) NOT IN (SELECT (activity, times) FROM fm) FROM o UNION ALL SELECT case_id, true FROM c CROSS JOIN need WHERE (case_id, activity) NOT IN (SELECT (case_id, activity) FROM o))"""
    + FIT + "(SELECT case_id, count(*) AS n, count(*) FILTER (broken) AS d FROM r GROUP BY case_id)",
)(lambda log: conformance.skeleton_conformance(log, _model(log, SKELETON, "relation string, a string, b string"), _model(log, FREQUENCIES, "activity string, times long")))
SKELETON_SQL = """, w AS (SELECT x.activity AS a, z.activity AS b, count(*) AS tog, coalesce(sum(len(x.pl)) FILTER (len(x.pl) = len(z.pl)), 0) AS eq, count(*) FILTER (x.pl[1] < z.pl[-1]) AS af, count(*) FILTER (z.pl[1] < x.pl[-1]) AS be FROM o x JOIN o z ON x.case_id = z.case_id GROUP BY ALL),
f AS (SELECT activity AS a, b, count(*) AS df FROM s WHERE b IS NOT NULL GROUP BY ALL), ne AS (SELECT activity, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT ka.activity AS a, kb.activity AS b, ka.n * {share}::DOUBLE AS least, ka.n - coalesce(tog, 0) AS apart, coalesce(eq, 0) AS eq, coalesce(af, 0) AS af, coalesce(be, 0) AS be, coalesce(df, 0) AS df FROM ne ka CROSS JOIN ne kb LEFT JOIN w ON w.a = ka.activity AND w.b = kb.activity LEFT JOIN f ON f.a = ka.activity AND f.b = kb.activity)
SELECT 'equivalence' AS relation, a, b FROM m WHERE a <> b AND eq > 0 AND eq >= least UNION ALL SELECT 'always_after', a, b FROM m WHERE af > 0 AND af >= least UNION ALL SELECT 'always_before', a, b FROM m WHERE be > 0 AND be >= least
UNION ALL SELECT 'never_together', a, b FROM m WHERE a <> b AND apart > 0 AND apart >= least UNION ALL SELECT 'directly_follows', a, b FROM m WHERE df > 0 AND df >= least"""
query("log_skeleton", OCC + SKELETON_SQL.format(share=0.5))(lambda log: declarative.skeleton(log, 0.5))
query("log_skeleton_noisy", OCC + SKELETON_SQL.format(share=0.125))(lambda log: declarative.skeleton(log, 0.875))
PAIRS = "SELECT x.case_id, x.activity AS a, y.activity AS b, (y.us - x.us) / 1e6 AS gap FROM e x JOIN e y ON x.case_id = y.case_id AND (x.us, x.event_idx) < (y.us, y.event_idx)"
PROFILE = f", pr AS ({PAIRS}), prof AS (SELECT a, b, avg(gap) AS m, coalesce(stddev_samp(gap), 0) AS s FROM pr GROUP BY ALL)"
query("temporal_conformance", PROFILE + ", dev AS (SELECT case_id, count(*) AS n FROM pr JOIN prof USING (a, b) WHERE abs(gap - m) > 1.5::DOUBLE * s GROUP BY case_id) SELECT case_id, coalesce(n, 0) AS n_deviations, n IS NULL AS is_fit FROM c LEFT JOIN dev USING (case_id)")(
    lambda log: conformance.temporal_conformance(log, relations.temporal_profile(log), 1.5).select("case_id", "n_deviations", "is_fit")
)
query("point_profile", f"SELECT a, b, count(*) AS n, round(avg(gap), 2) AS mean_s, round(coalesce(stddev_samp(gap), 0), 0) AS stdev_s FROM ({PAIRS}) GROUP BY ALL")(
    lambda log: relations.point_profile(log).select("a", "b", "n", F.round("mean_s", 2).alias("mean_s"), F.round("stdev_s", 0).alias("stdev_s"))
)


def _frequent(edges):
    """Edges that are at least as frequent as their mean."""
    return edges.join(edges.agg(F.avg("n").alias("mean")), F.col("n") >= F.col("mean")).drop("mean")  # one row


query(
    "footprint_quality",
    ", f AS (SELECT activity AS a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL), g AS (SELECT a, b FROM f WHERE n >= (SELECT avg(n) FROM f)) SELECT sum(n) FILTER ((a, b) IN (SELECT (a, b) FROM g)) / sum(n)::DOUBLE AS fitness, count(*) FILTER ((a, b) IN (SELECT (a, b) FROM g)) / (SELECT count(*) FROM g)::DOUBLE AS precision FROM f",
)(lambda log: conformance.footprint_quality(log, _frequent(relations.dfg(log))))

# Filters on the graph of the steps between different activities that are at least as frequent as their mean
G = ", every AS (SELECT activity AS a, b, count(*) AS n FROM s WHERE b IS NOT NULL AND activity <> b GROUP BY ALL), g AS (SELECT * FROM every WHERE n >= (SELECT avg(n) FROM every))"
most = ", m AS (SELECT act, max(n) AS mx FROM (SELECT a AS act, n FROM g UNION ALL SELECT b, n FROM g) GROUP BY act)"


def _graph(log):
    return _frequent(relations.dfg(log).where("a <> b"))


def _ends(log, which):
    return relations.endpoints(log, which)


query("dfg_without_noise", G + most + " SELECT a, b, n FROM g JOIN m x ON x.act = a JOIN m y ON y.act = b WHERE n >= least(x.mx, y.mx) * 0.8::DOUBLE")(lambda log: dfgs.without_noise(_graph(log), 0.8))
REACH = """{name}(v) AS (SELECT {start} UNION SELECT {to} FROM {name} JOIN {g} ON {at} = v)"""


def _reach(name: str, start: str, g: str, forward: bool = True) -> str:
    return REACH.format(name=name, start=start, g=g, to="b" if forward else "a", at="a" if forward else "b")


RECURSIVE = E.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
STARTS, ENDS = "first_activity FROM c", "last_activity FROM c"
query("dfg_to_activity", "x")(lambda log: dfgs.to_activity(_graph(log), _ends(log, "first_activity"), "purchase"))
SQL["dfg_to_activity"] = RECURSIVE + G + ", h AS (SELECT * FROM g WHERE a <> 'purchase'), " + _reach("r", STARTS, "h") + ", " + _reach("q", "'purchase'", "h", False) + " SELECT a, b, n FROM h WHERE a IN (SELECT v FROM r INTERSECT SELECT v FROM q) AND b IN (SELECT v FROM r INTERSECT SELECT v FROM q)"
query("dfg_from_activity", "x")(lambda log: dfgs.from_activity(_graph(log), _ends(log, "last_activity"), "signup"))
SQL["dfg_from_activity"] = RECURSIVE + G + ", h AS (SELECT * FROM g WHERE b <> 'signup'), " + _reach("r", "'signup'", "h") + ", " + _reach("q", ENDS, "h", False) + " SELECT a, b, n FROM h WHERE a IN (SELECT v FROM r INTERSECT SELECT v FROM q) AND b IN (SELECT v FROM r INTERSECT SELECT v FROM q)"
query("dfg_containing", "x")(lambda log: dfgs.containing(_graph(log), _ends(log, "first_activity"), _ends(log, "last_activity"), "click"))
SQL["dfg_containing"] = (
    RECURSIVE + G + ", " + ", ".join([_reach("r", STARTS, "g"), _reach("q", "'click'", "g", False), _reach("t", "'click'", "g"), _reach("u", ENDS, "g", False)])
    + " SELECT a, b, n FROM g WHERE (a IN (SELECT v FROM r INTERSECT SELECT v FROM q) AND b IN (SELECT v FROM r INTERSECT SELECT v FROM q)) OR (a IN (SELECT v FROM t INTERSECT SELECT v FROM u) AND b IN (SELECT v FROM t INTERSECT SELECT v FROM u))"
)

# Features
LONG = 86_400_000_000 * 2
long = lambda log: log.withColumn("start_us", F.col("us") - LONG)
for by, name in ((False, "most_concurrent"), (True, "most_concurrent_by_activity")):
    same, key = (" AND x.activity = y.activity", ", activity") if by else ("", "")
    query(name, f", z AS (SELECT x.case_id{', x.activity' if by else ''}, x.event_idx, count(y.event_idx) AS k FROM e x LEFT JOIN e y ON x.case_id = y.case_id{same} AND (y.us, y.event_idx) > (x.us, x.event_idx) AND y.us - {LONG} <= x.us GROUP BY ALL) SELECT case_id{key}, max(k) AS n FROM z GROUP BY ALL")(
        lambda log, by=by: tables.most_concurrent(long(log), by)
    )
query("resource_workload", ", r AS (SELECT DISTINCT case_id, resource, first_us, last_us FROM e JOIN c USING (case_id) WHERE resource IS NOT NULL) SELECT x.case_id, x.resource, count(*) AS n FROM r x JOIN r y ON x.resource = y.resource AND x.first_us <= y.last_us AND y.first_us <= x.last_us GROUP BY ALL")(tables.resource_workload)
query("occurrence_times", "SELECT case_id, activity, min(p) AS first_index, max(p) AS last_index, (any_value(last_us) - min(us)) / 1e6 AS since_first_s, (any_value(last_us) - max(us)) / 1e6 AS since_last_s FROM s JOIN c USING (case_id) GROUP BY ALL")(tables.occurrence_times)
query("last_path_times", "SELECT case_id, activity AS a, b, arg_max((us2 - us) / 1e6, p) AS seconds FROM s WHERE b IS NOT NULL GROUP BY ALL")(tables.last_path_times)
query("event_table", "SELECT case_id, event_idx, p AS place, (us - first_us) / 1e6 AS since_start_s, coalesce((us - lag(us) OVER (PARTITION BY case_id ORDER BY us, event_idx)) / 1e6, 0) AS since_last_s, (last_us - us) / 1e6 AS to_end_s FROM s JOIN c USING (case_id)")(tables.event_table)
query("temporal_features", """, d AS (SELECT date_trunc('week', ts) AS bucket, count(*) AS n_events, count(DISTINCT case_id) AS n_cases, count(DISTINCT resource) AS n_resources, count(DISTINCT activity) AS n_activities FROM e GROUP BY ALL),
a AS (SELECT date_trunc('week', make_timestamp(first_us)) AS bucket, count(*) AS k FROM c GROUP BY ALL), z AS (SELECT date_trunc('week', make_timestamp(last_us)) AS bucket, count(*) AS k FROM c GROUP BY ALL)
SELECT epoch_us(d.bucket::TIMESTAMP) AS bucket, n_events, n_cases, n_resources, n_activities, coalesce(a.k, 0) AS n_started, coalesce(z.k, 0) AS n_ended FROM d LEFT JOIN a ON a.bucket = d.bucket LEFT JOIN z ON z.bucket = d.bucket""")(  # fmt: skip
    lambda log: tables.temporal_features(log).withColumn("bucket", F.unix_micros("bucket"))
)
query("with_ends", "SELECT case_id, activity, us, event_idx FROM e UNION ALL SELECT case_id, '▶', first_us - 1, -1 FROM c UNION ALL SELECT case_id, '■', last_us + 1, -2 FROM c")(tables.with_ends)
query("lifecycle_rows", "SELECT case_id, activity, event_idx, us - 1000000 AS us, 'start' AS transition FROM e UNION ALL SELECT case_id, activity, event_idx, us, 'complete' FROM e")(lambda log: tables.to_lifecycle(log.withColumn("start_us", F.col("us") - 1_000_000)))
query("lifecycle_intervals", "SELECT case_id, activity, us - 1000000 AS start_us, us FROM e")(lambda log: tables.to_intervals(tables.to_lifecycle(log.withColumn("start_us", F.col("us") - 1_000_000))))
query("open_paths", "SELECT case_id, activity AS a, b, us AS from_us, us2 AS to_us FROM s WHERE us2 > us")(tables.open_paths)
query("performance_spectrum", ", q AS (SELECT case_id, activity, us, lead(activity) OVER w AS b, lead(activity, 2) OVER w AS c, lead(us) OVER w AS ub, lead(us, 2) OVER w AS uc FROM e WHERE activity IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY case_id ORDER BY us, event_idx)) SELECT case_id, us AS t0, ub AS t1, uc AS t2 FROM q WHERE activity = 'view' AND b = 'click' AND c = 'purchase'")(
    lambda log: tables.performance_spectrum(log, ["view", "click", "purchase"]).selectExpr("case_id", "times[0] AS t0", "times[1] AS t1", "times[2] AS t2")
)
query("case_rates", "SELECT case_id, 0.0::DOUBLE AS service_s, row_number() OVER (PARTITION BY first_us // 86400000000 ORDER BY first_us, case_id) AS arrival_rank FROM c")(tables.case_rates)
query("resource_durations", ", q AS (SELECT resource, activity, (us - lag(us) OVER (PARTITION BY case_id ORDER BY us, event_idx)) / 1e6 AS s FROM e) SELECT resource, activity, count(*) AS n, round(avg(s), 3) AS mean_s FROM q WHERE resource IS NOT NULL AND s IS NOT NULL GROUP BY ALL")(lambda log: tables.resource_durations(log).withColumn("mean_s", F.round("mean_s", 3)))
query("resource_case_durations", "SELECT resource, count(*) AS n_cases, round(avg((last_us - first_us) / 1e6), 3) AS mean_s FROM (SELECT DISTINCT case_id, resource FROM e WHERE resource IS NOT NULL) JOIN c USING (case_id) GROUP BY ALL")(lambda log: tables.resource_case_durations(log).withColumn("mean_s", F.round("mean_s", 3)))
query("roles", ", r AS (SELECT activity, array_to_string(list_sort(list(DISTINCT resource)), ',') AS resources, count(*) AS n FROM e WHERE resource IS NOT NULL GROUP BY activity) SELECT resources, string_agg(activity, ',' ORDER BY activity) AS activities, sum(n)::BIGINT AS n_events FROM r GROUP BY resources")(lambda log: tables.roles(log))
query("activity_threshold", ", k AS (SELECT activity, count(*) AS n FROM e GROUP BY ALL), l AS (SELECT n, lag(n) OVER (ORDER BY n DESC) AS before FROM k), x AS (SELECT max(n) FILTER (n <= before * 0.9::DOUBLE) AS cut FROM l) SELECT min(n) AS threshold FROM l, x WHERE cut IS NULL OR n > cut")(
    lambda log: tables.threshold(log.groupBy("activity").agg(F.count("*").alias("n")), 0.9)
)

# Samples and parts, by a checksum that SQL can tell only for the shape: tested by shares
for name, f in (("sample_cases", lambda log: tables.sample_cases(log, 0.5)), ("sample_events", lambda log: tables.sample_events(log, 0.5)), ("partitions", lambda log: tables.partitions(log, 4))):
    query(name)(lambda log, f=f: f(log).select("case_id", "event_idx", *([] if "part" not in f(log).columns else ["part"])))

# Filters that had no query
kept("filter_attribute_in_time", "SELECT case_id, event_idx, activity FROM e WHERE case_id IN (SELECT case_id FROM e WHERE activity = 'error' AND us % 7 = 0 AND us < 1900000000000000)", lambda log: tables.traces_with_attribute_in_time(log.withColumn("kind", F.when(F.col("us") % 7 == 0, F.col("activity"))), "kind", "error", 0, 1_899_999_999_999_999))
kept("filter_variant_coverage", ", n AS (SELECT variant, count(*) AS n FROM v GROUP BY variant) SELECT case_id, event_idx, activity FROM e WHERE case_id IN (SELECT case_id FROM v JOIN n USING (variant) WHERE n <= 0.01::DOUBLE * (SELECT count(*) FROM v))", lambda log: filters.variant_coverage(log, 0.0, 0.01))
kept(
    "filter_directly_chained",
    ", q AS (SELECT case_id, max(p) FILTER (activity = 'view') AS pb, max(p) FILTER (activity = 'click') AS pc FROM s GROUP BY case_id) SELECT case_id, event_idx, activity FROM e WHERE case_id IN (SELECT q.case_id FROM q JOIN s ON s.case_id = q.case_id AND s.p = q.pb - 1 WHERE q.pc = q.pb + 1 AND s.activity = 'click')",
    lambda log: filters.directly_chained(log, "click", "view", "click"),
)
kept("filter_trace_pattern", ", t AS (SELECT case_id, chr(31) || array_to_string(variant, chr(31)) || chr(31) AS t FROM v) SELECT case_id, event_idx, activity FROM e WHERE case_id IN (SELECT case_id FROM t WHERE contains(t, chr(31) || 'error' || chr(31) || 'error' || chr(31) || 'view' || chr(31)))", lambda log: filters.trace_pattern(log, ["error", "error", "view"]))
query("collapse_times", "SELECT case_id, us, array_to_string(list_sort(list(activity)), ' & ') AS activity FROM e GROUP BY ALL")(filters.collapse_times)
query("sojourn", "SELECT activity, count(*) AS n, 3600.0::DOUBLE AS mean_s, 3600.0::DOUBLE AS min_s, 3600.0::DOUBLE AS max_s, count(*) * 3600.0::DOUBLE AS sum_s FROM e GROUP BY ALL")(lambda log: statistics.sojourn(log.withColumn("start_us", F.col("us") - 3_600_000_000)))
query("variant_paths", "SELECT array_to_string(variant, ',') AS variant, p AS position, activity AS a, b, count(*) AS n, round(avg((us2 - us) / 1e6), 3) AS mean_s FROM s JOIN v USING (case_id) WHERE b IS NOT NULL GROUP BY ALL")(
    lambda log: statistics.variant_paths(log).select(F.array_join("variant", ",").alias("variant"), "position", "a", "b", "n", F.round("mean_s", 3).alias("mean_s"))
)
query("concurrent_pairs", "SELECT least(x.activity, y.activity) AS a, greatest(x.activity, y.activity) AS b, count(*) AS n FROM e x JOIN e y ON x.case_id = y.case_id AND (x.us, x.event_idx) < (y.us, y.event_idx) AND y.us - 3600000000 <= x.us GROUP BY ALL")(lambda log: relations.concurrent_pairs(log.withColumn("start_us", F.col("us") - 3_600_000_000)))
kept("prefixes_of_length", "SELECT case_id, event_idx, activity FROM s WHERE p < 3", lambda log: features.prefixes_of(log, 3))


