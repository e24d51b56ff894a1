"""Registered queries of matching without case ids, drift, gapped segments and roles, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, matching, organisation, segments
from .catalog import query

# Variants of the log against those of the log without errors; DuckDB compares all pairs.
LETTER = "CASE {} WHEN 'click' THEN 'a' WHEN 'error' THEN 'b' WHEN 'purchase' THEN 'c' WHEN 'signup' THEN 'd' ELSE 'e' END"
query(
    "nearest_variants",
    f""", m AS (SELECT DISTINCT t FROM (SELECT string_agg({LETTER.format("activity")}, '' ORDER BY us, event_idx) AS t FROM e GROUP BY case_id)),
o AS (SELECT DISTINCT t FROM (SELECT string_agg({LETTER.format("activity")}, '' ORDER BY us, event_idx) AS t FROM e WHERE activity <> 'error' GROUP BY case_id)),
d AS (SELECT m.t AS variant, o.t AS nearest, levenshtein(m.t, o.t) AS distance FROM m CROSS JOIN o)
SELECT variant, nearest, distance::INT AS distance FROM d QUALIFY row_number() OVER (PARTITION BY variant ORDER BY distance, nearest) = 1""",
)(lambda log: _lettered(matching.nearest_variants(log, log.where("activity <> 'error'"))))


def _lettered(found):
    """Variants as one letter an activity, in the order of the activities' names."""
    letter = lambda a: F.when(a == "click", "a").when(a == "error", "b").when(a == "purchase", "c").when(a == "signup", "d").otherwise("e")
    text = lambda c: F.array_join(F.transform(c, letter), "").alias(c)
    return found.select(text("variant"), text("nearest"), "distance")


TIMELINE = """, acts AS (SELECT DISTINCT activity AS other FROM e), ends AS (SELECT activity, us AS t, 0 AS side, event_idx FROM e UNION ALL SELECT activity, us, 1, event_idx FROM e),
tl AS (SELECT CASE WHEN side = 0 THEN activity ELSE other END AS a, CASE WHEN side = 0 THEN other ELSE activity END AS b, t, side, event_idx FROM ends JOIN acts ON other <> activity),
run AS (SELECT *, sum(1 - 2 * side) OVER w AS s, sum(side) OVER w AS bs FROM tl WINDOW w AS (PARTITION BY a, b ORDER BY t, side, event_idx)),
low AS (SELECT *, least(0, min(s) OVER (PARTITION BY a, b ORDER BY t, side, event_idx)) AS lo, least(0, coalesce(min(s) OVER (PARTITION BY a, b ORDER BY t, side, event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prior FROM run),
met AS (SELECT * FROM low WHERE side = 0 OR s >= prior)"""
MATCHED = " SELECT x.a, x.b, count(*) AS n, round(avg((y.t - x.t) / 1e6), 3) AS mean_s, min((y.t - x.t) / 1e6) AS min_s, max((y.t - x.t) / 1e6) AS max_s FROM {} x JOIN {} y ON x.a = y.a AND x.b = y.b AND x.side = 0 AND y.side = 1 AND {} GROUP BY ALL"
_rounded = lambda df: df.withColumn("mean_s", F.round("mean_s", 3))
query("matched_durations", TIMELINE + MATCHED.format("met", "met", "x.s + x.bs = y.bs + y.lo"))(lambda log: _rounded(matching.matched_durations(log)))
query(
    "matched_durations_lifo",
    TIMELINE + ", pl AS (SELECT *, s - lo + side AS place FROM met), tn AS (SELECT *, row_number() OVER (PARTITION BY a, b, place, side ORDER BY t, event_idx) AS turn FROM pl)" + MATCHED.format("tn", "tn", "x.place = y.place AND x.turn = y.turn"),
)(lambda log: _rounded(matching.matched_durations(log, lifo=True)))

# Drift: five cases to a sub-log; the permutation tests have no SQL and are held against a plain version
query(
    "drift_features",
    """, rk AS (SELECT case_id, (row_number() OVER (ORDER BY first_us, case_id) - 1) // 5 AS sub FROM c), oc AS (SELECT case_id, sub, activity, min(p) AS lo, max(p) AS hi FROM s JOIN rk USING (case_id) GROUP BY ALL),
held AS (SELECT sub, activity AS a, count(*) AS n FROM oc GROUP BY ALL), f AS (SELECT x.sub, x.activity AS a, y.activity AS b, count(*) AS m FROM oc x JOIN oc y ON x.case_id = y.case_id AND x.lo < y.hi GROUP BY ALL),
g AS (SELECT f.sub, b AS activity, count(*) FILTER (m = n) AS al, count(*) FILTER (m < n) AS so FROM f JOIN held USING (sub, a) GROUP BY ALL), act AS (SELECT DISTINCT activity FROM e)
SELECT sub::INT AS sub, activity, coalesce(al, 0) AS always, coalesce(so, 0) AS sometimes, (SELECT count(*) FROM act) - coalesce(al, 0) - coalesce(so, 0) AS never FROM (SELECT DISTINCT sub FROM rk) CROSS JOIN act LEFT JOIN g USING (sub, activity)""",
)(lambda log: drift.follows_features(log, drift.sub_logs(log, 5)))
query("concept_drift")(lambda log: drift.drift_points(log, 5, 4, 100, 1.0, 3))

# Segments of at most three activities that half of the cases hold
HELD = "HAVING count(*) >= 0.5 * (SELECT count(*) FROM c)"
query(
    "frequent_segments",
    f""", p1 AS (SELECT case_id, activity AS a, min(p) AS p FROM s GROUP BY ALL), k1 AS (SELECT a FROM p1 GROUP BY a {HELD}),
p2 AS (SELECT x.case_id, x.a, s.activity AS b, min(s.p) AS p FROM p1 x JOIN k1 USING (a) JOIN s ON s.case_id = x.case_id AND s.p > x.p GROUP BY ALL), k2 AS (SELECT a, b FROM p2 GROUP BY a, b {HELD}),
p3 AS (SELECT x.case_id, x.a, x.b, s.activity AS d, min(s.p) AS p FROM p2 x JOIN k2 USING (a, b) JOIN s ON s.case_id = x.case_id AND s.p > x.p GROUP BY ALL)
SELECT a AS segment, count(*) AS n FROM p1 GROUP BY a {HELD} UNION ALL SELECT a || ',' || b, count(*) FROM p2 GROUP BY a, b {HELD} UNION ALL SELECT a || ',' || b || ',' || d, count(*) FROM p3 GROUP BY a, b, d {HELD}""",
)(lambda log: segments.frequent_segments(log, -(-log.select("case_id").distinct().count() // 2), 3).withColumn("segment", F.array_join("segment", ",")))
query("similar_roles")(organisation.similar_roles)
