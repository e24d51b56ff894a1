"""Registered queries of densities, log-wide order, busy time and further relations and filters, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, relations, statistics
from ..schema import cases
from .catalog import KEPT, PAIRS, kept, query

# Relations
query("first_following", f"SELECT case_id, event_idx, a, b, min(gap) AS gap FROM ({PAIRS.replace('x.case_id,', 'x.case_id, x.event_idx,', 1)}) GROUP BY ALL")(relations.first_following)
query(
    "self_distance_witnesses",
    """, o AS (SELECT case_id, activity, p, lead(p) OVER (PARTITION BY case_id, activity ORDER BY p) AS q FROM s), d AS (SELECT activity, min(q - p - 1) AS d FROM o WHERE q IS NOT NULL GROUP BY activity)
SELECT DISTINCT o.activity, s.activity AS witness FROM o JOIN d USING (activity) JOIN s ON s.case_id = o.case_id AND s.p > o.p AND s.p < o.q WHERE o.q - o.p - 1 = d.d""",
)(relations.witnesses)
query(
    "precede_succeed",
    """, acts AS (SELECT activity AS a, count(*) AS ka FROM e GROUP BY activity), n AS (SELECT a, ka, e.activity AS b, count(*) FILTER (e.activity = a) OVER (PARTITION BY a ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM acts CROSS JOIN e)
SELECT a, b, sum(n) / (ka::DOUBLE * count(*)) AS share FROM n WHERE a <> b GROUP BY a, b, ka""",
)(statistics.precede_succeed)

# Times
WORK = 120_000_000  # short enough that busy stretches differ in tables of any size
STRETCHES = f""", iv AS (SELECT us - {WORK} AS s0, us AS s1 FROM e), far AS (SELECT *, max(s1) OVER (ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
num AS (SELECT *, sum(CASE WHEN far >= s0 THEN 0 ELSE 1 END) OVER (ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS k FROM far), span AS (SELECT k, min(s0) AS a, max(s1) AS b FROM num GROUP BY k)"""
query("cycle_time", STRETCHES + " SELECT round(coalesce(sum(b - a) FILTER (k < (SELECT max(k) FROM span)), 0) / 1e6 / (SELECT count(*) FROM c), 6) AS cycle_s FROM span")(
    lambda log: statistics.cycle_time(log.withColumn("start_us", F.col("us") - WORK)).select(F.round("cycle_s", 6).alias("cycle_s"))
)
query("cycle_time_with_last", STRETCHES + " SELECT round(sum(b - a) / 1e6 / (SELECT count(*) FROM c), 6) AS cycle_s FROM span")(
    lambda log: statistics.cycle_time(log.withColumn("start_us", F.col("us") - WORK), include_last=True).select(F.round("cycle_s", 6).alias("cycle_s"))
)


# Densities
def _density(values: str) -> str:
    return f""", vals AS ({values}), f AS (SELECT count(v) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(v), -0.2::DOUBLE) AS h FROM vals),
xs AS (SELECT DISTINCT x FROM (SELECT CASE WHEN k = 9 THEN hi ELSE lo + k / 9.0::DOUBLE * (hi - lo) END AS x FROM f, range(10) t(k) UNION ALL
SELECT CASE WHEN k = 9 THEN hi ELSE greatest(lo, 1e-6::DOUBLE) * pow(hi / greatest(lo, 1e-6::DOUBLE), k / 9.0::DOUBLE) END FROM f, range(10) t(k)))
SELECT round(x, 4) AS x, round(sum(exp(-pow((x - v) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM xs, vals, f WHERE v IS NOT NULL GROUP BY x"""


def _rounded(values):
    return statistics.kernel_density(values, 20).select(F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


query("value_density", _density("SELECT value::DOUBLE AS v FROM e"))(lambda log: _rounded(log.select("value")))
query("hour_density", _density("SELECT us / 3.6e9::DOUBLE AS v FROM e"))(lambda log: _rounded(log.select((F.col("us") / 3.6e9).alias("value"))))
query("case_duration_density", _density("SELECT (last_us - first_us) / 3.6e9::DOUBLE AS v FROM c"))(lambda log: _rounded(cases(log).select(((F.col("last_us") - F.col("first_us")) / 3.6e9).alias("value"))))

# Filters
kept("filter_variants_out", KEPT + "NOT IN (SELECT case_id FROM v WHERE variant = ['view'] OR variant = ['view', 'click'])", lambda log: filters.with_variants(log, [["view"], ["view", "click"]], keep=False))
query(
    "events_between_activities",
    """, m AS (SELECT *, max(p) FILTER (activity = 'signup') OVER (PARTITION BY case_id ORDER BY p) AS la, max(p) FILTER (activity = 'purchase') OVER (PARTITION BY case_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb,
max(p) FILTER (activity = 'purchase') OVER (PARTITION BY case_id) AS fb FROM s) SELECT event_idx, activity FROM m WHERE la IS NOT NULL AND (lb IS NULL OR la > lb) AND p <= fb""",
)(lambda log: filters.between(log, "signup", "purchase").select("event_idx", "activity"))
