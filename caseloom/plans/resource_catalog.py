"""Registered queries of resources' workload and interactions and of cases' arrivals, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import case_tables, organisation
from .catalog import query

LOW, HIGH = 1_704_672_000_000_000, 1_706_140_800_000_000  # 8 and 25 January 2024
SPANS = """, sp AS (SELECT case_id, event_idx, resource, coalesce(lag(us) OVER (PARTITION BY case_id ORDER BY us, event_idx), us) AS b, us AS d FROM e),
wl AS (SELECT x.case_id, x.event_idx, x.resource, x.b, x.d, count(*) AS n FROM sp x JOIN sp y ON x.resource = y.resource AND y.b <= x.d AND y.d >= x.b GROUP BY ALL)"""

query("event_workload", SPANS + " SELECT case_id, event_idx, resource, n FROM wl")(
    lambda log: organisation.event_workload(organisation.since_previous(log)).select("case_id", "event_idx", "resource", "n")
)
query(
    "workload_measures",
    SPANS + f""", su AS (SELECT resource, coalesce(sum((d - b) * n) FILTER (d >= {LOW} AND b < {HIGH}), 0) AS ld, coalesce(sum(d - b) FILTER (d >= {LOW} AND b < {HIGH}), 0) AS tm,
coalesce(sum(d - b) FILTER (b >= {LOW} AND d <= {HIGH} AND n > 1), 0) AS sh, coalesce(sum(d - b) FILTER (b >= {LOW} AND d <= {HIGH}), 0) AS inn FROM wl GROUP BY ALL)
SELECT resource, round(CASE WHEN tm > 0 THEN ld::DOUBLE / tm ELSE 0 END, 6) AS average_workload, round(CASE WHEN inn > 0 THEN sh::DOUBLE / inn ELSE 0 END, 6) AS multitasking FROM su""",
)(lambda log: _rounded(organisation.workload_measures(organisation.since_previous(log), LOW, HIGH), "average_workload", "multitasking"))
query(
    "case_interactions",
    f", fin AS (SELECT DISTINCT e.case_id, resource FROM e JOIN c USING (case_id) WHERE resource IS NOT NULL AND last_us >= {LOW} AND last_us < {HIGH + 10**12}) SELECT x.resource AS a, y.resource AS b, count(*) AS n_cases FROM fin x JOIN fin y ON x.case_id = y.case_id AND x.resource < y.resource GROUP BY ALL",
)(lambda log: organisation.case_interactions(log, LOW, HIGH + 10**12))
query(
    "case_arrivals",
    "SELECT case_id, (first_us - coalesce(lag(first_us) OVER (ORDER BY first_us, case_id), first_us)) / 1e6 AS arrival_s, (last_us - coalesce(lag(last_us) OVER (ORDER BY last_us, case_id), last_us)) / 1e6 AS finish_s FROM c",
)(case_tables.case_arrivals)


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})
