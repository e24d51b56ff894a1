"""Registered queries of graphs filtered by share and of variants with noisy counts, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connected_graphs
from ..operators.private_variants import private_variants
from .catalog import query
from .feature_catalog import RECURSIVE, SQL

# Links and activities of the log with ranks in the order of removal; DuckDB takes them away one by one and looks for ways each time.
PARTS = """, f AS (SELECT activity AS a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL),
ln AS (SELECT 'edge' AS kind, a, b, n FROM f UNION ALL SELECT 'start', '_S_START_', first_activity, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'end', last_activity, '_S_END_', count(*) FROM c GROUP BY ALL),
act AS (SELECT activity, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT ln.*, CASE WHEN kind = 'edge' THEN (ln.n - coalesce(r.n, 0)) / (ln.n + coalesce(r.n, 0) + 1) ELSE 1 END AS dep FROM ln LEFT JOIN f r ON r.a = ln.b AND r.b = ln.a),
"""
ORDERED = "SELECT *, row_number() OVER (ORDER BY {}) AS i, count(*) OVER () AS k FROM {}"
OPEN = "i <= k - ceil((k - 1) * {}) - 1"
LONGEST = 6  # links of the longest way over five activities


def _ways(name: str, start: str, at: str, to: str, inner: str) -> str:
    """inner with the list of nodes that its links cand lead to from start."""
    inner = f"SELECT *, ['{start}'] AS {name} FROM ({inner})"
    for _ in range(LONGEST):
        inner = f"SELECT * REPLACE (list_distinct(list_concat({name}, [x.{to} FOR x IN cand IF list_contains({name}, x.{at})])) AS {name}) FROM ({inner})"
    return inner


def _removed(ranked: str, is_open: str, must: str, gone: str, held: str) -> str:
    """ranked: the parts in order; is_open: which of them may go; must: rows (x) of activities that keep ways; gone: if link x goes with part d."""
    step = f"SELECT t.i, t.ls, t.gone, d.name, must.xs, [x FOR x IN t.ls IF NOT ({gone})] AS cand FROM t JOIN o d ON d.i = t.i + 1 CROSS JOIN must"
    step = _ways("g", "_S_END_", "v", "u", _ways("h", "_S_START_", "u", "v", step))
    done = _ways("g", "_S_END_", "v", "u", _ways("h", "_S_START_", "u", "v", "SELECT ls AS cand, gone FROM t ORDER BY i DESC LIMIT 1"))
    return (
        RECURSIVE + PARTS + f"rk AS ({ranked}), o AS (SELECT * FROM rk WHERE {is_open}), firm AS (SELECT * FROM rk WHERE NOT ({is_open})), must AS (SELECT list(x) AS xs FROM ({must})),\n"
        "t AS (SELECT 0::BIGINT AS i, (SELECT list({'u': a, 'v': b}) FROM ln) AS ls, ['']::VARCHAR[] AS gone UNION ALL "
        f"SELECT i + 1, CASE WHEN ok THEN cand ELSE ls END, CASE WHEN ok THEN list_append(gone, name) ELSE gone END FROM (SELECT *, list_has_all(h, xs) AND list_has_all(g, xs) AS ok FROM ({step}))),\n"
        f"z AS ({done}), left_act AS (SELECT act.* FROM act, z WHERE list_contains(h, activity) AND list_contains(g, activity) AND {held})\n"
        "SELECT kind, a, b, n FROM ln, z WHERE list_contains(cand, {'u': a, 'v': b}) AND list_contains(h, a) AND list_contains(g, a) AND list_contains(h, b) AND list_contains(g, b) "
        "UNION ALL SELECT 'activity', activity, activity, n FROM left_act"
    )


LINK, BOTH_ENDS = "x.u = d.a AND x.v = d.b", "SELECT DISTINCT a AS x FROM firm WHERE kind <> 'start' UNION SELECT b FROM firm WHERE kind <> 'end'"
_graph = connected_graphs.follows_graph
query("dfg_share_of_activities", "x")(lambda log: connected_graphs.by_activities(_graph(log), 0.3).rows())
SQL["dfg_share_of_activities"] = _removed("SELECT *, activity AS name FROM (" + ORDERED.format("n, activity", "act") + ")", OPEN.format(0.3), "SELECT activity AS x FROM firm", "x.u = d.activity OR x.v = d.activity", "NOT list_contains(gone, activity)")
query("dfg_share_of_paths", "x")(lambda log: connected_graphs.by_paths(_graph(log), 0.1).rows())
SQL["dfg_share_of_paths"] = _removed("SELECT *, '' AS name FROM (" + ORDERED.format("n, a, b, kind", "ln") + ")", OPEN.format(0.1), BOTH_ENDS, LINK, "true")
query("dfg_by_dependency", "x")(lambda log: connected_graphs.by_dependency(_graph(log), 0.01).rows())
SQL["dfg_by_dependency"] = _removed("SELECT *, '' AS name FROM (" + ORDERED.format("dep, a, b, kind", "w") + ")", "dep < 0.01", BOTH_ENDS, LINK, "true")

# Variants of the days of users with noisy counts; DuckDB grows the tree over all activities at each prefix
DAY = "days AS (SELECT list(activity ORDER BY us, event_idx) || ['\\0'] AS t FROM e GROUP BY case_id, date_trunc('day', ts)), known AS (SELECT t[:i] AS prefix, count(*) AS cases FROM days, unnest(range(1, len(t) + 1)) r(i) GROUP BY ALL), names AS (SELECT DISTINCT activity AS x FROM e UNION ALL SELECT '\\0')".replace("'\\0'", "chr(0)")
DRAWN = "trunc(-sign(u) * ln(1 - 2 * abs(u)) / {})::BIGINT"
TREE = """, {days}, tree AS (SELECT 0 AS level, ''::VARCHAR AS node, []::VARCHAR[] AS prefix, 0::BIGINT AS n UNION ALL
SELECT * FROM (SELECT level, node, g.prefix, coalesce(cases, 0) + {noise} AS n FROM (SELECT *, (('0x' || substr(sha256('{secret}:' || node), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE - 0.5 AS u FROM
(SELECT level + 1 AS level, sha256(node || ':' || x) AS node, list_append(prefix, x) AS prefix FROM tree CROSS JOIN names WHERE level < {length} AND (level = 0 OR prefix[-1] <> chr(0)))) g LEFT JOIN known ON known.prefix = g.prefix) WHERE n >= {least})
SELECT array_to_string(prefix[:-2], ',') AS variant, n FROM tree WHERE level > 0 AND prefix[-1] = chr(0)"""


def _daily(log):
    return log.withColumn("case_id", F.concat_ws(":", "case_id", F.date_trunc("day", "ts")))


def _private(name: str, epsilon: float | None, least: int, length: int, secret: str = "") -> None:
    query(name, "x")(lambda log: private_variants(_daily(log), epsilon, least, length, secret).withColumn("variant", F.array_join("variant", ",")))
    SQL[name] = RECURSIVE + TREE.format(days=DAY, noise=DRAWN.format(epsilon) if epsilon else "0", secret=secret, length=length, least=least)


_private("private_variants", 0.5, 4, 5, "a secret of this release")
_private("variants_by_prefixes", None, 2, 6)
