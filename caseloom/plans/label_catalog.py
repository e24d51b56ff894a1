"""Registered queries of label splitting, prefix trees and likeness of footprints, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, labels, relations
from .catalog import E, SQL, query
from .matching_catalog import LETTER

AROUND = "list(activity) OVER (PARTITION BY case_id ORDER BY us, event_idx ROWS BETWEEN {} AND {})"
CONTEXT = f""", q AS (SELECT activity, list_concat(coalesce({AROUND.format("2 PRECEDING", "1 PRECEDING")}, []), coalesce({AROUND.format("1 FOLLOWING", "2 FOLLOWING")}, [])) AS context FROM e),
nd AS (SELECT activity, array_to_string(context, ',') AS context, array_to_string([{LETTER.format("x")} FOR x IN context], '') AS t, count(*) AS n FROM q GROUP BY ALL)"""

_joined = lambda df: df.withColumn("context", F.array_join("context", ","))
query("label_contexts", CONTEXT + " SELECT activity, context, n FROM nd")(lambda log: _joined(labels.contexts(log)).drop("node"))
query(
    "similar_contexts",
    CONTEXT + " SELECT x.activity, x.context AS a, y.context AS b, 1 - levenshtein(x.t, y.t) / greatest(len(x.t), len(y.t)) AS weight FROM nd x JOIN nd y ON x.activity = y.activity AND x.context < y.context WHERE 1 - levenshtein(x.t, y.t) / greatest(len(x.t), len(y.t)) > 0.5::DOUBLE",
)(lambda log: _likeness(labels.contexts(log)))


def _likeness(nodes):
    """Pairs with their contexts as texts, the smaller text first."""
    links, texts = labels.similar_contexts(nodes), _joined(nodes)
    x = texts.select(F.col("node").alias("u"), "activity", F.col("context").alias("x"))
    rows = links.join(x, "u").join(texts.select(F.col("node").alias("v"), F.col("context").alias("y")), "v")
    return rows.select("activity", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")


query("split_labels")(lambda log: labels.split_labels(log).select("case_id", "event_idx", "activity", "label"))

# Nodes of the tree of variants, named by hashes along the way
query("prefix_nodes", "x")(discovery.prefix_nodes)
SQL["prefix_nodes"] = E.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """, t AS (SELECT variant, 0 AS depth, '' AS parent, '' AS node FROM v UNION ALL SELECT variant, depth + 1, node, sha256(node || '/' || variant[depth + 1]) FROM t WHERE depth < len(variant))
SELECT node, parent, variant[depth] AS activity, depth::INT AS depth, count(*) AS n_cases, count(*) FILTER (depth = len(variant)) AS n_final FROM t WHERE depth > 0 GROUP BY ALL"""

# The log of each half of the month against the other, by the frequent steps of each
HALF = 1_705_363_200_000_000  # 16 January 2024
STEPS = "SELECT activity AS a, b, count(*) AS n FROM (SELECT activity, lead(activity) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS b FROM e WHERE us {} {}) WHERE b IS NOT NULL GROUP BY ALL"
query(
    "footprint_similarity",
    "".join(
        f", f{i} AS ({STEPS.format(sign, HALF)}), g{i} AS (SELECT a, b FROM f{i} WHERE n >= (SELECT avg(n) FROM f{i})), r{i} AS (SELECT a, b, CASE WHEN EXISTS (FROM g{i} y WHERE y.a = g{i}.b AND y.b = g{i}.a) THEN 'parallel' ELSE 'sequence' END AS relation FROM g{i})"
        for i, sign in enumerate(("<", ">="))
    )
    + " SELECT (SELECT count(*) FROM (FROM r0 INTERSECT FROM r1)) / (SELECT count(*) FROM (FROM r0 UNION FROM r1))::DOUBLE AS similarity",
)(lambda log: discovery.footprint_similarity(*[_frequent_footprints(log.where(part)) for part in (F.col("us") < HALF, F.col("us") >= HALF)]))


def _frequent_footprints(log):
    """Footprints by the steps that are at least as frequent as their mean."""
    edges = relations.dfg(log)
    often = edges.join(edges.agg(F.avg("n").alias("mean")), F.col("n") >= F.col("mean")).select("a", "b")  # one row
    back = often.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("back"))
    return often.join(back, ["a", "b"], "left").select("a", "b", F.when(F.col("back") == 1, "parallel").otherwise("sequence").alias("relation"))
