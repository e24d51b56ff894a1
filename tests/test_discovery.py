"""Discovery, sources and streams on a log small enough to reckon by hand."""

import datetime as dt
import json

import pytest

from caseloom.operators import discovery, relations
from caseloom.schema import EventSchema, canonical
from caseloom.sources import logs
from caseloom.streaming.relations import stream_edges

START = dt.datetime(2024, 1, 1)
M1 = {"1": "ABC", "2": "ACB", "3": "ABC"}


def log_of(spark, traces):
    rows = [(c, a, START + dt.timedelta(minutes=5 * k), k, "r<&>1") for c, t in traces.items() for k, a in enumerate(t)]
    table = spark.createDataFrame(rows, "c string, act string, ts timestamp, i long, who string")
    return canonical(table.repartition(3), EventSchema("c", "act", "ts", "i", "who"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_transition_system(spark):
    log = log_of(spark, {"1": "ABC", "2": "ABB"})
    assert rows(discovery.transition_system(log)) == [("", "A", "A", 2), ("A", "B", "A,B", 2), ("A,B", "B", "B,B", 1), ("A,B", "C", "B,C", 1)]
    assert ("A,B", "B", "B", 1) in rows(discovery.transition_system(log, view="set"))
    with pytest.raises(ValueError):
        discovery.transition_system(log, view="bag")


def test_prefix_tree(spark):
    found = rows(discovery.prefix_tree(log_of(spark, {"1": "AB", "2": "A", "3": "AB"})))
    assert found == [("A", 1, 3, 1), ("A,B", 2, 2, 2)]
    assert len(rows(discovery.prefix_tree(log_of(spark, M1), most_depth=1))) == 1


def test_prefix_nodes_tell_the_prefixes_of_the_tree(spark):
    log = log_of(spark, {**M1, "4": "A", "5": "AB", "6": "ABCBA"})
    for most in (None, 2):
        nodes = {r.node: r for r in discovery.prefix_nodes(log, most).collect()}
        prefix = lambda r: ([] if not r.parent else prefix(nodes[r.parent])) + [r.activity]  # noqa: B023, E731
        found = sorted((",".join(prefix(r)), r.depth, r.n_cases, r.n_final) for r in nodes.values())
        assert found == rows(discovery.prefix_tree(log, most))


def test_footprint_similarity(spark):
    model = lambda pairs: spark.createDataFrame(pairs, "a string, b string, relation string")
    x = model([("a", "b", "sequence"), ("b", "c", "parallel"), ("c", "b", "parallel")])
    y = model([("a", "b", "sequence"), ("b", "c", "sequence"), ("c", "b", "parallel")])
    none = model([("a", "b", "sequence")]).where("false")
    assert [discovery.footprint_similarity(p, q).first()[0] for p, q in ((x, x), (x, y), (x, none), (none, none))] == [1.0, 0.5, 0.0, 0.0]


def test_alpha_and_heuristics(spark):
    log = log_of(spark, M1)
    alpha = {(a, b): r for a, b, r in rows(discovery.alpha_relations(log))}
    assert alpha[("A", "B")] == "causal" and alpha[("B", "A")] == "inverse" and alpha[("B", "C")] == "parallel" and alpha[("A", "A")] == "none"
    assert len(alpha) == 9
    edges = {(a, b): round(d, 4) for a, b, _, d in rows(discovery.heuristics_dependencies(log))}
    assert edges == {("A", "B"): 0.6667, ("A", "C"): 0.5}
    assert rows(discovery.loops_of_two(log_of(spark, {"1": "ABABA"}), 0.7)) == [("A", "B", 3, 0.75)]


def test_conformance_to_a_graph(spark):
    model, bad = log_of(spark, M1), log_of(spark, {"x": "ABC", "y": "BCA"})
    found = rows(discovery.dfg_conformance(bad, relations.dfg(model), relations.endpoints(model), relations.endpoints(model, "last_activity")))
    assert found == [("x", 4, 0, 1.0), ("y", 4, 3, 0.25)]
    assert discovery.dfg_precision(model, relations.dfg(model)).first()[0] == pytest.approx(0.75)


def test_xes_round_trip(spark, tmp_path):
    log = log_of(spark, M1)
    logs.write_xes(log, str(tmp_path / "x"))
    back = logs.read_xes(spark, str(tmp_path / "x"))
    found = sorted((r["case:concept:name"], r.event_idx, r["concept:name"], r["org:resource"]) for r in back.collect())
    assert found == sorted((c, k, a, "r<&>1") for c, t in M1.items() for k, a in enumerate(t))
    assert back.where("`time:timestamp` IS NULL").count() == 0


def test_graph_round_trip(spark, tmp_path):
    log = log_of(spark, M1)
    parts = relations.dfg(log), relations.endpoints(log), relations.endpoints(log, "last_activity")
    logs.write_dfg(*parts, str(tmp_path / "g"))
    assert [rows(x) for x in logs.read_dfg(spark, str(tmp_path / "g"))] == [rows(x.select(*x.columns)) for x in parts]


def test_object_json(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"events": [{"id": "e1", "type": "pay", "time": "2024-01-01T00:00:00Z", "relationships": [{"objectId": "o1", "qualifier": "x"}]}], "objects": [{"id": "o1", "type": "order"}]}))
    log = logs.read_ocel2_json(spark, str(tmp_path / "o.json"))
    assert rows(log.events) == [("e1", "pay", 1_704_067_200_000_000)] and rows(log.relations) == [("e1", "o1", "x")]


def test_stream_equals_batch(spark, tmp_path):
    log = log_of(spark, {**M1, "4": "AABAC"})
    source = tmp_path / "in"
    table = log.selectExpr("case_id", "activity", "cast(ts as timestamp) AS ts")
    table.where("ts < timestamp'2024-01-01 00:07:00'").coalesce(1).write.parquet(str(source))
    stream = stream_edges(spark.readStream.schema(table.schema).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        table.where("ts >= timestamp'2024-01-01 00:07:00'").coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    finally:
        query.stop()
    found = rows(spark.table("edges").where("a IS NOT NULL").groupBy("a", "b").count())
    assert found == rows(relations.dfg(log).select("a", "b", "n"))
