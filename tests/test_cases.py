"""Hand-made logs: pairs that never meet, components, samples."""

from pyspark.sql import functions as F

from caseloom.operators import case_tables, conformance, declarative, object_filters, object_tools, objects
from caseloom.schema import EventSchema, canonical

SCHEMA = EventSchema("case", "act", "t", "i")


def log_of(spark, traces):
    rows = [(c, a, k, k) for c, trace in enumerate(traces) for k, a in enumerate(trace)]
    df = spark.createDataFrame(rows, "case long, act string, i long, s long").withColumn("t", F.timestamp_seconds("s"))
    return canonical(df, SCHEMA)


def test_declare_of_activities_that_never_meet(spark):
    found = {(r.template, r.a, r.b): (r.support, r.confidence) for r in declarative.declare_binary(log_of(spark, ["AB", "AC"])).collect()}
    assert found["non_coexistence", "B", "C"] == (2, 1.0) and found["non_succession", "C", "B"] == (2, 1.0)
    assert found["coexistence", "B", "C"] == (2, 0.0) and found["response", "A", "B"] == (2, 0.5)
    assert {(a, b) for _, a, b in found} == {(a, b) for a in "ABC" for b in "ABC" if a != b}


def test_declare_conformance_of_cases(spark):
    log = log_of(spark, ["AB", "BA", "AAB", "C"])
    model = spark.createDataFrame([("response", "A", "B"), ("exactly_one", "A", None), ("non_coexistence", "B", "C"), ("existence", "C", None)], "template string, a string, b string")
    broken = {(r.case_id, r.template) for r in conformance.declare_deviations(log, model).collect()}
    assert broken == {(0, "existence"), (1, "response"), (1, "existence"), (2, "exactly_one"), (2, "existence")}
    fit = {r.case_id: (r.n_deviations, r.fitness, r.is_fit) for r in conformance.declare_conformance(log, model).collect()}
    assert fit == {0: (1, 0.75, False), 1: (2, 0.5, False), 2: (2, 0.5, False), 3: (0, 1.0, True)}
    assert conformance.declare_conformance(log.limit(0), model).count() == 0


def object_log(spark, relations):
    rel = spark.createDataFrame(relations, "eid long, oid string")
    events = rel.select("eid").distinct().selectExpr("eid", "'a' AS activity", "eid AS us")
    return objects.ObjectLog(events, rel.select("oid").distinct().selectExpr("oid", "substr(oid, 1, 1) AS type"), rel, o2o=spark.createDataFrame([("x1", "x2"), ("x2", "y3")], "oid string, oid_2 string"))


def test_components_and_links(spark):
    log = object_log(spark, [(1, "x1"), (1, "x2"), (2, "x2"), (2, "y3"), (3, "z4"), (4, "z4"), (4, "z5")])
    found = {r.oid: r.component for r in object_filters.object_components(log).collect()}
    assert found == {"x1": "x1", "x2": "x1", "y3": "x1", "z4": "z4", "z5": "z4"}
    part = object_filters.component_of(log, "y3")
    assert {r.oid for r in part.objects.collect()} == {"x1", "x2", "y3"} and part.o2o.count() == 2
    assert {r.eid for r in object_filters.types(log, ["z"]).events.collect()} == {3, 4}
    assert object_filters.types(log, ["x"]).o2o.count() == 1


def test_samples_keep_cases_and_components_whole(spark):
    log = log_of(spark, ["ABC"] * 400)
    kept = case_tables.sample_cases(log, 0.5).groupBy("case_id").count().collect()
    assert 140 < len(kept) < 260 and {r["count"] for r in kept} == {3}
    assert 450 < case_tables.sample_events(log.withColumn("event_idx", F.col("event_idx") + 3 * F.col("case_id")), 0.5).count() < 750
    assert {r.part for r in case_tables.partitions(log, 4).select("part").distinct().collect()} == {0, 1, 2, 3}
    rows = [(k, f"x{k % 300}") for k in range(300)] + [(k, f"y{k}") for k in range(300)]
    some = object_tools.sample(object_log(spark, rows), 0.5, "component")
    counts = {r["count"] for r in some.relations.groupBy("eid").count().collect()}
    assert counts == {2} and 90 < some.events.count() < 210
    assert 90 < object_tools.sample(object_log(spark, rows), 0.5, "event").events.count() < 210
