"""Files of logs and graphs with all their parts, and filters of logs whose columns bear names of helper columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from caseloom.functions.order import lagged
from caseloom.operators import features, filters, organisation
from caseloom.sources import logs


def log_of(spark, traces, **more):
    rows = [(c, a, i * 1000, i, "r") for c, t in traces.items() for i, a in enumerate(t)]
    log = spark.createDataFrame(rows, "case_id string, activity string, us long, event_idx long, resource string")
    return log.withColumns({k: F.lit(v) for k, v in more.items()})


def test_graph_file_is_text_of_places(spark, tmp_path):
    edges = spark.createDataFrame([("b x", "a", 3), ("a", "b x", 2), ("a", "a", 1)], "a string, b string, n long")
    starts = spark.createDataFrame([("a", 4), ("lone", 1)], "activity string, n long")
    ends = spark.createDataFrame([("b x", 5)], "activity string, n long")
    logs.write_dfg(edges, starts, ends, str(tmp_path / "g"))
    files = list((tmp_path / "g").glob("part-*"))
    assert len(files) == 1
    assert files[0].read_text() == "3\na\nb x\nlone\n2\n0x4\n2x1\n1\n1x5\n0>0x1\n0>1x2\n1>0x3\n"
    found = [sorted(map(tuple, df.collect())) for df in logs.read_dfg(spark, str(files[0]))]
    assert found == [sorted(map(tuple, df.collect())) for df in (edges, starts, ends)]
    other = tmp_path / "other.dfg"
    other.write_bytes(b"2\r\nz\r\ny\r\n1\r\n0x7\r\n1\r\n1x7\r\n0>1x7\r\n\r\n")
    assert [list(map(tuple, df.collect())) for df in logs.read_dfg(spark, str(other))] == [[("z", "y", 7)], [("z", 7)], [("y", 7)]]


def test_graph_without_edges(spark, tmp_path):
    none = spark.createDataFrame([], "a string, b string, n long")
    alone = spark.createDataFrame([("a", 2)], "activity string, n long")
    logs.write_dfg(none, alone, alone, str(tmp_path / "g"))
    found = [list(map(tuple, df.collect())) for df in logs.read_dfg(spark, str(tmp_path / "g"))]
    assert found == [[], [("a", 2)], [("a", 2)]]


def test_xes_keeps_attributes_of_events_and_traces(spark, tmp_path):
    day = datetime.datetime(2024, 2, 3, 4, 5, 6, 789000)
    log = log_of(spark, {"1": "ab", "2": "a"}, cost=1.5, count=7, done=True)
    log = log.withColumns({"due": F.lit(day), "note": F.when(F.col("activity") == "a", F.lit('say "<&>"')), "case:value": F.when((F.col("case_id") == "1") & (F.col("us") > 0), F.lit(9))})
    logs.write_xes(log, str(tmp_path / "x"), ["cost", "count", "done", "due", "note", "case:value"])
    kinds = {"concept:name": "string", "cost": "float", "count": "int", "done": "boolean", "due": "date", "note": "string"}
    back = logs.read_xes(spark, str(tmp_path / "x"), columns=kinds, case_columns={"value": "int"})
    found = sorted(map(tuple, back.collect()))
    assert back.columns == ["case:concept:name", "event_idx", *kinds, "case:value"]
    assert found == [("1", 0, "a", 1.5, 7, True, day, 'say "<&>"', 9), ("1", 1, "b", 1.5, 7, True, day, None, 9), ("2", 0, "a", 1.5, 7, True, day, 'say "<&>"', None)]


CUTS = [
    lambda log: filters.prefixes(log, "b"),
    lambda log: filters.suffixes(log, "b", strict=False),
    lambda log: filters.between(log, "a", "c"),
    filters.collapse_runs,
    lambda log: features.prefixes_of(log, 2),
]


@pytest.mark.parametrize("cut", CUTS)
def test_columns_named_as_helpers_keep_their_values(spark, cut):
    traces = {"1": "aabbca", "2": "bacab"}
    own = {"edge": 1, "before": 2, "K": 3, "last_b": 4, "other": 5, "place": 6}
    key = ["case_id", "activity", "us", "event_idx"]
    plain, marked = cut(log_of(spark, traces)), cut(log_of(spark, traces, **own))
    assert set(marked.columns) == set(log_of(spark, traces, **own).columns)
    assert sorted(map(tuple, marked.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))
    assert {tuple(r) for r in marked.select(*own).collect()} == {tuple(own.values())}


def test_row_before_over_ranges(spark):
    rows = [(k * 7 % 50, None if k % 9 == 0 else k) for k in range(50)]
    df = spark.createDataFrame(rows, "at long, v long")
    ordered = sorted(rows)
    expected = [(at, v, ordered[i - 1][1] if i else None) for i, (at, v) in enumerate(ordered)]
    assert sorted(map(tuple, lagged(df.repartition(7), "v", "at").collect())) == expected


def test_workload_of_overlapping_events(spark):
    rows = [("1", 0, "r", 0, 10), ("1", 1, "r", 10, 20), ("2", 0, "r", 5, 5), ("2", 1, "s", 0, 9), ("3", 0, None, 0, 9), ("3", 1, "r", 21, 22), ("4", 0, "r", 0, 10)]
    log = spark.createDataFrame(rows, "case_id string, event_idx long, resource string, start_us long, us long").withColumn("activity", F.lit("a"))
    found = {(r.case_id, r.event_idx): r.n for r in organisation.event_workload(log).collect()}
    own = [r for r in rows if r[2]]
    assert found == {(x[0], x[1]): sum(x[2] == y[2] and y[3] <= x[4] and y[4] >= x[3] for y in own) for x in own}
    assert {r.resource: (r.average_workload, r.multitasking) for r in organisation.workload_measures(log, 0, 20).collect()} == {"r": (pytest.approx((40 + 30 + 40) / 30), 1.0), "s": (1.0, 0.0)}
