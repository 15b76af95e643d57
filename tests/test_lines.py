"""Line numbers of files and sorted tables, and what goes by them."""

import pytest
from pyspark.sql import functions as F

from shotweave.operators import labels as L
from shotweave.operators.review import blind_sheet
from shotweave.sources import readers as RD
from shotweave.sources.tables import numbered, write_small
from shotweave.streaming.incremental import scratch_path


def test_lines_end_at_newline_only(spark):
    path = scratch_path(spark, "lines")
    write_small(spark, f"{path}/a", "x\ra\n\n é y \r\nlast")
    write_small(spark, f"{path}/b", "1\n2\n")
    got = sorted(tuple(r) for r in RD.read_line_file(spark, path, "t").collect())
    assert got == [(0, "x\ra"), (1, ""), (2, " é y \r"), (3, "last"), (4, "1"), (5, "2")]
    pairs = RD.read_parallel_lines(spark, f"{path}/a", f"{path}/a").orderBy("line_no").collect()
    assert [r.text for r in pairs] == ["x\ra", "", "é y", "last"] == [r.intent for r in pairs]


def test_numbers_over_many_splits(spark):
    path = scratch_path(spark, "splits")
    lines = [f"{'x' * (i % 37)}{i}" for i in range(20_000)]
    for k in range(3):
        write_small(spark, f"{path}/part-{k}", "\n".join(lines[k::3]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = RD.read_line_file(spark, path, "t")
        assert got._jdf.queryExecution().executedPlan().toString().count("Python") == 0
        rows = {r.line_no: r.t for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [rows[i] for i in range(20_000)] == lines[0::3] + lines[1::3] + lines[2::3]


def test_numbered_follows_the_sort(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"))
    out = numbered(df.orderBy(F.desc("v")), "n", start=1)
    assert out.where(F.col("n") != 5000 - F.col("v")).count() == 0 and out.count() == 5000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
    assert numbered(df.limit(0).orderBy("v"), "n").count() == 0


def test_blind_sheet_without_python_rows(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(50)], "row_id long, text string, intent string")
    sheet = blind_sheet(rows, ["a"])
    assert "Python" not in sheet._jdf.queryExecution().executedPlan().toString()
    got = sheet.collect()
    assert sorted(r.line_no for r in got) == list(range(1, 26)) and {r.label for r in got} == {"a"}
    assert [r.text for r in sorted(got)] != sorted(r.text for r in got)


def test_declared_lists_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_CLASSES", 3)
    assert L.label_dictionary_from_list(spark, ["b", "a"]).collect()[0].intent == "b"
    with pytest.raises(ValueError, match="at most 3"):
        L.label_dictionary_from_list(spark, list("abcd"))
    with pytest.raises(ValueError, match="at most 3"):
        L.domain_map_rows(spark, {"d": list("abcd")})


def test_unknown_labels_raise_unless_dropped(spark):
    dim = L.label_dictionary_from_list(spark, ["a", "b"])
    rows = spark.createDataFrame([("a",), ("z",)], "intent string")
    with pytest.raises(L.UnknownLabelError):
        L.encode_labels(rows, dim)
    assert L.encode_labels(rows, dim, unknown_labels="drop").count() == 1
    with pytest.raises(ValueError):
        L.encode_labels(rows, dim, unknown_labels="x")


def test_out_of_scope_id_may_be_missing(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,)], "intent_id int")
    assert [L.filter_oos(rows, 1).count(), L.extract_oos(rows, 1).count()] == [2, 1]
    assert [L.filter_oos(rows, None).count(), L.extract_oos(rows, None).count()] == [3, 0]
