"""Readers on inline files, the run-tree layout, and the plot frame."""

import json
import os
import re
import tempfile

import pytest

from shotweave.operators import results as R
from shotweave.operators.review import AnnotationMismatch
from shotweave.sources import corpus as C
from shotweave.sources import readers as RD
from shotweave.sources import sinks as SK


def test_read_split_json_routes_keys(spark):
    d = tempfile.mkdtemp(prefix="sw-json-", dir="/tmp")
    doc = {"train": [["book a table", "book"], ["hi", "greet"]], "oos_train": [["blah", "oos"]],
           "val": [["hello", "greet"]], "valid": [["x", "book"]], "test": [["y", "greet"]], "weird": [["z", "book"]]}
    with open(os.path.join(d, "data_full.json"), "w") as f:
        json.dump(doc, f)
    rows = {(r.split_key, r.split, r.text) for r in RD.read_split_json(spark, d).collect()}
    assert ("oos_train", "train", "blah") in rows and ("valid", "val", "x") in rows
    assert ("weird", "test", "z") in rows and len(rows) == 7


def test_label_map_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="sw-map-", dir="/tmp")
    dim = spark.createDataFrame([("b", 1), ("a", 0), ("oos", 2)], "intent string, intent_id int")
    RD.write_label_map(dim, d + "/name2id")
    got = {r.intent: r.intent_id for r in RD.read_label_map(spark, d + "/name2id").collect()}
    assert got == {"a": 0, "b": 1, "oos": 2}


def test_annotation_length_mismatch_raises(spark):
    d = tempfile.mkdtemp(prefix="sw-ann-", dir="/tmp")
    with open(d + "/answers.txt", "w") as f:
        f.write("1\n2\n3\n")
    with open(d + "/labels.txt", "w") as f:
        f.write("a\nb\n")
    with pytest.raises(AnnotationMismatch):
        RD.read_annotations(spark, d + "/answers.txt", d + "/labels.txt")


def test_unknown_dataset_raises():
    with pytest.raises(NotImplementedError):
        RD.dataset_spec("nope")


def test_plot_frame_and_thresholds(spark):
    means = spark.createDataFrame(
        [("gpt3_gptj_0.5", "clinc_oos", 0, "val", "IA", 80.0), ("gpt3_gptj_0.5", "clinc_oos", 1, "val", "IA", 82.0),
         ("gpt3_gptj_0.5", "clinc_oos", 0, "val", "A", 10.0), ("gpt3_gptj_1.0", "hwu64", 0, "val", "A", 70.0),
         ("gpt3_ada_1.0", "hwu64", 0, "val", "A", 1.0)],
        "exp_key string, dataset string, run int, scope string, metric string, value double")
    fid = spark.createDataFrame([("clinc_oos", "gptj_0.5", 0.9), ("hwu64", "gptj_1.0", 0.7),
                                 ("clinc_oos", "threshold", 0.95)], "ds string, attr string, fidelity double")
    got = {(r.temp, r.ds): (r.val_acc_mean, r.val_acc_std, r.fidelity) for r in R.plot_frame(means, fid).collect()}
    assert got == {(0.5, "clinc_oos"): (81.0, 1.0, 0.9), (1.0, "hwu64"): (70.0, 0.0, 0.7)}
    assert R.thresholds(fid).first().threshold == 0.95


def test_metric_rules_snips_and_oos(spark):
    runs = spark.createDataFrame(
        [("f1", "snips_official", "full_x", None, "baseline", None, None, 0),
         ("f2", "clinc_oos", "few_pure", 42, "eda", None, None, 0),
         ("f3", "hwu64", "few_pure", None, "eda", None, None, 0)],
        "folder string, dataset string, config string, oos_id long, exp_type string, engine string, temp string, run int")
    res = spark.createDataFrame(
        [("f1", "overall", "test_accuracy", 0.5), ("f1", "few_shot", "test_accuracy", 0.4),
         ("f2", None, "test_accuracy", 0.9), ("f2", None, "test_oos_recall", 0.3),
         ("f3", None, "test_oos_recall", 0.3), ("f3", None, "valid_accuracy", 0.8)],
        "folder string, scope string, key string, value double")
    m = {(r.folder, r.scope, r.metric) for r in R.extract_metrics(spark, R.select_runs(runs), res).collect()}
    assert m == {("f1", "overall", "IA"), ("f1", "few_shot", "IA"), ("f2", "test", "A"), ("f2", "test", "OR"),
                 ("f3", "val", "A")}


def test_sheets_keep_cells(spark, tmp_path):
    rows = [("a", "d<>x", "prompt", ' two "quoted", blanks ', None, "1"), ("a", "d<>x", "generated", "line\nbreak\r\nend", "y", "2"),
            ("a", "d<>z", "generated", "", "#", "3"), ("b", "d/q", "prompt", "tab\there \\ back", "", "4")]
    SK.write_sheets(spark.createDataFrame(
        rows, "attr string, sheet string, kind string, text string, oracle_prediction string, row_key string"), f"{tmp_path}/s")
    back = SK.read_sheets(spark, f"{tmp_path}/s", "kind string, text string, oracle_prediction string, row_key string")
    want = {(k, t, o or "", n, a, re.sub("[/<>]", "_", s)) for a, s, k, t, o, n in rows}
    assert set(map(tuple, back.collect())) == want


def test_experiment_groups(spark):
    g = R.experiment_groups(spark)
    n = {r.exp_group: r["count"] for r in g.groupBy("exp_group").count().collect()}
    assert len(n) == 23 and n["ex2_setup"] == 500 and n["snips_ex2_setup"] == 350 and n["snips_baselines"] == 1
    assert n["fewshot_eda_hwu64"] == 20 and n["fewshot_oracle_clinc"] == 50
    assert R.experiment_groups(spark, ["hwu64_baselines"]).first().exp_type == "intrinsic"
    with pytest.raises(KeyError):
        R.experiment_groups(spark, ["nope"])
    runs = spark.createDataFrame(
        [("f", "hwu64", "few_pure", "eda", None, None, 3), ("f2", "hwu64", "few_pure", "eda", None, None, 3),
         ("f3", "hwu64", "few_pure", "gpt3", "ada", "1.0", 0), ("f4", "hwu64", "few_pure", "gpt3", "ada", "0.5", 0)],
        "folder string, dataset string, config string, exp_type string, engine string, temp string, run int")
    got = {r.exp_group: (r.n_experiments, r.n_done, r.n_folders) for r in R.group_progress(g, runs).collect()}
    assert got["fewshot_eda_hwu64"] == (20, 1, 2) and got["fewshot_gpt3_hwu64"] == (50, 1, 1) and got["ex2_setup"] == (500, 0, 0)


def test_scope_view(spark):
    means = spark.createDataFrame([("k", "d", 0, "val", "A", 80.0), ("k", "d", 1, "val", "A", 81.0), ("k", "d", 0, "test", "A", 7.005)],
                                  "exp_key string, dataset string, run int, scope string, metric string, value double")
    row = R.summary_pivot(R.summary(means), ["test", "val", "overall"]).first()
    assert row.val == "80.50 (0.50)" and row.test.endswith(" (0.00)") and row.overall is None


def test_corpus_keeps_rows_without_source_and_checks_lines(spark, tmp_path, monkeypatch):
    docs = [(1, "a\nb", "en", None), (2, "c", None, "web"), (3, None, "en", "web"), (4, "d\ne\nf", "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.row_id, r.text, r.intent) for r in C.build_corpus(spark, str(tmp_path)).collect()}
    assert got == {(1000000, "a", "en_unknown"), (1000001, "b", "en_unknown"), (2000000, "c", "unknown_web"),
                   (4000000, "d", "oos"), (4000001, "e", "oos"), (4000002, "f", "oos")}
    monkeypatch.setattr(C, "LINE_KEY", 2)
    with pytest.raises(Exception, match="more than 2 lines"):
        C.base_rows(spark, str(tmp_path)).collect()


def test_run_folders_are_written_by_tasks(spark, monkeypatch):
    """no run folder goes through the driver where tasks share the folder."""
    from shotweave.plans import q_io

    def driver(*_):
        raise AssertionError("written by the driver")
    monkeypatch.setattr(q_io, "write_small", driver)
    sf = "/root/testdata/sf0.001"
    got = q_io.q_src08(spark, sf)
    runs, res = q_io.run_tables(spark, sf)
    want = runs.join(res, "folder").selectExpr("folder", "config", "run", "scope", "key", "round(value, 9) AS value")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(want.columns).collect())) == sorted(map(key, want.collect()))
