"""Metric goldens (classification scores, votes, medians)."""

from pyspark.sql import functions as F

from shotweave.operators import metrics as M
from shotweave.operators.score import majority_vote


def test_macro_scores_union_of_labels(spark):
    # label 2 only predicted, label 1 only in truth; OOS (9) predicted on an in-scope row
    rows = [(0, 0), (0, 2), (1, 0), (9, 9), (0, 9)]
    df = spark.createDataFrame(rows, "label int, pred int")
    r = M.classification_report(df, oos_id=9).first()
    # per class: 0: tp1 t3 p2 -> f1 .4 ; 1: t1 -> 0 ; 2: p1 -> 0 ; 9: tp1 t1 p2 -> 2/3
    assert abs(r.f1 - round((0.4 + 0 + 0 + 2 / 3) / 4, 6)) < 1e-9
    assert abs(r.accuracy - 0.4) < 1e-9
    assert abs(r.inscope_accuracy - 0.25) < 1e-9
    assert abs(r.oos_recall - 1.0) < 1e-9
    # in-scope F1 keeps the OOS prediction as a class with F1 = 0
    ins = [(0, 0), (0, 2), (1, 0), (0, 9)]
    c = {0: (1, 3, 2), 1: (0, 1, 0), 2: (0, 0, 1), 9: (0, 0, 1)}
    want = sum(2 * tp / (t + p) if t + p else 0 for tp, t, p in c.values()) / len(c)
    assert abs(r.inscope_f1 - round(want, 6)) < 1e-9
    assert len(ins) == 4


def test_oos_recall_null_without_oos(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    r = M.classification_report(df, oos_id=9).first()
    assert r.oos_recall is None


def test_confusion_total_equals_rows(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "label int, pred int")
    cm = M.confusion_matrix(spark, df, 3)
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == 3


def test_vote_tie_and_no_valid_vote(spark):
    resp = spark.createDataFrame([(1, "b"), (1, " a "), (2, "zzz")], "row_id long, response string")
    cand = spark.createDataFrame([(k, c, i) for k in (1, 2) for i, c in enumerate(["a", "b", "c"])],
                                 "row_id long, candidate string, pos int")
    got = {r.row_id: r.vote for r in majority_vote(resp, cand).collect()}
    assert got == {1: "a", 2: "a"}   # tie -> earliest; no valid response -> first candidate


def test_ttr_counts(spark):
    df = spark.createDataFrame([("a b a",), ("a b",)], "text string")
    r = {x.n: (x.types, x.tokens) for x in M.ttr(df, ns=(1, 2)).collect()}
    assert r[1] == (2, 5) and r[2] == (2, 3)


def test_median_even_count_truncates(spark):
    from shotweave.operators.sample import synthetic_quota
    rows = []
    sizes = {"a_x": 1, "a_y": 2, "b_x": 4, "b_y": 9, "c_x": 3}
    rid = 0
    for intent, n in sizes.items():
        for _ in range(n):
            rows.append((rid, "t", intent, intent.split("_")[0], 0, "train"))
            rid += 1
    c = spark.createDataFrame(rows, "row_id long, text string, intent string, domain string, intent_id int, split string")
    q = {r.val_domain: r.quota for r in synthetic_quota(c).collect()}
    # held out a: median(4, 9, 3) = 4 ; held out b: median(1, 2, 3) = 2 ; held out c: median(1,2,4,9) = 3
    assert q == {"a": 4, "b": 2, "c": 3}


def test_ttr_approx_close_to_exact(spark):
    from conftest import SF_SMALL
    from shotweave.sources.corpus import corpus
    c = corpus(spark, SF_SMALL)
    exact = {r.n: r.types for r in M.ttr(c).collect()}
    approx = {r.n: (r.types, r.tokens) for r in M.ttr(c, approx_rsd=0.02).collect()}
    for n, t in exact.items():
        assert abs(approx[n][0] - t) <= 0.1 * t


def test_ttr_shuffles_blocks_not_grams(spark):
    rows = [("a", "one two three one two three"), ("a", None), (None, "one two"), ("b", ""), (None, "x, y")]
    df = spark.createDataFrame(rows, "g string, text string")
    out = M.ttr(df, ns=(1, 2), group=("g",))
    assert {(r.g, r.n): (r.types, r.tokens) for r in out.collect()} == {
        ("a", 1): (3, 6), ("a", 2): (3, 5), (None, 1): (5, 5), (None, 2): (3, 3)}
    # a block of many grams is a row of the shuffle
    many = spark.createDataFrame([(" ".join("x" * (i + 1) for i in range(500)),)], "text string")
    ttr = M.ttr(many, ns=(1, 2))
    assert "_grams" in ttr._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in ttr.collect()) == [(1, 500, 500, 1.0), (2, 499, 499, 1.0)]


def test_ttr_in_passes_leaves_no_blocks_of_grams(spark, monkeypatch):
    """a pass counts its share of the grams and hands on nothing but counts; together the passes count each gram once."""
    written, inner = [], M.durable
    monkeypatch.setattr(M, "durable", lambda df, name: written.append(inner(df, name)) or written[-1])
    rows = [(g, " ".join("xyz"[(i * j) % 3] * (i % 17 + 1) for i in range(40))) for g in ("a", None) for j in range(1, 20)]
    df = spark.createDataFrame([*rows, ("b", None), ("b", "")], "g string, text string")
    want = {}
    for g, text in rows:
        words = text.split()
        for n in (1, 2, 4):
            want.setdefault((g, n), []).extend(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    for passes in (1, 5):
        out = M.ttr(df, ns=(1, 2, 4), group=("g",), passes=passes)
        assert {(r.g, r.n): (r.types, r.tokens) for r in out.collect()} == {k: (len(set(x)), len(x)) for k, x in want.items()}
    assert len(written) == 5
    assert all(t.columns == ["_g0", "n", "types", "c"] and t.count() <= len(want) for t in written)
    assert sum(t.count() for t in written) > len(want)


def test_packed_grams_are_the_same_grams():
    grams = M._distinct(M.np.array([(7, 1), (2 ** 64 - 1, 5), (7, 0), (0, 3), (7, 1), (2 ** 63, 2 ** 64 - 1)], M.GRAM))
    assert grams.tolist() == [(0, 3), (7, 0), (7, 1), (2 ** 63, 2 ** 64 - 1), (2 ** 64 - 1, 5)]
    for some in (grams, grams[3:], grams[:0]):
        assert M._unpacked(M._packed(some)).tolist() == some.tolist()
