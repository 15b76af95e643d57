"""Hand goldens for the column-level rules."""

import hashlib
import math

from pyspark.sql import functions as F

from shotweave.functions.rand import draw
from shotweave.functions.text import clean_chars, py_strip, regex_tokens, words_of
from shotweave.operators.mix import label_probability, parse_pair
from shotweave.operators.results import t_two_sided_p


def py_draw(*keys):
    h = hashlib.md5("|".join(str(k) for k in keys).encode()).hexdigest()[:8]
    return int(h, 16) / 2 ** 32


def test_draw_matches_python(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, w string")
    got = df.select(draw("s", F.col("id"), F.col("w")).alias("d")).collect()
    assert [r.d for r in got] == [py_draw("s", 1, "a"), py_draw("s", 2, "b")]


def test_clean_chars_goldens(spark):
    rows = [("Don’t A-b çé 9x",), ("it's\ttabbed\nline",), ("  lead",), ("12345",), ("trailing ",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.c for r in df.select(clean_chars(F.col("t")).alias("c")).collect()]
    assert got[0] == "dont a b x"
    assert got[1] == "its tabbed line"
    assert got[2] == "lead"          # one leading space is dropped
    assert got[3] == ""              # digits only: one space, then the leading space goes
    assert got[4] == "trailing "     # a trailing space stays


def test_clean_then_words(spark):
    df = spark.createDataFrame([("A  b, c!",)], "t string")
    assert df.select(words_of(clean_chars(F.col("t"))).alias("w")).first().w == ["a", "b", "c"]


def test_py_strip_and_tokens(spark):
    df = spark.createDataFrame([("\t Hello World 42 \n",)], "t string")
    r = df.select(py_strip(F.col("t")).alias("s"), regex_tokens(F.col("t"), 1).alias("k")).first()
    assert r.s == "Hello World 42" and r.k == ["hello"]


def test_parse_pair_rightmost(spark):
    comp = " first. (intent: a) Sentence: Second One. (intent: B_X) "
    df = spark.createDataFrame([(comp,), ("no pattern",)], "c string")
    t, lbl = parse_pair(F.col("c"))
    rows = df.select(t.alias("t"), lbl.alias("l")).collect()
    assert rows[0].t == "second one." and rows[0].l == "b_x"
    assert rows[1].t is None


def test_label_probability_stops_at_paren(spark):
    df = spark.createDataFrame([(["a", "b", ")", "c"], [-0.1, -0.2, -5.0, -7.0]), (["a"], [-1.0])],
                               "t array<string>, p array<double>")
    got = [r.p for r in df.select(label_probability(F.col("t"), F.col("p")).alias("p")).collect()]
    assert abs(got[0] - math.exp(-0.3)) < 1e-12 and got[1] is None


def test_t_test_p_value(spark):
    df = spark.createDataFrame([(2.101, 18), (1.0, 1), (0.9836, 3)], "t double, df int")
    got = [r.p for r in df.select(t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()]
    assert abs(got[0] - 0.0500) < 5e-4
    assert abs(got[1] - 0.5) < 1e-9            # Cauchy: P(|T| > 1) = 1/2
    assert abs(got[2] - 0.3979) < 5e-4


def _series(t, df):
    """Two-sided p by the finite series for whole degrees of freedom."""
    th = math.atan(abs(t) / math.sqrt(df))
    c2, total, term = math.cos(th) ** 2, 1.0, 1.0
    if df == 1:
        return 1 - 2 * th / math.pi
    if df % 2 == 0:
        for j in range(1, (df - 2) // 2 + 1):
            term *= (2 * j - 1) / (2 * j) * c2
            total += term
        return 1 - math.sin(th) * total
    for j in range(1, (df - 3) // 2 + 1):
        term *= 2 * j / (2 * j + 1) * c2
        total += term
    return 1 - 2 / math.pi * (th + math.sin(th) * math.cos(th) * total)


def test_t_test_p_value_against_the_series(spark):
    rows = [(t * s, df) for df in (1, 2, 3, 4, 7, 10, 33, 120, 501, 1000) for t in (0.0, 1e-3, 0.3, 1.0, 1.96, 4.0, 15.0) for s in (1, -1)]
    got = spark.createDataFrame(rows, "t double, df int").select("t", "df", t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r.p - _series(r.t, r.df)) < 1e-9 for r in got) and len(got) == len(rows)
    # a million degrees: the normal law, a little wider
    big = spark.createDataFrame([(2.0, 1_000_000), (-5.0, 1_000_000), (1.0, 0)], "t double, df int")
    two, five, none = [r[0] for r in big.select(t_two_sided_p(F.col("t"), F.col("df"))).collect()]
    assert abs(two - 0.04550053385) < 1e-10 and abs(five - 5.733997870747465e-07) < 1e-15 and none is None
