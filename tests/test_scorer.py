"""Predictions by the envelope against dense scores."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shotweave.functions.arrays import argmax
from shotweave.operators import score
from shotweave.operators.score import NaiveBayesModel, envelope, fit_scorer, predict_keys, score_rows
from shotweave.sources.corpus import corpus


@pytest.mark.parametrize("seed", range(6))
def test_envelope_is_the_first_maximum_everywhere(seed):
    rng = random.Random(seed)
    lines = [(i, -rng.randrange(1, 60), rng.randrange(1, 12)) for i in range(rng.choice((1, 2, 5, 30)))]
    rng.shuffle(lines)
    steps = envelope(lines)
    assert steps[0][0] == 0 and [s[0] for s in steps] == sorted({s[0] for s in steps})
    for n in range(200):
        want = min(lines, key=lambda x: (-(x[1] - n * x[2]), x[0]))[0]
        assert [s for s in steps if s[0] <= n][-1][1] == want


def test_predictions_equal_dense_argmax(spark):
    c = corpus(spark, SF_SMALL)
    model = fit_scorer(c.where("split = 'train'"))
    rows = c.select(F.col("row_id").cast("string").alias("row_key"), "text").unionByName(
        spark.createDataFrame([("empty", ""), ("new", "zzqx " * 40), ("null", None)], "row_key string, text string"))
    dense = score_rows(rows.where("text is not null"), model).select(
        "row_key", F.element_at("_ids", argmax(F.col("scores")) + 1).alias("want"))
    got = predict_keys(rows.where("text is not null"), model)
    both = got.join(dense, "row_key")
    assert both.count() == dense.count() and both.where("pred_id != want").count() == 0
    assert both.where("row_key in ('empty', 'new')").count() == 2


def test_twenty_thousand_classes(spark):
    n = 20_000
    stats = spark.range(n).select(F.col("id").cast("int").alias("intent_id"), F.concat(F.lit("c"), "id").alias("intent"),
                                  (-1.0 - F.col("id") % 977 / 100).alias("log_prior"), (5.0 + F.col("id") % 1013 / 100).alias("log_denom"))
    counts = spark.range(n).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("token"),
                                   F.col("id").cast("int").alias("intent_id"), F.lit(10 ** 15).alias("cnt"))
    model = NaiveBayesModel(stats, counts, F.lit(n))
    rows = spark.createDataFrame([("seen", "wbjccd"), ("unseen", "x"), ("none", "")], "row_key string, text string")
    got = {r.row_key: r.pred_id for r in predict_keys(rows, model).collect()}
    assert got["seen"] == 19223  # w + its digits as letters
    first = min(range(n), key=lambda i: (round((1.0 + i % 977 / 100) * 1e9), i))
    assert got["none"] == first
    assert got["unseen"] == min(range(n), key=lambda i: (round((1.0 + i % 977 / 100) * 1e9) + round((5.0 + i % 1013 / 100) * 1e9), i))


@pytest.mark.parametrize("cells", (3, 40, 1 << 22))
def test_sums_of_a_chunk_in_blocks_equal_brute_force(monkeypatch, cells):
    rng = random.Random(cells)
    monkeypatch.setattr(score, "CELLS", cells)
    weights = {f"w{i}": {c: rng.randrange(1, 10 ** 10) for c in rng.sample(range(0, 70, 7), rng.randrange(1, 9))} for i in range(12)}
    texts = [[f"w{rng.randrange(15)}" for _ in range(rng.randrange(30))] for _ in range(25)]
    counts = pa.table([list(weights), [list(x) for x in weights.values()], [list(x.values()) for x in weights.values()]],
                      ["token", "ids", "weights"])
    want = {}
    for i, text in enumerate(texts):
        for c, w in (x for t in text for x in weights.get(t, {}).items()):
            want[i, c] = want.get((i, c), 0) + w
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = {}
    for first, classes, block in score._token_sums(owner, pa.chunked_array([[t for text in texts for t in text]]), counts):
        for row, col in zip(*block.nonzero()):
            assert (first + row, classes[col]) not in got
            got[first + row, classes[col]] = block[row, col]
    assert got == want


def test_a_chunk_gets_the_counts_of_a_token_once(spark):
    """800 texts hold a word that 300 classes have: 240,000 rows of a text and a class, one row of the word for each chunk."""
    counts = spark.range(300).select(F.lit("common").alias("token"), F.col("id").cast("int").alias("intent_id"), F.lit(3).alias("cnt"))
    stats = counts.select("intent_id", F.col("intent_id").cast("string").alias("intent"), F.lit(-1.0).alias("log_prior"), F.lit(2.0).alias("log_denom"))
    rows = spark.range(800).select(F.col("id").cast("string").alias("row_key"), F.lit(2).alias("n_tok"), F.array(F.lit("common"), F.lit("rare")).alias("tokens"))
    texts, words = score._chunked(rows, "row_key", NaiveBayesModel(stats, counts, F.lit(1)))
    assert texts.count() == 800 and words.count() == 1
