"""Memory of tasks: rows and texts are handed on in small batches."""

import numpy as np
import pyarrow as pa
import pytest

from shotweave.llm import packing, paragraphs, parity_join
from shotweave.llm.common import chunks, give_back, small_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_chunks_of_half_a_megabyte():
    offsets = np.arange(0, (8 << 20) + 1, 4096)
    assert max(int(offsets[j] - offsets[i]) for i, j in chunks(offsets)) <= 1 << 19


def test_small_batches(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(KEY, None)
    with small_batches(spark):
        n = [r.n for r in spark.range(0, 8000, 1, 1).selectExpr("repeat('x', 3000) as text").mapInArrow(rows, "n long").collect()]
    assert sum(n) == 8000 and max(n) * 3000 <= 5 << 20
    assert spark.conf.get(KEY, None) == before


@pytest.mark.parametrize("module, step, run", [(paragraphs, "paragraph_rows", paragraphs.paragraph_dedup),
                                               (parity_join, "sketch_rows", parity_join.ngram_jaccard_join)])
def test_joins_of_texts_use_small_batches(spark, monkeypatch, module, step, run):
    seen, inner = [], getattr(module, step)

    def noted(*args):
        seen.append(spark.conf.get(KEY, None))
        return inner(*args)

    monkeypatch.setattr(module, step, noted)
    words = " ".join(f"w{i}" for i in range(40))
    run(spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string")).collect()
    assert seen == [str(4 << 20)]


def test_encoder_stays_for_packing_only(monkeypatch):
    monkeypatch.setattr(packing, "PieceEncoder", lambda path: object())
    first = packing._worker_encoder("a")
    give_back("encoders")
    assert packing._worker_encoder("a") is first
    give_back()
    assert packing._worker_encoder("a") is not first
    give_back()
