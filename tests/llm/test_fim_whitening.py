"""Fill-in-the-middle against string slices, whitening against numpy's eigenvectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotweave.llm import fim, whitening

ALPHABET = "ab<>PSM é漢😀\n"


def plain_fim(key, text, seed=1, rate=90, spm_rate=20):
    t = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in fim.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.choice((1, 2, 3, 9, 40, 300))))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "x<M>y"), (403, "<<P"), (404, "P>"), (None, "null key"), (None, "another"), (5, "again"),
             (5, "again"), (405, "é漢😀" * 1_500_000), (406, "\0\0x")]
    return rows


def test_fim_equals_slices_and_returns(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts],
                               "doc_id long, text string, form string, n int, output string")
    out = fim.restore(fim.fill_in_middle(df), to="restored")
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect()), key=repr)
    want = sorted(((i, *plain_fim(i, t), t or "") for i, t in texts), key=repr)
    assert got == want
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_fim_parameters(spark, texts):
    df = spark.createDataFrame([t for t in texts if len(t[1] or "") < 1000], "doc_id long, text string")
    rows = fim.fill_in_middle(df, seed=9, rate=100, spm_rate=100).collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) in {plain_fim(i, t, 9, 100, 100) for i, t in texts if i == r.doc_id}
               for r in rows)
    assert fim.fill_in_middle(df, rate=0).where("form != 'plain'").count() == 0


def test_fim_empty_table_and_broken_output(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.fill_in_middle(empty), to="t").count() == 0
    bad = spark.createDataFrame([("no marker", "psm")], "output string, form string")
    with pytest.raises(Exception, match="marker"):
        fim.restore(bad).collect()
    with pytest.raises(ValueError, match="already"):
        fim.restore(bad, to="form")


def test_displacements_of_empty_pieces():
    # pieces at 0 (2 bytes), 2 (none), 2 (1 byte): shifts 5, 9, -1
    assert fim.displacements(np.array([0, 2, 2]), np.array([5, 9, -1]), 3).tolist() == [5, 5, -1]


def vectors(rng, n, width):
    base = rng.standard_normal((n, width)) * np.exp(-np.arange(width) / 6)
    return base.astype(np.float32).astype(float)


def check_whitening(got, rows, want):
    """``got``: {(key, place): whitened list}; against numpy's eigenvectors of the distinct vectors."""
    x = {k: np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for k, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    for j in range(want):
        plain = {k: ((n * v - s) / n) @ q[:, j] / math.sqrt(e[j]) for k, v in x.items()}
        a, b = np.array([got[k][j] for k in plain]), np.array(list(plain.values()))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    return n, s, e, x


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    v = vectors(rng, 900, 40)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(2000 + i, v[7].tolist()) for i in range(300)]
    out = [(None, None), (3000, None), (3001, []), (3002, [None] * 40), (3003, [float("nan")] * 40), (3004, [float("-inf")] * 40)]
    df = spark.createDataFrame([(k, r, "x", 1.0) for k, r in rows + out], "vec_id long, embedding array<float>, x string, deviation double")
    model = whitening.fit_whitening(df, components=16)
    got = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    n, s, e, x = check_whitening({k: r.whitened for k, r in got.items()}, rows, 16)
    assert model.n == n == 900 and set(got) == {k for k, _ in rows}
    assert np.abs(model.explained / (e[:16] / e.sum()) - 1).max() < 1e-12 and model.identity_error < 1e-9
    assert model.residual < 1e-13
    for k, r in got.items():
        assert r.deviation == sum(int(d) ** 2 for d in n * x[k] - s)


def test_whitening_of_few_or_flat_vectors(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        model = whitening.fit_whitening(df)
        return model, whitening.whiten(df, model).collect()

    model, got = run([])
    assert model is None and got == []
    model, got = run([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [0.5, 2.0])])
    assert model.n == 1 and [(r.vec_id, r.deviation, r.whitened) for r in got] == [(1, 0, []), (1, 0, []), (None, 0, [])]
    # one direction only, so one component
    model, got = run([(i, [i / 64, 3 * i / 64, 1.0]) for i in range(5)])
    assert model.axes.shape == (3, 1) and np.allclose(sorted(r.whitened[0] for r in got), np.arange(-2, 3) / math.sqrt(2))
    # equal variances: any basis, still white
    corners = [(i, [(i >> j & 1) * 2.0 for j in range(6)]) for i in range(64)]
    model, got = run(corners)
    z = np.array([r.whitened for r in got])
    assert np.abs(z.T @ z / 64 - np.eye(6)).max() < 1e-12
    with pytest.raises(ValueError, match="entries"):
        run([(1, [1.0]), (2, [1.0, 2.0])])


def test_deviation_beyond_a_long(spark):
    rows = [(i, [1e7 * (i % 2), float(i)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df)
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(object) + 1_000_000
    exact = [sum(int(d) ** 2 for d in 3000 * v - x.sum(0)) for v in x]
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
    assert got == {i: v if v < 1 << 63 else None for i, v in enumerate(exact)}


@pytest.mark.parametrize("width, want", [(5, 16), (64, 16), (200, 16), (200, 1)])
def test_solver(width, want):
    rng = np.random.default_rng(width)
    a = rng.standard_normal((1500, width)) * np.exp(-np.arange(width) / 40)
    v = a.T @ a / len(a)
    e, q, residual = whitening.jacobi_davidson(lambda b: v @ b, width, want)
    assert len(e) == min(want, width) and residual < 1e-12
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:want], rtol=1e-12, atol=0)
    assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-13


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    away = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    rhs, theta = rng.standard_normal((30, 4)), np.array([0.3, -1.0, 2.5, 9.0])
    x = whitening.minres(lambda b: a @ b, theta, rhs, away, 60)
    p = np.eye(30) - away @ away.T
    for j in range(4):
        assert np.abs(p @ (a - theta[j] * np.eye(30)) @ p @ x[:, j] - p @ rhs[:, j]).max() < 1e-7


def test_query_columns(spark):
    from shotweave.llm.queries import op11, op12
    assert [c for c, _ in op11(spark, "/root/testdata/sf0.001").dtypes] == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    out = op12(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    top = out.agg(F.min("component"), F.max("component"), F.max("identity_error")).first()
    assert top[:2] == (1, 16) and top[2] < 1e-9
