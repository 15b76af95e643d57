"""Substring removal against a table of all windows, the index against all places, and the parts they are made of."""

import hashlib
import random

import numpy as np
import pytest

from shotweave.llm import run_index


def windows(texts, length):
    """Places (text, start) of windows that start more than once."""
    at = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            at.setdefault(t[j:j + length], []).append((i, j))
    return {x for v in at.values() if len(v) > 1 for x in v}


def plain(texts, length):
    """(bytes, removed spans, kept bytes) of every text."""
    gone = [np.zeros(len(t), bool) for t in texts]
    for i, j in windows(texts, length):
        gone[i][j:j + length] = True
    out = []
    for t, g in zip(texts, gone, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
        out.append((len(t), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(np.frombuffer(t, np.uint8)[~g])))
    return out


def compare(spark, texts, length, **more):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, k1 int, spans string, s int")
    got = {r.doc_id: (r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept))
           for r in run_index.remove_repeats(df.repartition(5), length, **more).collect()}
    want = plain([(t or "").encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want
    return want


def corpus(rng, length, n=60, alphabet="abcdefghé漢 \0\n"):
    def text(m):
        return "".join(rng.choice(alphabet) for _ in range(m))

    passages = [text(m) for m in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = [None, "", "a", text(length), "x" * (3 * length), "xy" * (2 * length), "x" * (length + 2)]
    for _ in range(n):
        texts.append("".join(text(rng.randrange(2 * length)) + rng.choice(["", *passages]) for _ in range(3)) + text(rng.randrange(9)))
    copy = text(3 * length)
    texts += [copy] * 7 + [copy[:length] + "!" + copy[length:], copy[5:], copy[:-1], passages[4], passages[4]]
    texts += [t[:k] + "?" + t[k + 1:] for t in [text(4 * length)] * 12 for k in [rng.randrange(4 * length)]]
    return texts


@pytest.mark.parametrize("length", [24, 400])
def test_removal_equals_all_windows(spark, length):
    want = compare(spark, corpus(random.Random(length), length), length)
    assert sum(bool(s) for _, s, _ in want) > 30 and any(len(s) > 1 for _, s, _ in want)


def test_large_groups_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(run_index, "BLOCK", 700)
    levels = []
    inner = run_index.cells

    def counted(rows, length, k, width):
        levels.append(width)
        return inner(rows, length, k, width)

    monkeypatch.setattr(run_index, "cells", counted)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(70))
    texts = corpus(rng, 40, 20)
    # one passage in many surroundings, some of which two texts share
    sides = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40)]
    texts += [rng.choice(sides) + passage + rng.choice(sides) for _ in range(150)]
    compare(spark, texts, 40, )
    assert levels and levels[-1] < levels[0]


def test_long_text_meets_itself_across_blocks(spark):
    rng = random.Random(8)
    a = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    t = a + a[300_000:301_000] + a[999_000:999_399]
    df = spark.createDataFrame([(1, t), (None, "z" + a[:450]), (1, "short")], "doc_id long, text string")
    got = sorted((r.n_bytes, [tuple(x) for x in r.removed]) for r in run_index.remove_repeats(df).collect())
    assert got == [(5, []), (451, [(1, 451)]), (1_001_399, [(0, 450), (300_000, 301_000), (1_000_000, 1_001_000)])]


def test_empty_tables_and_nulls(spark):
    assert run_index.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = run_index.remove_repeats(spark.createDataFrame([(None, None), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.removed, bytes(r.kept)) for r in rows) == [(0, [], b"")] * 2


def test_anchors_cover_each_window_once_and_alike():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 5, 30, 31, 200, 90)]
    texts.append(texts[4][20:150])
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    first, m, place, g = run_index.anchors(data, off, 30, 7)
    at = {}
    for f, c, p, h in zip(first.tolist(), m.tolist(), place.tolist(), g.tolist(), strict=True):
        for w in range(f, f + c):
            assert w not in at and w <= p <= w + 23
            at[w] = (p - w, h)
    want = {off[i] + j for i, t in enumerate(texts) for j in range(len(t) - 29)}
    assert set(at) == want
    by = {}
    for w, x in at.items():
        assert by.setdefault(bytes(data[w:w + 30]), x) == x


@pytest.mark.parametrize("seed", range(8))
def test_index_equals_all_places(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(4)]
    texts = [b"".join(rng.choice(base) for _ in range(rng.randint(0, 4))) + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9)))
             for _ in range(rng.randint(1, 14))]
    data, ends = np.frombuffer(b"\1".join(texts) + b"\1", np.uint8), np.cumsum([len(t) + 1 for t in texts]) - 1
    index = run_index.RunIndex.build(data, ends)
    # the transform of the sorted suffixes, marks smallest and in the texts' order
    symbols = [s for i, t in enumerate(texts) for s in [*(b + 1000 for b in t), i]]
    order = sorted(range(len(symbols)), key=lambda p: symbols[p:])
    before = [256 + int(np.searchsorted(ends, p)) if p in index.starts else int(data[p - 1]) for p in order]
    assert np.repeat(index.heads, index.lengths).tolist() == before
    rows = np.r_[0, np.cumsum(index.lengths)]
    assert [order[i] for i in rows[:-1]] == index.first.tolist() and [order[i - 1] for i in rows[1:]] == index.last.tolist()
    found = index.statistics()
    for length in (1, 2, 5, 20):
        want = windows(texts, length)
        assert {(i, j) for i, t in enumerate(texts) for j in range(len(t)) if found[index.starts[i] + j] >= length} == want
    text, a, b = run_index.repeats(data, ends, 5)
    assert {(i, j) for i, x, y in zip(text.tolist(), a.tolist(), b.tolist(), strict=True) for j in range(x, y)} == windows(texts, 5)


def test_runs_are_few_in_repetitive_texts():
    rng = random.Random(3)
    t = bytes(rng.choice(b"abcdefgh") for _ in range(600))
    texts = [t[:i * 5] + b"z" + t[i * 5 + 1:] for i in range(100)]
    index = run_index.RunIndex.build(np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), np.cumsum([601] * 100) - 1)
    assert len(index.heads) < 0.1 * 601 * 100


def test_query_of_whole_table(spark):
    import duckdb

    from shotweave.llm.queries import op13
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = {(i, n, sum(y - x for x, y in s), len(s), hashlib.sha256(k).hexdigest())
            for (i, _), (n, s, k) in zip(rows, plain([(t or "").encode() for _, t in rows], 400), strict=True)}
    got = [tuple(r) for r in op13(spark, sf).collect()]
    assert set(got) == want and len(got) == len(rows)
