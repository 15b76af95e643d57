"""Toxic passages by maximum-scoring segments.

Every word has a log-odds weight: its rate in toxic against clean labelled documents under a
Dirichlet prior centred on its parent's odds. A word's parent is its 5-byte prefix, whose parent is
its 4-byte prefix, whose parent is even odds; so an unseen word inherits the odds of its stem. Less
a fixed drift, ordinary words score below zero. One linear scan per text finds all maximal scoring
segments. Under clean text the best score of m words follows an extreme-value law,
P(S > x) = 1 - exp(-K m exp(-lambda x)); lambda solves sum(p(s) exp(lambda s)) = 1 over the clean
word scores and K is fitted to clean documents. A passage counts if its expected number in clean
text, E = K m exp(-lambda S), is at most ``max_e``. A document's evidence adds -ln E of its
passages (of its best segment if none counts); an isotonic fit on the labelled documents turns it
into a score from 0 to 1.

The labelled rows used for fitting are bounded by ``max_labelled`` (a share of them, chosen by hash of
the id, where there are more), and by that the vocabulary: every word and prefix that toxic ones of them hold three times or
more; rarer words have the odds of their stem. All documents are scored whole, and fitted and scored by the same evidence.

Defined results: null and empty texts hold no passage and get the score of no evidence; labels that
are null count as missing, repeated labels of a doc_id as their maximum; without toxic or without
clean labels every score is the smoothed share of toxic labels; rows that repeat a doc_id, or with a
null one, are scored each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import chunks, durable, give_back, list_array, mix64, signed, span_hashes, text_buffer, word_spans

#: Bytes that end a word: all of ASCII but letters and digits.
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False
PREFIXES = (4, 5)
KAPPA, DRIFT, CLIP = 4.0, 0.5, 8.0
FLOOR = -20.0
BITMAP = 22  # bits of the hash that the look-up filter uses


@dataclass
class SegmentModel:
    keys: np.ndarray  # sorted hashes
    weights: np.ndarray  # log-odds less drift
    lam: float
    k: float
    at: np.ndarray  # evidence of the isotonic steps
    rate: np.ndarray  # score there
    max_e: float


def word_keys(data: np.ndarray, offsets: np.ndarray):
    """(first word of each text and the total, hash of every word, then of its prefixes; 0 where a word is no longer
    than the prefix)."""
    starts, ends, first = word_spans(data, offsets, BREAKS)
    keys = [span_hashes(data, starts, ends)]
    for size in PREFIXES[::-1]:
        longer = ends - starts > size
        h = np.zeros(len(starts), np.uint64)
        if longer.any():
            h[longer] = mix64(span_hashes(data, starts[longer], starts[longer] + size) + np.uint64(size))
        keys.append(h)
    return first, keys


def _look_up(model_keys: np.ndarray, seen: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``keys``, places in the model) of the keys that the model holds."""
    may = np.flatnonzero(seen[(keys & np.uint64((1 << BITMAP) - 1)).astype(np.int64)])
    at = np.searchsorted(model_keys, keys[may])
    at[at == len(model_keys)] = 0
    ok = model_keys[at] == keys[may] if len(model_keys) else np.zeros(len(may), bool)
    return may[ok], at[ok]


def bitmap(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << BITMAP, bool)
    seen[(keys & np.uint64((1 << BITMAP) - 1)).astype(np.int64)] = True
    return seen


def word_scores(model_keys, weights, seen, data, offsets):
    """(first word of each text, score of every word): the most specific known key decides."""
    first, keys = word_keys(data, offsets)
    score = np.full(len(keys[0]), -DRIFT)
    for level in keys[::-1]:
        place, at = _look_up(model_keys, seen, level)
        score[place] = weights[at]
    return first, score


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) by one linear scan over runs of positive words and the gaps
    between them."""
    up = score > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, up, False].astype(np.int8)))
    sums = np.r_[0.0, np.cumsum(score)]
    stack: list[list] = []  # [start, end, total before, total after]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        new = [a, b, float(sums[a]), float(sums[b])]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new.append(j)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def _training(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of the labelled rows; the labels' side is bounded by ``max_labelled`` and broadcast."""
    labels = (labels.where("doc_id is not null and toxic is not null")
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n = labels.count()
    if n > max_labelled:
        share = int((1 << 62) * (0.98 * max_labelled / n))
        labels = labels.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) < share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(labels), "doc_id").select("text", "toxic")


def _toxic_keys(train: DataFrame):
    """(hash, parent's hash, count) of the words and prefixes that toxic documents hold three times or more, and
    the number of toxic words."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in chunks(offsets):
                _, (word, p5, p4) = word_keys(data, offsets[i:j + 1])
                parent = np.where(p5 != 0, p5, p4)
                key = np.concatenate([word, p5[p5 != 0], p4[p4 != 0]])
                par = np.concatenate([parent, p4[p5 != 0], np.zeros((p4 != 0).sum(), np.uint64)])
                k, at, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[signed(k), 0]), pa.array(np.r_[signed(par[at]), 0]), pa.array(np.r_[n, len(word)])],
                    ["key", "parent", "n"])

    rows = (train.where("toxic = 1").select("text").mapInArrow(run, "key long, parent long, n long")
            .groupBy("key").agg(F.max("parent").alias("parent"), F.sum("n").alias("n")).where("n >= 3 or key = 0").toPandas())
    zero = rows["key"] == 0
    rest = rows[~zero]
    return (rest["key"].to_numpy(np.int64).view(np.uint64), rest["parent"].to_numpy(np.int64).view(np.uint64),
            rest["n"].to_numpy(float), float(rows["n"][zero].sum()))


def _clean_counts(train: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, float]:
    """How often clean documents hold each key, and the number of clean words."""
    shared = train.sparkSession.sparkContext.broadcast((keys, bitmap(keys)))

    def run(batches):
        table, seen = shared.value
        count, words = np.zeros(len(table), np.int64), 0
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in chunks(offsets):
                _, levels = word_keys(data, offsets[i:j + 1])
                words += len(levels[0])
                for level in levels:
                    count += np.bincount(_look_up(table, seen, level)[1], minlength=len(table))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[count[some], words])], ["i", "n"])

    rows = train.where("toxic = 0").select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(keys))
    real = rows["i"] >= 0
    out[rows["i"][real].to_numpy(np.int64)] = rows["n"][real]
    return out, float(rows["n"][~real].sum())


def _odds(keys, parent, n1, n0, total1, total0):
    """Smoothed odds of every key; prefixes first, as they are their words' priors."""
    scale = total1 / max(total0, 1.0)
    rho = np.ones(len(keys))
    done = np.zeros(len(keys), bool)
    for _ in range(3):  # 4-byte prefixes and short words, 5-byte prefixes and 5-byte words, longer words
        at = np.searchsorted(keys, parent)
        at[at == len(keys)] = 0
        known = (parent != 0) & (keys[at] == parent)
        prior = np.where(known, rho[at], 1.0)
        ready = ~done & (~known | done[at])
        rho[ready] = (n1[ready] + KAPPA * prior[ready]) / (n0[ready] * scale + KAPPA)
        done |= ready
    return rho


def fit_segments(docs: DataFrame, labels: DataFrame, max_labelled: int = 200_000, max_e: float = 0.05) -> SegmentModel:
    """The model of ``labels(doc_id, toxic)`` over ``docs(doc_id, text)``."""
    train = _training(docs, labels, max_labelled)
    keys, parent, n1, total1 = _toxic_keys(train)
    order = np.argsort(keys)
    keys, parent, n1 = keys[order], parent[order], n1[order]
    n0, total0 = _clean_counts(train, keys)
    weights = np.minimum(np.log(_odds(keys, parent, n1, n0, total1, total0)) - DRIFT, CLIP)
    shared = docs.sparkSession.sparkContext.broadcast((keys, weights, bitmap(keys)))

    def run(batches):
        table, w, seen = shared.value
        give_back()  # what the steps before have left here
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(b.column("text"))
            best, size, parts, hist = [], [], [], []
            for i, j in chunks(offsets):
                first, score = word_scores(table, w, seen, data, offsets[i:j + 1])
                for t in range(j - i):
                    s = score[first[t]:first[t + 1]]
                    parts.append(np.array([x[2] for x in maximal_segments(s)]))
                    best.append(parts[-1].max(initial=0.0))
                    size.append(len(s))
                    up = np.round(s[s > 0] * 10).astype(np.int64)
                    hist.append(np.r_[len(s) - len(up), np.bincount(up, minlength=int(CLIP * 10) + 1)])
            both = [h for h, t in zip(hist, toxic, strict=True) if t == 0]
            total = np.sum(both, axis=0) if both else np.zeros(int(CLIP * 10) + 2, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(size, pa.int64()), pa.array(best, pa.float64()),
                 list_array(np.concatenate(parts) if parts else np.zeros(0), np.array([len(p) for p in parts], np.int64), pa.float64()),
                 pa.array([total.tolist()] + [None] * (len(size) - 1) if size else [], pa.list_(pa.int64()))],
                ["toxic", "m", "best", "found", "hist"])
        give_back()

    # a row for each labelled document with all its segments; what the driver gets of each is a few numbers
    fitted = durable(train.mapInArrow(run, "toxic int, m long, best double, found array<double>, hist array<long>"), "segments")
    rows = fitted.select("toxic", "m", "best", "hist").toPandas()
    hists = [np.asarray(h) for h in rows["hist"] if h is not None]
    lam = _lambda(np.sum(hists, axis=0) if hists else np.zeros(1))
    m = np.maximum(rows["m"].to_numpy(float), 1)
    best = rows["best"].to_numpy(float)
    clean = (rows["toxic"] == 0).to_numpy()
    k = float(clean.sum() / max((m[clean] * np.exp(-lam * best[clean])).sum(), 1e-9)) if clean.any() else 1.0
    k = min(max(k, 1e-9), 1.0)

    def evidence(batches):
        for b in batches:
            found, size = b.column("found"), b.column("m").to_pylist()
            x = [_evidence(found[i].values.to_numpy(), n, lam, k, max_e) for i, n in enumerate(size)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.float64())], ["toxic", "x"])

    rows = fitted.select("toxic", "m", "found").mapInArrow(evidence, "toxic int, x double").toPandas()
    at, rate = _isotonic(rows["x"].to_numpy(float), (rows["toxic"] != 0).to_numpy())
    return SegmentModel(keys, weights, lam, k, at, rate, max_e)


def _lambda(hist: np.ndarray) -> float:
    """The positive root of sum(p(s) exp(lambda s)) = 1 over clean word scores; 1 where none is positive."""
    total = hist.sum()
    if total == 0 or hist[1:].sum() == 0:
        return 1.0
    p = hist / total
    s = np.r_[-DRIFT, np.arange(len(hist) - 1) / 10]
    lo, hi = 0.0, 1.0
    for _ in range(60):
        if (p * np.exp(hi * s)).sum() > 1:
            break
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, hi)
    return max(hi, 0.05)


def _evidence(scores: np.ndarray, m: int, lam: float, k: float, max_e: float) -> float:
    if not len(scores):
        return FLOOR
    minus = lam * scores - np.log(k * max(m, 1))
    sure = minus[minus >= -np.log(max_e)]
    return float(max(sure.sum() if len(sure) else minus.max(), FLOOR + 1))


def _isotonic(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone share of toxic labels along the evidence, pooled from equal values, smoothed by half a label of each."""
    if not len(x):
        return np.array([0.0]), np.array([0.0])
    base = (toxic.sum() + 0.5) / (len(x) + 1)
    if not toxic.any() or toxic.all():
        return np.array([0.0]), np.array([base])
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order].tolist(), toxic[order].tolist(), strict=True):
        blocks.append([v, v, float(t), 1.0])
        while len(blocks) > 1 and (blocks[-2][1] == blocks[-1][0] or blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    at, rate = [], []
    for lo, hi, t, n in blocks:
        r = (t + base) / (n + 1)
        at += [lo, hi + 1e-9]
        rate += [r, r]
    return np.array(at), np.maximum.accumulate(np.array(rate))


def score_toxicity(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """``doc_id, score double, passages array<struct<first_word, end_word, score, e>>`` of every row: the passages are
    the segments with E of at most ``max_e``, as ranges of words."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.keys, model.weights, model.lam, model.k, model.at, model.rate, model.max_e, bitmap(model.keys)))

    def run(batches):
        keys, weights, lam, k, at, rate, max_e, seen = shared.value
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            scores, passages = [], []
            for i, j in chunks(offsets):
                first, score = word_scores(keys, weights, seen, data, offsets[i:j + 1])
                any_up = np.add.reduceat(np.r_[score > 0, False], np.minimum(first[:-1], len(score))) > 0 if j > i else []
                for t in range(j - i):
                    s = score[first[t]:first[t + 1]]
                    found = maximal_segments(s) if len(s) and any_up[t] else []
                    x = _evidence(np.array([f[2] for f in found]), len(s), lam, k, max_e)
                    # ties within a step of the fit keep their order of evidence
                    scores.append(min(1.0, max(0.0, float(np.interp(x, at, rate)) + 1e-6 * np.tanh(x / 100))))
                    e = [(a, z, v, float(k * len(s) * np.exp(-lam * v))) for a, z, v in found]
                    passages.append([{"first_word": a, "end_word": z, "score": v, "e": q} for a, z, v, q in e if q <= max_e])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(pa.struct(
                    [("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("e", pa.float64())])))],
                ["doc_id", "score", "passages"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, passages array<struct<first_word:long,end_word:long,score:double,e:double>>")


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
