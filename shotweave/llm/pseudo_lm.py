"""Masked pseudo-likelihood scoring by a bidirectional window network.

The network predicts every token from the two tokens before and the two behind it: their embeddings, weighted by
place, sum to a hidden layer (tanh), from which a class and then the token within its class are predicted (two
softmaxes of 32). A document's score is the sum of the conditional log-probabilities of all its words.

Tokens are the 767 most frequent words and 256 groups, by hash, of all others; one more stands for the text's edge. Every
word of the corpus has a probability of its own: that of its token in its place, and for a word of a group times the
word's share of the group, ``(count + 1/2) / (words + distinct words)``. The distinct words' halves that the counts leave
over are the mass of words that the corpus doesn't have; such a word counts as one of as many as the group's distinct
ones. Bounded is only what tells contexts apart, the 1,024 tokens and 16 dimensions; the counts are of all words.

Counts are a written table that grows with the corpus. Words with at least one in ``KEPT`` of all occurrences, at most
``KEPT`` words therefore, go to every task with their shares; the counts of the others reach the documents by a join.

Training covers every token of every document: each task trains a copy of the network on its
part in mini-batches (AdaGrad, from unigram frequencies as a common start), and the copies' weights are averaged
by their tokens, summed by Spark as fixed-point decimals. The weights, and thus the scores, depend on how the rows are
split into tasks.

Defined results: null and empty texts have no tokens, sum 0 and mean null; rows that repeat a doc_id, or with a null one,
are trained on and scored each; further columns are ignored; an empty table gives an empty result; texts of any length
are scored whole, their network part in blocks. Words of equal count rank by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import chunks, durable, list_array, signed, text_buffer, word_hashes

CLASSES, IN_CLASS, DIM = 32, 32, 16
VOCABULARY = CLASSES * IN_CLASS
HASHED = 256
WORDS = VOCABULARY - HASHED - 1
EDGE = VOCABULARY - 1
AROUND = (-2, -1, 1, 2)
BATCH, RATE = 8192, 0.08
FIXED = 1 << 24
KEPT = 1 << 20
TRAIN_BYTES = 2 << 20  # texts of a training step

SHAPES = {"embed": (VOCABULARY, DIM), "place": (len(AROUND), DIM), "hidden": (DIM,), "class_w": (CLASSES, DIM),
          "class_b": (CLASSES,), "word_w": (CLASSES, IN_CLASS, DIM), "word_b": (CLASSES, IN_CLASS)}


def start_weights(counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the biases are the log frequencies of the tokens."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(0, 0.1, s) if k != "place" else np.ones(s)).astype(np.float32) for k, s in SHAPES.items()}
    p = (counts + 0.5).reshape(CLASSES, IN_CLASS)
    w["class_b"] = np.log(p.sum(1) / p.sum()).astype(np.float32)
    w["word_b"] = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)
    w["hidden"][:] = 0
    return w


def token_ids(words: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Token of every word hash: its rank among the known words, else a hashed token."""
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    hashed = (WORDS + (words >> np.uint64(56))).astype(np.int16)
    if not len(known):
        return hashed
    return np.where(known[at] == words, rank[at], hashed)


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tokens around every token, a row for each place; beyond a text's ends the edge token."""
    n = len(ids)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(AROUND), n), EDGE, np.int16)
    for row, o in enumerate(AROUND):
        if n > abs(o):
            a, b = (slice(-o, n), slice(0, n + o)) if o < 0 else (slice(0, n - o), slice(o, n))
            out[row, a] = np.where(text[a] == text[b], ids[b], EDGE)
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def forward(w: dict, ids: np.ndarray, around: np.ndarray):
    """(log-probability of every token, what the backward step needs)."""
    pre = np.broadcast_to(w["hidden"], (len(ids), DIM)).copy()
    for row in range(len(AROUND)):
        pre += w["embed"][around[row]] * w["place"][row]
    h = np.tanh(pre)
    cls, own = ids >> 5, ids & 31
    by_class = _log_softmax(h @ w["class_w"].T + w["class_b"])
    logp = by_class[np.arange(len(ids)), cls]
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    inner = []
    for c in range(CLASSES):
        at = order[cut[c]:cut[c + 1]]
        p = _log_softmax(h[at] @ w["word_w"][c].T + w["word_b"][c]) if len(at) else None
        if p is not None:
            logp[at] += p[np.arange(len(at)), own[at]]
        inner.append((at, p))
    return logp, (h, cls, own, by_class, inner)


def gradients(w: dict, ids: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log-probability."""
    _, (h, cls, own, by_class, inner) = forward(w, ids, around)
    n = len(ids)
    g = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    d = -np.exp(by_class)
    d[np.arange(n), cls] += 1
    g["class_w"], g["class_b"] = d.T @ h, d.sum(0)
    dh = d @ w["class_w"]
    for c, (at, p) in enumerate(inner):
        if p is not None:
            d = -np.exp(p)
            d[np.arange(len(at)), own[at]] += 1
            g["word_w"][c], g["word_b"][c] = d.T @ h[at], d.sum(0)
            dh[at] += d @ w["word_w"][c]
    dh *= 1 - h * h
    g["hidden"] = dh.sum(0)
    for row in range(len(AROUND)):
        g["place"][row] = (dh * w["embed"][around[row]]).sum(0)
    every = around.ravel()
    back = np.concatenate([dh * w["place"][row] for row in range(len(AROUND))])
    order = np.argsort(every, kind="stable")
    rows = every[order]
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    g["embed"][rows[at]] = np.add.reduceat(back[order], at, axis=0)
    return {k: v / n for k, v in g.items()}


class Trainer:
    def __init__(self, w: dict):
        self.w = {k: v.copy() for k, v in w.items()}
        self.sq = {k: np.full(v.shape, 1e-6, np.float32) for k, v in w.items()}
        self.tokens = 0

    def learn(self, ids: np.ndarray, around: np.ndarray) -> None:
        for a in range(0, len(ids), BATCH):
            part = slice(a, a + BATCH)
            for k, g in gradients(self.w, ids[part], around[:, part]).items():
                self.sq[k] += g * g
                self.w[k] += RATE * g / np.sqrt(self.sq[k])
        self.tokens += len(ids)


def word_counts(docs: DataFrame) -> DataFrame:
    """``w long, n long``: hash and occurrences of every word of all documents, as a written table."""

    def count(batches):
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in chunks(offsets, 16 << 20):
                k, n = np.unique(word_hashes(data, offsets[i:j + 1])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n)], ["w", "n"])

    words = docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return durable(words, "words")


@dataclass
class Vocabulary:
    """``known`` hashes, sorted, with their tokens ``rank``; ``counts`` of every token; ``listed`` hashes of grouped words,
    sorted, with the logarithm of their ``share``; ``group``, the logarithm of every group's words + distinct words;
    ``limit``: grouped words of at least this count are listed."""
    known: np.ndarray
    rank: np.ndarray
    counts: np.ndarray
    listed: np.ndarray
    share: np.ndarray
    group: np.ndarray
    limit: int

    def shares(self, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logarithm of each word's share of its token, whether ``ln(count + 1/2)`` has still to be added)."""
        out, rest = np.zeros(len(words)), np.zeros(len(words), bool)
        at = np.flatnonzero(ids >= WORDS)
        own = words[at]
        place = np.searchsorted(self.listed, own)
        place[place == len(self.listed)] = 0
        found = self.listed[place] == own if len(self.listed) else np.zeros(len(own), bool)
        rest[at] = ~found
        out[at[found]] = self.share[place[found]]
        out[at[~found]] = -self.group[(own[~found] >> np.uint64(56)).astype(np.int64)]
        return out, rest


def vocabulary(words: DataFrame) -> Vocabulary:
    """Tokens and shares from the counts of all words."""
    # the top byte of a hash names its group
    groups = (words.groupBy(F.shiftrightunsigned("w", 56).alias("b"))
              .agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas())
    group_n, types = np.zeros(HASHED), np.zeros(HASHED)
    group_n[groups["b"].to_numpy(np.int64)] = groups["n"]
    types[groups["b"].to_numpy(np.int64)] = groups["types"]
    limit = max(1, -(-int(group_n.sum()) // KEPT))
    top = words.where(F.col("n") >= limit).toArrow()
    w, n = top["w"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((w, -n))
    w, n = w[order].view(np.uint64), n[order].astype(float)
    known, k = w[:WORDS], len(w[:WORDS])
    of = (w >> np.uint64(56)).astype(np.int64)
    np.subtract.at(group_n, of[:k], n[:k])
    np.subtract.at(types, of[:k], 1)
    counts = np.zeros(VOCABULARY)
    counts[:k], counts[WORDS:EDGE] = n[:k], group_n
    group = np.log(np.maximum(group_n + types, 1))
    rank, by_hash = np.argsort(known), k + np.argsort(w[k:])
    return Vocabulary(known[rank], rank.astype(np.int16), counts, w[by_hash],
                      np.log(n[by_hash] + 0.5) - group[of[by_hash]], group, limit)


def train(docs: DataFrame, known: np.ndarray, rank: np.ndarray, start: dict) -> dict[str, np.ndarray]:
    """Weights averaged over the copies that the tasks have trained."""
    shared = docs.sparkSession.sparkContext.broadcast((known, rank, start))

    def run(batches):
        words, tokens, w = shared.value
        net = Trainer(w)
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in chunks(offsets, TRAIN_BYTES):
                h, first = word_hashes(data, offsets[i:j + 1])
                ids = token_ids(h, words, tokens)
                net.learn(ids, contexts(ids, first))
        if net.tokens:
            flat = np.concatenate([net.w[k].ravel() for k in SHAPES])
            fixed = np.round(flat.astype(np.float64) * FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(fixed),
                                              pa.array(np.full(len(flat), net.tokens))], ["i", "v", "n"])

    rows = (docs.select("text").mapInArrow(run, "i int, v long, n long").groupBy("i")
            .agg(F.sum(F.col("v").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).cast("double").alias("v"),
                 F.sum("n").alias("n")).toPandas().sort_values("i"))
    if not len(rows):
        return start
    flat = (rows["v"].to_numpy() / rows["n"].to_numpy() / FIXED).astype(np.float32)
    out, at = {}, 0
    for k, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[k] = flat[at:at + size].reshape(shape)
        at += size
    return out


@dataclass
class Model:
    """``words``: the written counts of all words."""
    words: DataFrame
    vocabulary: Vocabulary
    weights: dict[str, np.ndarray]


def fit(docs: DataFrame) -> Model:
    """Counts and a network trained on every word of ``docs(text)``."""
    words = word_counts(docs)
    v = vocabulary(words)
    return Model(words, v, train(docs, v.known, v.rank, start_weights(v.counts)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens long, log_likelihood double`` (sum), ``mean_log_likelihood double`` of every row of
    ``docs(doc_id long, text)``, which may be others than the model was fitted on."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights))

    def run(batches):
        v, w = shared.value
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in chunks(offsets, 1 << 20):
                h, first = word_hashes(data, offsets[i:j + 1])
                ids = token_ids(h, v.known, v.rank)
                around = contexts(ids, first)
                logp, rest = v.shares(h, ids)
                for at in range(0, len(ids), BATCH):
                    logp[at:at + BATCH] += forward(w, ids[at:at + BATCH], around[:, at:at + BATCH])[0]
                sums = np.r_[0.0, np.cumsum(logp)]
                left = np.r_[0, np.cumsum(rest)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(np.diff(first), pa.int64()),
                     pa.array(sums[first[1:]] - sums[first[:-1]]),
                     list_array(signed(h[rest]), left[first[1:]] - left[first[:-1]], pa.int64())],
                    ["doc_id", "n_tokens", "part", "rest"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, part double, rest array<long>")
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    # no word here has more than one in KEPT of all occurrences, so none makes a hot key; sums are fixed-point, whatever their order
    rare = model.words.where(F.col("n") < model.vocabulary.limit).hint("merge")
    count = F.coalesce("n", F.lit(0)) + 0.5
    more = (rows.select("row", F.explode("rest").alias("w")).join(rare, "w", "left")
            .groupBy("row").agg(F.sum(F.round(F.log(count) * FIXED).cast("long")).alias("more")))
    total = F.col("part") + F.coalesce("more", F.lit(0)) / FIXED
    return (rows.drop("rest").join(more.hint("merge"), "row", "left")
            .select("doc_id", "n_tokens", total.alias("log_likelihood"),
                    F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Trains on all of ``docs(doc_id, text)`` and scores every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, fit(docs))
