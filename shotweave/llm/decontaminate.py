"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of word hashes (words: runs of letters, digits and non-ASCII
bytes, A-Z as a-z). The CGK embedding walks over a sequence with random steps: at step j it writes
the current word and moves on if a random bit of (j, word) is set. Sequences at a small edit distance
get embeddings at a small Hamming distance, since the walks fall into step again after an edit.
Bit-sampling LSH compares a few sampled coordinates. It is repeated with independent walks, for windows
at every word of every text and for every anchor (word offset) of every item, so any stretch of words that
an edited copy leaves alone can bring a collision. Samples are taken in order of their coordinate, and a
window leaves as soon as no item has its prefix of samples: the collisions are the same, the cost is that of the
first samples. A collision gives the item-sized window it implies, widened by the allowed edits; the
exact word edit distance between the item and the best substring of it decides.

``recall`` tells the chance that a copy with a given number of random word edits is found.

Defined results: null and empty texts, and items with fewer than ``min_words`` words, match nothing; equal
items match each on its own; rows that repeat a doc_id are compared each, and the pair's best match is
returned once; rows or items with a null id are left out; further columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import chunks, mix64, span_hashes, text_buffer, word_spans
from shotweave.llm.toxic_segments import BREAKS

#: Steps of a walk, coordinates sampled from it (the first is always 0), independent repetitions.
STEPS, SAMPLES, REPEATS = 12, 4, 5
#: A walk must have moved on by so many words at its last sample: stalled ones sample a word or two, which say nothing.
MOVES = 3
#: Words of benchmark items that one pass over the documents compares (bounds what is broadcast).
PASS_WORDS = 2_000_000
BITS = 20  # of the filter tables


def _coordinates() -> list[list[int]]:
    pick = np.random.default_rng(8)
    return [[0, *sorted((pick.choice(STEPS - 1, SAMPLES - 1, replace=False) + 1).tolist())] for _ in range(REPEATS)]


def sampled(words: np.ndarray, last: np.ndarray, at: np.ndarray, rep: int, coords: list[int], keep=None):
    """CGK walks from every start in ``at``: (starts, key of all samples). ``last``: end of the text of each start.
    ``keep[i](keys)`` tells which walks go on after sample i. Walks that leave their text drop out."""
    place, key, end = at.copy(), np.full(len(at), rep + 1, np.uint64), last
    step = 0
    for i, c in enumerate(coords):
        while step < c:
            bit = (words[place] >> np.uint64(rep * STEPS + step)) & np.uint64(1)
            place = place + bit.astype(np.int64)
            inside = place < end
            if not inside.all():
                at, place, key, end = at[inside], place[inside], key[inside], end[inside]
            step += 1
        key = mix64(key + words[place])
        if keep is not None:
            go = keep[i][(key >> np.uint64(64 - BITS)).astype(np.int64)]
            at, place, key, end = at[go], place[go], key[go], end[go]
    if len(coords) == SAMPLES:
        moved = place - at >= MOVES
        at, key = at[moved], key[moved]
    return at, key


def edit_distance_in(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance between ``item`` and any substring of ``text``; its start and end."""
    n = len(text)
    cost = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    idx = np.arange(n + 1)
    for i, w in enumerate(item.tolist(), 1):
        swap = cost[:-1] + (text != np.uint64(w))
        drop = cost[1:] + 1
        best = np.r_[i, np.minimum(swap, drop)]
        came = np.r_[0, np.where(swap <= drop, start[:-1], start[1:])]
        # insertions run along the row: cost[j] = min over k <= j of best[k] + j - k
        run = np.minimum.accumulate(best - idx)
        src = np.maximum.accumulate(np.where(best - idx == run, idx, 0))
        cost, start = run + idx, came[src]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class ItemIndex:
    """The items' anchors by LSH key, for every repetition."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, first: np.ndarray, min_words: int, max_edits: float):
        self.ids, self.words, self.first, self.max_edits = ids, words, first, max_edits
        use = np.flatnonzero(np.diff(first) >= max(min_words, 1))
        self.coords = _coordinates()
        at = np.concatenate([np.arange(first[t], first[t + 1]) for t in use]) if len(use) else np.zeros(0, np.int64)
        owner = np.repeat(use, np.diff(first)[use])
        item_of = np.zeros(len(words), np.int64)
        item_of[at] = owner
        self.vocabulary = np.zeros(1 << BITS, bool)
        self.vocabulary[(words[at] >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.tables = []
        for rep, coords in enumerate(self.coords):
            keep = []
            for i in range(len(coords)):
                _, key = sampled(words, first[owner + 1], at, rep, coords[:i + 1])
                seen = np.zeros(1 << BITS, bool)
                seen[(key >> np.uint64(64 - BITS)).astype(np.int64)] = True
                keep.append(seen)
            got, key = sampled(words, first[owner + 1], at, rep, coords)
            order = np.argsort(key, kind="stable")
            self.tables.append((keep, key[order], item_of[got[order]], got[order] - first[item_of[got[order]]]))

    def parts(self):
        return (self.ids, self.words, self.first, self.max_edits, self.vocabulary, self.coords, self.tables)


def candidates(index, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct (text, item, implied start) of all collisions of the texts' windows with the items."""
    *_, vocabulary, coords, tables = index
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # every walk samples the window's first word, so windows at words of no item collide with nothing
    at = np.flatnonzero(vocabulary[(words >> np.uint64(64 - BITS)).astype(np.int64)])
    last = first[1:][text_of[at]]
    found = []
    for rep, (keep, keys, items, offset) in enumerate(tables):
        got, key = sampled(words, last, at, rep, coords[rep], keep)
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(got)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        start = got[which] - offset[pos] - first[text_of[got[which]]]
        found.append(np.stack([text_of[got[which]], items[pos], start], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def matches(index, words: np.ndarray, first: np.ndarray):
    """(text, item, edits, first word, words) of the best verified match of each text and item."""
    ids, item_words, item_first, max_edits, *_ = index
    rows = candidates(index, words, first)
    out = []
    cut = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]) if len(rows) else []
    for a, z in zip(cut, np.r_[cut[1:], len(rows)] if len(rows) else [], strict=True):
        t, item = int(rows[a, 0]), int(rows[a, 1])
        own = item_words[item_first[item]:item_first[item + 1]]
        text = words[first[t]:first[t + 1]]
        own_set = set(own.tolist())
        allowed = int(max_edits * len(own))
        best = done = None
        for s in rows[a:z, 2].tolist():
            if done is not None and s <= done + allowed:  # the window compared last covers it
                continue
            # windows whose starts lie close are one region
            lo, hi = max(0, s - allowed), min(len(text), s + len(own) + 2 * allowed)
            done = s
            part = text[lo:hi]
            # an edit takes one distinct word of the item away at most
            if len(own_set.intersection(part.tolist())) < len(own_set) - allowed:
                continue
            d, b, e = edit_distance_in(own, part)
            if d <= allowed and (best is None or d < best[0]):
                best = (d, lo + b, e - b)
                if d == 0:
                    break
        if best:
            out.append((t, item, *best))
    return out


def text_words(column):
    data, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        starts, ends, first = word_spans(data, offsets[i:j + 1], BREAKS)
        yield i, span_hashes(data, starts, ends), first


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 8, max_edits: float = 0.2) -> DataFrame:
    """Pairs of ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` where some substring of the text is within
    ``max_edits`` word edits per item word of the item.

    Returns ``doc_id, item_id, edits long, first_word long, n_words long`` (the match's words in the text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // (6 * PASS_WORDS)))
    out = None
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) if passes > 1 else items
        # at most about PASS_WORDS words of items at a time
        rows = part.orderBy("item_id").toArrow()
        ids, pieces, first = rows.column("item_id").to_numpy(), [], [0]
        for _, words, at in text_words(rows.column("text")):
            pieces.append(words)
            first += (at[1:] + first[-1]).tolist()
        words = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        found = _search(docs, ItemIndex(ids, words, np.array(first, np.int64), min_words, max_edits))
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("edits", "first_word", "n_words")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def _search(docs: DataFrame, index: ItemIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index.parts())

    def run(batches):
        parts = shared.value
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            out = []
            for i, words, first in text_words(b.column("text")):
                out += [(int(ids[i + t]), int(parts[0][item]), d, s, n) for t, item, d, s, n in matches(parts, words, first)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "item_id", "edits", "first_word", "n_words"])

    return docs.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, n_words long")


def recall(item_words: int, edits: int, trials: int = 400, seed: int = 3) -> float:
    """Measured share of copies of random items with ``edits`` random word edits that collide somewhere."""
    rng = np.random.default_rng(seed)
    hit = 0
    for _ in range(trials):
        item = mix64(rng.integers(1, 1 << 62, item_words).astype(np.uint64))
        copy = item.tolist()
        for _ in range(edits):
            p, kind = int(rng.integers(len(copy))), rng.integers(3)
            new = int(mix64(rng.integers(1, 1 << 62, 1).astype(np.uint64))[0])
            copy[p:p + (kind != 2)] = [] if kind == 1 else [new]
        index = ItemIndex(np.array([0]), item, np.array([0, item_words]), 1, 1.0).parts()
        words = np.array(copy, np.uint64)
        hit += len(candidates(index, words, np.array([0, len(words)]))) > 0
    return hit / trials
