"""Near-duplicate paragraphs and repeated passages (substring dedup) by MinHash banding and winnowed windows.

A paragraph is a line of ``text`` (cut at ``\\n``) of ``min_words`` words or more, or a block of the words of
consecutive shorter lines: these are joined and cut anew where a word 5-gram's hash is the least within
``min_words`` words on both sides, so that equal passages are cut alike however they are laid out. Its set
holds the distinct word 5-grams. MinHash signatures are cut into bands; the number of
rows per band is tuned so that a pair at the threshold collides with at least the wanted
recall (0.999 by default: 16 bands of 3 rows). Paragraphs that collide are joined, exact
Jaccard decides, and components of the links are the classes: the first occurrence (by
doc_id, then place) stays, every other one is marked for removal.

Passages that start or end inside a paragraph are found by windows of ``min_words`` words over each text's whole word
sequence, whatever its lines. A window starts at the 5-gram of the least hash of each ``passage - min_words + 1``
consecutive ones (winnowing): any ``passage`` words that two places have in common hold a window that both
have, so every such passage gets a class. Equal windows are a class. A window is given where it says more than
the paragraph that it lies in: not in a removed paragraph, and not where both stay. Of windows of one text that
overlap the class's first occurrence only that one counts. Inside longer paragraphs an edited copy is found by
its unedited runs of ``passage`` words; up to ``passage - min_words`` words at a passage's ends may lie outside its windows.

Defined results: null and empty texts have no paragraphs; equal sets are one node however
many occurrences they have; rows with a null doc_id are left out; rows that repeat a doc_id
count each occurrence, and the smallest ``(doc_id, para, first_word)`` stays, in all its rows; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import (BROADCAST_ROWS, chunks, durable, few, give_back, mix64, semi_join, shingles, signed, small_batches,
                                  text_buffer, word_hashes)
from shotweave.llm.graph import linked_components
from shotweave.llm.parity_join import SEEN, _lists, parity_sketch, set_keys, shared_tokens

SCHEMA = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("para", pa.int64()), ("first_word", pa.int64()),
                    ("n_words", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("tokens", pa.list_(pa.int64())),
                    ("sketch", pa.list_(pa.int64()))])
DDL = ("doc_id long, t long, para long, first_word long, n_words long, n long, k1 long, k2 long, tokens array<long>, "
       "sketch array<long>")
WINDOW_DDL = "doc_id long, t long, para long, first_word long, unit long, k1 long, k2 long"


def tune_bands(percent: int, recall: float = 0.999, hashes: int = 48) -> tuple[int, int]:
    """(bands, rows): the most selective banding of ``hashes`` whose recall at the threshold is high enough."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if 1 - (1 - (percent / 100) ** rows) ** bands >= recall:
            best = (bands, rows)
    return best


def paragraph_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph offsets, text of each paragraph, line index of each) for the lines of some texts."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    cuts = np.flatnonzero(data[lo:hi] == 10) + lo + 1
    starts = np.union1d(cuts, offsets[:-1][np.diff(offsets) > 0])
    starts = starts[starts < hi]
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets[:-1])
    # a line break ends a line, also where the text ends with it
    return np.append(starts, hi), text, np.arange(len(starts)) - first[text]


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words, also across texts."""
    return shingles(words, np.array([0, len(words)]), k)[0] if len(words) >= k else np.zeros(0, np.uint64)


def block_cuts(run: np.ndarray, radius: int) -> np.ndarray:
    """Places where ``run`` has its least value within ``radius`` on both sides; more than ``radius`` apart."""
    if len(run) <= 2 * radius:
        return np.zeros(0, np.int64)
    return np.flatnonzero(sliding_window_view(run, 2 * radius + 1).argmin(1) == radius) + radius


def spans(column, min_words: int, k: int):
    """For each chunk of an Arrow column: (first row, words, hashes of their runs, first word of each text, lines as (text, index,
    first word), paragraphs as (line's place among these, first word, end))."""
    data, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        par, text, line = paragraph_offsets(data, offsets[i:j + 1])
        if not len(text):
            continue
        words, first = word_hashes(data, par)
        run = _runs(words, k)
        short = np.diff(first) < min_words
        head = np.flatnonzero(np.r_[True, ~short[1:] | ~short[:-1] | (text[1:] != text[:-1])])
        units = []
        for h, a, b in zip(head.tolist(), first[head].tolist(), first[np.r_[head[1:], len(text)]].tolist(), strict=True):
            if b - a < min_words:
                continue
            cuts = (block_cuts(run[a:b - k + 1], min_words) + a).tolist() if short[h] else []
            units += zip([h, *(np.searchsorted(first, cuts, "right") - 1).tolist()], [a, *cuts], [*cuts, b], strict=True)
        bounds = np.r_[first[np.searchsorted(text, np.arange(j - i))], len(words)]
        yield i, words, run, bounds, (text, line, first), units


def each_paragraph(column, min_words: int, k: int):
    """(row, line, first word, words, distinct sorted shingles) of every paragraph of an Arrow column."""
    for i, words, run, bounds, (text, line, _), units in spans(column, min_words, k):
        for at, a, b in units:
            items = run[a:b - k + 1] if b - a >= k else shingles(words[a:b], np.array([0, b - a]), k)[0]
            yield i + int(text[at]), int(line[at]), a - int(bounds[text[at]]), b - a, np.unique(items)


def window_places(run: np.ndarray, bounds: np.ndarray, size: int, passage: int, k: int) -> np.ndarray:
    """Where windows of ``size`` words start: the least hash of each ``passage - size + 1`` consecutive ones of a text,
    if so many words follow."""
    width = passage - size + 1
    if len(run) < width:
        return np.zeros(0, np.int64)
    at = np.arange(len(run) - width + 1)
    end = np.repeat(bounds[1:], np.diff(bounds))
    least = at + sliding_window_view(run, width).argmin(1)
    places = np.unique(least[at + width + k - 1 <= end[at]])
    return places[places + size <= end[places]]


def window_rows(docs: DataFrame, size: int, passage: int, k: int) -> DataFrame:
    """The windows of all texts; ``unit``: first word of the paragraph that the window lies in, -1 where it lies in none."""
    mult = mix64(np.arange(1, 2 * size + 1, dtype=np.uint64)) | np.uint64(1)

    def run_batches(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            keys = b.column("t").to_numpy(zero_copy_only=False)
            for i, words, run, bounds, (_, line, first), units in spans(b.column("text"), size, k):
                at = window_places(run, bounds, size, passage, k)
                x, y = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                for w in range(size):
                    x += words[at + w] * mult[w]
                    y += mix64(words[at + w]) * mult[size + w]
                own = np.searchsorted(bounds, at, "right") - 1
                edge = np.array([(u, v) for _, u, v in units], np.int64).reshape(-1, 2)
                u = np.searchsorted(edge[:, 0], at, "right") - 1
                inside = (u >= 0) & (at + size <= np.r_[edge[:, 1], 0][u])
                unit = np.where(inside, np.r_[edge[:, 0], 0][u] - bounds[own], -1)
                place = line[np.searchsorted(first, at, "right") - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (ids[i + own], keys[i + own], place, at - bounds[own], unit,
                                                       signed(mix64(x)), signed(mix64(y)))],
                    ["doc_id", "t", "para", "first_word", "unit", "k1", "k2"])
        give_back()

    return docs.mapInArrow(run_batches, WINDOW_DDL)


def band_tokens(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """The band hashes (a row for each set) of MinHash signatures of ``bands * rows`` hash functions."""
    flat = np.concatenate(sets)
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    mult = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            h = flat * mult[b * rows + r]
            h ^= h >> np.uint64(32)
            acc = mix64(acc + np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), at))
        out[:, b] = acc
    return out


def paragraph_rows(docs: DataFrame, min_words: int, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        seen: set = set()
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            texts = b.column("t").to_numpy(zero_copy_only=False)
            found = each_paragraph(b.column("text"), min_words, k)
            while part := list(islice(found, 4096)):
                keys = [set_keys(s) for *_, s in part]
                new = []
                for key in keys:
                    if len(seen) > SEEN:
                        seen.clear()
                    new.append(key not in seen)
                    seen.add(key)
                fresh = [s for (*_, s), f in zip(part, new, strict=True) if f]
                tokens = iter(band_tokens(fresh, bands, rows) if fresh else ())
                none = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(ids[p[0]]) for p in part], pa.int64()), pa.array([int(texts[p[0]]) for p in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([p[3] for p in part], pa.int64()), pa.array([len(p[4]) for p in part], pa.int64()),
                    pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()),
                    _lists([signed(next(tokens)) if f else none for f in new]),
                    _lists([parity_sketch(p[4]) if f else none for p, f in zip(part, new, strict=True)])], schema=SCHEMA)
        seen.clear()
        give_back()

    return docs.mapInArrow(run, DDL)


def paragraph_sets(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """``(node, items)`` of the paragraphs of the given documents."""

    def run(batches):
        for b in batches:
            found = (s for *_, s in each_paragraph(b.column("text"), min_words, k))
            while part := list(islice(found, 4096)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["%d:%d" % set_keys(s) for s in part], pa.string()), _lists([signed(s) for s in part])],
                    ["node", "items"])

    return docs.select("text").mapInArrow(run, "node string, items array<long>")


def paragraph_dedup(docs: DataFrame, min_words: int = 30, shingle: int = 5, percent: int = 75,
                    recall: float = 0.999, passage: int = 50) -> DataFrame:
    """Every occurrence of a paragraph that has a near copy, and of a window of a repeated passage, of ``docs(doc_id, text)``.

    Returns ``doc_id, para long`` (index of the line it starts in), ``first_word long`` (index in the text), ``n_words long,
    class_doc_id long, class_para long, class_first_word long`` (the class's first occurrence), ``class_size long``
    (occurrences) and ``removed boolean``."""
    with small_batches(docs.sparkSession):
        return _paragraph_dedup(docs, min_words, shingle, percent, recall, passage)


def _paragraph_dedup(docs: DataFrame, min_words: int, shingle: int, percent: int, recall: float, passage: int) -> DataFrame:
    docs = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .where("doc_id is not null").withColumn("t", F.xxhash64("text")))
    bands, rows_per = tune_bands(percent, recall)
    rows = durable(paragraph_rows(docs, min_words, shingle, bands, rows_per), "paragraphs")
    at = F.struct("doc_id", "para", "first_word")
    reps = durable(rows.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.count("*").alias("size"))
                   .withColumn("node", F.concat_ws(":", "k1", "k2")), "reps")
    tokens = rows.select(F.explode("tokens").alias("token"), F.col("k1").alias("k"), "n")
    shared = durable(shared_tokens(tokens).join(reps.select(F.col("k1").alias("k"), "node"), "k")
                     .select("token", "node", "n"), "shared")
    near = durable(shared.select("node").distinct(), "nodes")
    named = durable(reps.join(few(near), "node", "left_semi"), "named")
    sketches = durable(rows.where("size(sketch) > 0").select("k1", "k2", "sketch")
                       .join(named.select("k1", "k2", "node"), ["k1", "k2"])
                       .groupBy("node").agg(F.first("sketch").alias("sketch")), "parities")

    def sets_of(ids):
        ids = few(ids)
        wanted = durable(named.join(ids, "node").select(F.col("at.doc_id").alias("doc_id")).distinct(), "wanted")
        return (paragraph_sets(semi_join(docs, wanted, "doc_id"), min_words, shingle)
                .join(ids, "node", "left_semi").dropDuplicates(["node"]))

    label, _ = linked_components(shared, sketches, sets_of, percent)
    named = reps.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    total = named.groupBy("label").agg(F.min("at").alias("first"), F.sum("size").alias("class_size")).where("class_size > 1")
    classes = durable(named.join(total, "label").select("k1", "k2", "first", "class_size"), "classes")
    marked = durable(rows.join(classes, ["k1", "k2"]).withColumn("removed", at != F.col("first")).select(
        "doc_id", "t", "para", "first_word", "n_words", "first", "class_size", "removed"), "marked")
    windows = _window_classes(docs, marked, min_words, max(passage, min_words), shingle)
    return marked.select(windows.columns).unionByName(windows).select(
        "doc_id", "para", "first_word", "n_words", F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.para").alias("class_para"), F.col("first.first_word").alias("class_first_word"), "class_size", "removed")


def _window_classes(docs: DataFrame, marked: DataFrame, size: int, passage: int, k: int) -> DataFrame:
    """Windows that several places have, where they say more than the ``marked`` paragraph that they lie in."""
    at = F.struct("doc_id", "para", "first_word")
    rows = durable(window_rows(docs, size, passage, k), "windows")
    some = durable(rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "para", "first_word", "t")).alias("low"), F.count("*").alias("c"))
                   .where("c > 1").select("k1", "k2", "low"), "repeated")

    def of(big, small):
        return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, ["k1", "k2"])

    apart = F.col("first_word") - F.col("low.first_word")
    overlaps = (F.col("doc_id") == F.col("low.doc_id")) & (F.col("t") == F.col("low.t")) & (apart > 0) & (apart < size)
    rows = durable(of(rows, some).where(~overlaps), "places")
    total = durable(rows.groupBy("k1", "k2").agg(F.count("*").alias("class_size")).where("class_size > 1"), "sizes")
    rows = (of(rows, total).withColumn("first", F.struct("low.doc_id", "low.para", "low.first_word"))
            .withColumn("removed", at != F.col("first")))
    around = marked.select("doc_id", "t", F.col("first_word").alias("unit"), F.col("removed").alias("gone")).distinct()
    return (rows.join(around, ["doc_id", "t", "unit"], "left").where("gone is null or (removed and not gone)")
            .select("doc_id", "para", "first_word", F.lit(size).cast("long").alias("n_words"), "first", "class_size", "removed"))
