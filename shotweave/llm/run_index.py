"""Repeated substrings by run-length indexes.

A string of ``length`` bytes (a window) that starts at two places of a corpus makes every byte of both removable. Windows
that are equal meet like this. The smallest hash of the ``k``-byte strings in a window, the leftmost if several are
smallest, is its anchor; equal windows have equal anchors at equal distances. Neighbouring windows with the same anchor form a
hull, so every window stands in exactly one hull, and equal windows in hulls of one group, that of the anchor's hash.
Per group, counts by partial aggregation tell three cases apart: a single hull holds nothing; equal hulls repeat as a
whole; different hulls go, each once, to an index.

The index covers a block of whole groups. Their hulls, each with an end mark of its own, are sorted by suffix; of the
Burrows-Wheeler transform the runs are kept and the text positions at both ends of each run, with the common prefix
across the border (long repeats make few runs). Inside a run, a suffix's longest match with its sorted neighbours is one
byte shorter than that of the suffix before it in the text. So matching statistics, the length of the longest other
match at each place, stream over the texts from the samples alone; windows whose match reaches ``length`` are repeats.

Groups over ``BLOCK`` bytes of different hulls (a passage in many surroundings) are dealt anew, for as long as there are
any: a group's windows are split by their distance to the anchor into cells an eighth as wide, and by what all
windows of a cell share, which equal windows share too. At width one, equal windows are all that is left of a group. No
group is cut short and no pairs are formed.

Texts are known by two 64-bit hashes, hulls by a 128-bit one. Defined results: a null text counts as empty; texts below
``length`` bytes lose nothing; rows that repeat a text of ``length`` bytes or more lose all of it, whatever their key, null or
repeated; a match may overlap itself; further columns are left out; an empty table gives an empty result. A long text is
read in blocks, and only its spans are held whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import (BROADCAST_ROWS, chunks, durable, list_array, mix64, rolling_hashes, semi_join, signed,
                                  text_buffer)

#: Bytes of hulls in an index, at most twice as many; bytes of text scanned at once (below 2 ** PLACE_BITS with a window).
BLOCK = 1 << 19
SCAN = 1 << 19
PLACE_BITS = 21
#: By which factor the cells of a group that is dealt anew get narrower.
SPLIT = 8
#: Text keys that a task remembers, to scan copies once; forgetting costs time only.
SEEN = 100_000


def anchors(data: np.ndarray, off: np.ndarray, length: int, k: int):
    """Hulls of the texts ``data[off[i]:off[i + 1]]``: (first window, number of windows, place of the anchor, its hash), places
    in ``data``, in rising order."""
    out = [[], [], [], []]
    windows = length - k + 1  # k-byte strings in a window
    size = (1 << PLACE_BITS) - length
    for i, j in chunks(off, SCAN):
        for lo in range(int(off[i]), int(off[j]), size):  # more than one step in a long text only
            hi = min(lo + size + length - 1, int(off[j]))
            if hi - lo < length:
                continue
            full = rolling_hashes(data[lo:hi], k)
            low = (full >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(full), dtype=np.uint64)
            width = 1
            while 2 * width <= windows:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < windows:
                low = np.minimum(low[:len(low) - windows + width], low[windows - width:])
            place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            inside = np.zeros(len(place) + 1, np.int32)
            a = np.clip(off[i:j] - lo, 0, len(place))
            b = np.clip(off[i + 1:j + 1] - length + 1 - lo, a, len(place))
            np.add.at(inside, a, 1)
            np.add.at(inside, b, -1)
            inside = np.cumsum(inside)[:-1] > 0
            new = inside.copy()
            new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
            last = inside.copy()
            last[:-1] &= ~inside[1:] | (place[1:] != place[:-1])
            first = np.flatnonzero(new)
            out[0].append(first + lo)
            out[1].append(np.flatnonzero(last) + 1 - first)
            out[2].append(place[first] + lo)
            out[3].append(full[place[first]])
    if not out[0]:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in out)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of spans, as two longs."""
    view = memoryview(np.ascontiguousarray(data))
    joined = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of ``data``, whose texts end (with a place for a mark) at ``ends``; marks are smaller than bytes, and
    earlier ones smaller than later ones. Prefix doubling on the unsorted rest."""
    n = len(data)
    symbol = data.astype(np.int64) + 1
    symbol[ends] = 0
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for j in range(7):
        s = np.zeros(n, np.int64)
        s[:max(n - j, 0)] = symbol[j:]
        key = key << 9 | np.where(alive, s, 0)
        alive &= s != 0
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]] | (key & 511 == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    single = head & np.r_[head[1:], True]
    open_ = np.flatnonzero(~single)
    h = 7
    while len(open_):
        at = order[open_]
        key = rank[at] * n + rank[at + h]  # no mark within h symbols, or it would be sorted
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        head = np.r_[True, key[1:] != key[:-1]]
        rank[at] = open_[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        open_ = open_[~(head & np.r_[head[1:], True])]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of ``data[a:]`` and ``data[b:]``, at most ``most`` each; 8 bytes a step."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = np.zeros(len(a), np.int64)
    left = np.flatnonzero(most > 0)
    while len(left):
        x = words[a[left] + out[left]] ^ words[b[left] + out[left]]
        same = x == 0
        rest = left[~same]
        bit = x[~same]
        bit &= ~bit + np.uint64(1)  # lowest set bit
        out[rest] += np.log2(bit.astype(float)).astype(np.int64) >> 3
        left = left[same]
        out[left] += 8
        left = left[out[left] < most[left]]
    return np.minimum(out, most)


@dataclass
class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a list of texts with samples at the runs' ends."""

    starts: np.ndarray  # of the texts
    ends: np.ndarray  # places of their marks
    heads: np.ndarray  # symbol of each run; the mark of text i is 256 + i
    lengths: np.ndarray  # of the runs
    first: np.ndarray  # text position at each run's first row
    last: np.ndarray  # ... and at its last one
    border: np.ndarray  # common prefix of each run's first row and the row before; 0 for the first run and after the last

    @classmethod
    def build(cls, data: np.ndarray, ends: np.ndarray) -> RunIndex:
        """Of texts ``data[ends[i - 1] + 1:ends[i]]``; what stands at ``ends`` is no part of them."""
        starts = np.r_[0, ends[:-1] + 1]
        order = suffix_order(data, ends)
        before = data[order - 1].astype(np.int64)
        opening = np.zeros(len(data), np.int64)
        opening[starts] = 256 + np.arange(len(ends))
        before = np.where(opening[order] > 0, opening[order], before)
        at = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        rest = np.repeat(ends, ends - starts + 1) - np.arange(len(data))  # bytes to the mark
        a, b = order[at[1:] - 1], order[at[1:]]
        border = np.r_[0, common_prefixes(data, a, b, np.minimum(rest[a], rest[b])), 0]
        return cls(starts, ends, before[at], np.diff(np.r_[at, len(data)]), order[at], np.r_[a, order[-1]], border)

    def statistics(self) -> np.ndarray:
        """For every place of the texts, the length of the longest string from there that starts elsewhere too."""
        n = int(self.ends[-1]) + 1
        out = np.zeros(n, np.int64)
        for places, value in ((self.first, self.border[:-1]), (self.last, self.border[1:])):
            reach = np.zeros(n, np.int64)
            reach[places] = places + value
            np.maximum(out, np.maximum.accumulate(reach) - np.arange(n), out=out)
        return out


def repeats(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, end) of all runs of places where a string of ``length`` bytes starts that starts elsewhere too."""
    found = RunIndex.build(data, ends).statistics() >= length
    edge = np.flatnonzero(np.diff(np.r_[False, found, False].astype(np.int8)))
    a, b = edge[::2], edge[1::2]  # no run crosses a mark: the last length - 1 places of a text never count
    text = np.searchsorted(ends, a)
    begin = np.r_[0, ends[:-1] + 1][text]
    return text, a - begin, b - begin


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


OCCURRENCE = "k1 long, k2 long, s long, m long"


def hulls_of(texts: DataFrame, length: int, k: int) -> DataFrame:
    """``k1, k2, s, m, g, h1, h2``: the hulls of all texts: first window, windows, anchor's hash, hash of the bytes. A task
    scans copies once."""

    def run(batches):
        seen = set()
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for i, j in chunks(off):
                fresh = np.zeros(j - i, bool)
                for t, key in enumerate(zip(k1[i:j].tolist(), k2[i:j].tolist(), strict=True)):
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        fresh[t] = True
                first, m, _, g = anchors(data, off[i:j + 1], length, k)
                row = np.searchsorted(off[i:j + 1], first, "right") - 1
                ok = fresh[row]
                first, m, g, row = first[ok], m[ok], g[ok], row[ok] + i
                h1, h2 = digests(data, first, first + m + length - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), pa.array(first - off[row]), pa.array(m), pa.array(signed(g)), pa.array(h1), pa.array(h2)],
                    ["k1", "k2", "s", "m", "g", "h1", "h2"])

    return texts.mapInArrow(run, f"{OCCURRENCE}, g long, h1 long, h2 long")


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([view[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def fetch(docs: DataFrame, hulls: DataFrame, length: int, text: str) -> DataFrame:
    """``hulls`` (``g`` and the columns of OCCURRENCE) with their ``bytes``; a text is sent once however often it is there."""
    wanted = durable(hulls.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "m", "g")).alias("cut")), "cuts")
    # copies merge within each task before the shuffle
    texts = semi_join(_texts(docs, length, text), wanted.select("k1", "k2"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            cut = batch.column("cut")
            each = np.diff(cut.offsets.to_numpy())
            s, m, g = (cut.flatten().field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(len(each)), each)
            for i in range(0, len(s), 4096):
                part = slice(i, i + 4096)
                at = off[row[part]] + s[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("k1").to_numpy()[row[part]]), pa.array(batch.column("k2").to_numpy()[row[part]]), pa.array(s[part]),
                     pa.array(m[part]), pa.array(g[part]), _binary(data, at, at + m[part] + length - 1)],
                    ["k1", "k2", "s", "m", "g", "bytes"])

    return texts.join(wanted, ["k1", "k2"]).mapInArrow(run, f"{OCCURRENCE}, g long, bytes binary")


def indexed(rows: DataFrame, length: int) -> DataFrame:
    """``k1, k2, a, b``: runs of repeated windows, found by indexes over blocks of whole groups ``g`` of ``rows``."""

    def search(block):
        if not block:
            return
        sizes = np.concatenate([np.diff(off) for _, _, off in block])
        data = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        body = np.ones(len(data), bool)
        body[ends] = False
        data[body] = np.concatenate([d[off[0]:off[-1]] for _, d, off in block])
        t, a, b = repeats(data, ends, length)
        k1, k2, s = (np.concatenate([x[i] for x, _, _ in block])[t] for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, s + a, s + b)], ["k1", "k2", "a", "b"])

    def run(batches):
        block, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = _bytes(batch.column("bytes"))
            g = batch.column("g").to_numpy()
            names = [batch.column(c).to_numpy() for c in ("k1", "k2", "s")]
            edge = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if size >= BLOCK and g[i] != last:
                    yield from search(block)
                    block, size = [], 0
                lo, hi = int(off[i]), int(off[j])
                block.append(([x[i:j].copy() for x in names], data[lo:hi].copy(), off[i:j + 1] - lo))
                size += hi - lo
                last = g[i]
        yield from search(block)

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "k1 long, k2 long, a long, b long")


def cells(rows: DataFrame, length: int, k: int, width: int) -> DataFrame:
    """The hulls of ``rows`` cut into cells of ``width`` windows, by distance to the anchor; a cell's group is what all its
    windows share. Columns of OCCURRENCE, ``g, h1, h2, bytes``."""

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                piece = batch.slice(part, 1024)
                data, off = _bytes(piece.column("bytes"))
                k1, k2, s, m = (piece.column(c).to_numpy() for c in ("k1", "k2", "s", "m"))
                first, _, place, _ = anchors(data, off, length, k)  # one hull a row
                far = place - first  # distance of the first window; the last one's is far - m + 1
                low = (far - m + 1) // width
                each = far // width - low + 1
                row = np.repeat(np.arange(len(m)), each)
                q = np.repeat(low, each) + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                hi, lo = np.minimum(far[row], q * width + width - 1), np.maximum(far[row] - m[row] + 1, q * width)
                begin, end = place[row] - hi, place[row] - lo + length
                h1, h2 = digests(data, begin, end)
                shared = place[row] - q * width
                c1, _ = digests(data, shared, shared - width + 1 + length)
                g = signed(mix64(c1.view(np.uint64) + q.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), pa.array(s[row] + begin - first[row]), pa.array(hi - lo + 1), pa.array(g), pa.array(h1),
                     pa.array(h2), _binary(data, begin, end)], ["k1", "k2", "s", "m", "g", "h1", "h2", "bytes"])

    return rows.mapInArrow(run, f"{OCCURRENCE}, g long, h1 long, h2 long, bytes binary")


def _told(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of hull rows whose groups may hold different hulls: (spans of those that repeat as a whole, one row each of the different
    hulls, groups too large for an index); all durable or read from durable tables."""
    each = durable(rows.groupBy("g", "h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "s", "m")).alias("one")), "hulls")
    many = each.where("c > 1").select("g", "h1", "h2")
    whole = semi_join(rows, many, ["g", "h1", "h2"]).select("k1", "k2", F.col("s").alias("a"), (F.col("s") + F.col("m")).alias("b"))
    groups = each.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("one.m") + (length - 1)).alias("size"))
    large = durable(groups.where(f"n > 1 and size > {BLOCK}").select("g"), "large-groups")
    several = durable(groups.where("n > 1").select("g"), "groups")
    return whole, semi_join(each, several, "g").select("g", "h1", "h2", "one.*"), large


def _split(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows outside ``groups``, rows in them)."""
    n = groups.count()
    side = F.broadcast(groups) if n <= BROADCAST_ROWS else groups
    return (rows.join(side, "g", "left_anti") if n else rows), rows.join(side, "g", "left_semi")


def _texts(docs: DataFrame, length: int, text: str) -> DataFrame:
    return docs.where(F.octet_length(text) >= length).select(F.col(text).alias("text"), *_keys(F.col(text)))


def repeated_windows(docs: DataFrame, length: int = 400, text: str = "text", k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``k1, k2`` of texts that occur more than once, ``k1, k2, a, b`` spans of the repeated windows of the others), both durable."""
    k = k or max(1, length // 4)
    texts = _texts(docs, length, text)
    copied = durable(texts.groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select("k1", "k2"), "copied")
    hulls = durable(hulls_of(texts, length, k), "occurrences")
    same = F.min(F.struct("h1", "h2")) == F.max(F.struct("h1", "h2"))
    groups = durable(hulls.groupBy("g").agg(F.count("*").alias("c"), same.alias("same")).where("c > 1").select("g", "same"), "anchors")
    whole = semi_join(hulls, groups.where("same").select("g"), "g").select("k1", "k2", F.col("s").alias("a"), (F.col("s") + F.col("m")).alias("b"))
    rows = durable(semi_join(hulls, groups.where("not same").select("g"), "g"), "mixed")
    spans = [whole]
    more, single, large = _told(rows, length)
    spans.append(more)
    small, hot = _split(single, large)
    spans.append(indexed(fetch(docs, small, length, text), length))
    width, open_ = length - k + 1, large.count()
    if open_:
        hot = durable(fetch(docs, hot, length, text), "hot")
    while open_:
        width = -(-width // SPLIT)
        rows = durable(cells(hot, length, k, width), "cells")
        more, single, large = _told(rows.drop("bytes"), length)
        spans.append(more)
        open_ = large.count()
        # each kept hull fetches its bytes from its own row
        single = rows.join(single.select("g", "k1", "k2", "s"), ["g", "k1", "k2", "s"], "left_semi")
        small, hot = _split(single, large)
        spans.append(indexed(small, length))
    found = spans[0]
    for s in spans[1:]:
        found = found.unionByName(s)
    return copied, durable(found.join(F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied, ["k1", "k2"], "left_anti"), "spans")


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed array<struct<start long, end long>>, kept binary`` of every row: the maximal runs of bytes that
    a repeated string of ``length`` bytes covers, and the other bytes, joined. ``kept`` is binary: a run may end inside a
    code point."""
    copied, spans = repeated_windows(docs, length, text)
    cut = durable(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "text-spans")
    whole = copied.withColumn("spans", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(1 << 62).alias("b"))))
    cut = cut.unionByName(whole)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *_keys(F.col(text)))
    hit = cut.select("k1", "k2")
    n = hit.count()
    if n <= BROADCAST_ROWS:  # only rows that lose something are shuffled
        joined = rows.join(F.broadcast(hit), ["k1", "k2"], "left_semi").join(cut, ["k1", "k2"])
        rest = rows.join(F.broadcast(hit), ["k1", "k2"], "left_anti").withColumn("spans", F.lit(None).cast("array<struct<a long, b long>>"))
        rows = joined.unionByName(rest)
    else:
        rows = rows.join(cut, ["k1", "k2"], "left")
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"

    def cut_out(ids, texts, spans):
        data, off = text_buffer(texts)
        each = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        at = np.r_[0, np.cumsum(each)]
        starts, ends, count, kept = [], [], [], []
        for i in range(len(ids)):
            lo, n = int(off[i]), int(off[i + 1] - off[i])
            view = data[lo:lo + n]
            by = np.argsort(a[at[i]:at[i + 1]], kind="stable")
            s, e = a[at[i]:at[i + 1]][by], np.minimum(b[at[i]:at[i + 1]][by], n - length + 1) - 1 + length
            if len(s):
                reach = np.maximum.accumulate(e)
                new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])  # runs that touch are one
                s, e = s[new], reach[np.r_[new[1:] - 1, len(s) - 1]]
                view = np.concatenate([view[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), n], strict=True)])
            starts.append(s)
            ends.append(e)
            count.append(len(s))
            kept.append(view.tobytes())
        removed = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], ["start", "end"])
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off)), list_array(removed, np.array(count, np.int64)), pa.array(kept, pa.binary())],
                                          ["doc_id", "n_bytes", "removed", "kept"])

    def run(batches):
        for batch in batches:
            for i, j in chunks(text_buffer(batch.column("text"))[1]):
                yield cut_out(*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text", "spans")))

    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)
