"""Order-preserving packing by dynamic programming.

Documents keep the order in which a task reads them. Their token ids, each followed by a separator
id, form one stream per task; the stream is cut into windows of at most ``size`` tokens. A cut may
fall behind a document, behind a sentence or line, or (in long sentences) anywhere on a grid; the latter two
pay a truncation penalty. A window of a power of two of tokens needs no padding, any other one is padded to
``size``. Each window also has a fixed cost, so that full ones are preferred. The cheapest cuts up to
every place p follow from cost(p) = min over q of cost(q) + padding(p - q) + penalty(p): the padded case takes the
minimum of cost(q) + q over a sliding range, kept in a monotone queue; the free cases are looked up.

No shuffle and no group is needed: tasks pack what they read, in segments of bounded length. Sequence ids
are made of the partition's number and a count, so a task that runs again names its sequences alike.

Tokens come from the tokenizer file named by ``tokenizer``. Its pre-tokenizer always cuts in front of a blank that
follows a non-blank, so texts are split there and the ids of each distinct piece are encoded once and remembered;
texts with other runs of blanks are encoded whole.

Defined results: null and empty texts consist of the separator alone; rows that repeat a doc_id, or with a null one,
are packed each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import chunks, give_back, mix64, span_hashes, text_buffer, worker_store

SENTENCE, INSIDE = 4, 64  # penalties, in tokens
WINDOW_COST = 256
GRID = 64  # inside sentences longer than twice this, a cut is allowed at its multiples
SEGMENT = 1 << 20  # tokens that one run of the dynamic programme covers, a whole document at least
SEGMENT_BYTES = 4 << 20  # bytes of text encoded at a time
REMEMBERED = 600_000  # distinct pieces a task remembers at a time

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_ODD_BLANKS = re.compile(r"\s \s|\s $")
_EXACT = mix64(np.arange(501, 757, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # byte values, cases apart
#: Bytes that may end or begin white space next to a blank (ASCII, or part of a longer character's code).
_MAY_END, _MAY_BEGIN = np.zeros(256, bool), np.zeros(256, bool)
_MAY_END[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True
_MAY_BEGIN[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class PieceEncoder:
    """Token ids and sentence ends of texts by way of remembered pieces. ``tokenizers`` reads the file. Where the file
    is a plain byte-level BPE, single pieces are encoded by the faster ``tiktoken`` from the same vocabulary, as long as
    it agrees with ``tokenizers`` on each batch's first pieces."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.encode_special_tokens = True
        self.breaks = {i for s in ("\n", "\n\n", "a\n", "a\n\n") for i in self.tok.encode(s, add_special_tokens=False).ids[-1:]}
        self.fast = self._fast_encode(tokenizer)
        self.forget()

    @staticmethod
    def _fast_encode(tokenizer: str):
        import tiktoken
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if (spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or spec.get("normalizer")):
            return None
        from tokenizers.pre_tokenizers import ByteLevel
        # the printable stand-ins of bytes, in the order of their byte values
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        assert set(byte) == set(ByteLevel.alphabet())
        ranks = {bytes(byte[c] for c in k): i for k, i in spec["model"]["vocab"].items() if all(c in byte for c in k)}
        import public_tokenizers
        for added in spec.get("added_tokens", []):
            ranks.pop(added["content"].encode(), None)
        try:
            return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={}).encode_ordinary
        except ValueError:
            return None

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Drops the remembered pieces, but for the places in ``keep``."""
        if keep is None:
            self.at, self.ids = {}, np.zeros(1 << 16, np.uint32)
            self.first, self.size, self.cut, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(4))
            self.pieces, self.used = 0, 0
            return
        names = np.fromiter(self.at.keys(), np.uint64, len(self.at))
        ids = self.ids[_ragged(self.first[keep], self.size[keep])]
        self.pieces, self.used = len(keep), len(ids)
        self.at = dict(zip(names[keep].tolist(), range(len(keep)), strict=True))
        self.size[:len(keep)], self.cut[:len(keep)] = self.size[keep], self.cut[keep]
        self.first[:len(keep)] = np.cumsum(self.size[:len(keep)]) - self.size[:len(keep)]
        self.ids[:len(ids)] = ids
        self.uses[:] = 0

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tok.encode_batch(pieces, add_special_tokens=False)]
        out = [self.fast(p) for p in pieces]
        if any(self.tok.encode(p, add_special_tokens=False).ids != o for p, o in zip(pieces[:16], out, strict=False)):
            self.fast = None
            return self._encode(pieces)
        return out

    def _cut(self, piece: str, ids: list[int]) -> int:
        """Behind how many of a piece's ids a sentence or line ends; 0: none does."""
        if "\n" in piece:
            for i in range(len(ids) - 1, -1, -1):
                if ids[i] in self.breaks:
                    return i + 1
        return len(ids) if piece[-1:] in ".!?" else 0

    def _learn(self, names: list[int], pieces: list[str]) -> None:
        ids = self._encode(pieces)
        size = np.array([len(i) for i in ids], np.int64)
        n, total = len(ids), int(size.sum())
        while self.pieces + n > len(self.first):
            self.first, self.size, self.cut, self.uses = (np.r_[x, np.zeros_like(x)] for x in (
                self.first, self.size, self.cut, self.uses))
        while self.used + total > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        here = slice(self.pieces, self.pieces + n)
        self.size[here] = size
        self.first[here] = self.used + np.cumsum(size) - size
        self.cut[here] = [self._cut(p, i) for p, i in zip(pieces, ids, strict=True)]
        self.ids[self.used:self.used + total] = np.fromiter((t for i in ids for t in i), np.uint32, total)
        self.at.update(zip(names, range(self.pieces, self.pieces + n), strict=True))
        self.pieces, self.used = self.pieces + n, self.used + total

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all texts one after the other, ids of each text, places behind sentences in all ids) of some texts."""
        if self.pieces > REMEMBERED:
            again = np.flatnonzero(self.uses[:self.pieces] > 1)
            self.forget(again if len(again) < REMEMBERED // 2 else None)
        lo, hi = int(offsets[0]), int(offsets[-1])
        odd = self._odd(data, offsets)
        blank = np.flatnonzero(data[lo:hi] == 32) + lo
        begin = np.union1d(blank, offsets[:-1][np.diff(offsets) > 0])
        stop = np.append(begin[1:], hi)
        text = np.searchsorted(offsets, begin, "right") - 1
        if odd:
            whole = np.isin(text, odd)
            begin, stop, text = begin[~whole], stop[~whole], text[~whole]
        names = span_hashes(data, begin, stop, table=_EXACT) if len(begin) else np.zeros(0, np.uint64)
        known, where, piece = np.unique(names, return_index=True, return_inverse=True)
        names = known.tolist()
        at = np.fromiter((self.at.get(h, -1) for h in names), np.int64, len(names))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            a, z = begin[where].tolist(), stop[where].tolist()
            raw = data.tobytes() if hi - lo == len(data) else data[lo:hi].tobytes()
            base = 0 if hi - lo == len(data) else lo
            self._learn([names[i] for i in new], [raw[a[i] - base:z[i] - base].decode() for i in new])
            at[new] = np.arange(self.pieces - len(new), self.pieces)
        self.uses[at] += 1
        at = at[piece]
        size, cut = self.size[at], self.cut[at]
        ids = self.ids[_ragged(self.first[at], size)]
        count = np.bincount(text, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        end = np.cumsum(size)
        sentence = (end - size + cut)[cut > 0]
        if not odd:
            return ids, count, sentence
        parts = [ids[a:a + n] for a, n in zip((np.cumsum(count) - count).tolist(), count.tolist(), strict=True)]
        cuts = np.split(sentence, np.searchsorted(sentence, np.cumsum(count)[:-1], "right"))
        cuts = [c - (e - n) for c, e, n in zip(cuts, np.cumsum(count).tolist(), count.tolist(), strict=True)]
        for t in odd:
            own = data[offsets[t]:offsets[t + 1]].tobytes().decode()
            got = self.tok.encode(own, add_special_tokens=False).ids
            parts[t] = np.array(got, np.uint32)
            cuts[t] = np.array([i + 1 for i, x in enumerate(got) if x in self.breaks], np.int64)
        count = np.array([len(p) for p in parts], np.int64)
        base = np.cumsum(count) - count
        return np.concatenate(parts), count, np.concatenate([c + b for c, b in zip(cuts, base.tolist(), strict=True)])

    @staticmethod
    def _odd(data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts with a blank that has white space on both sides, or in front of it at the text's end."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        part = data[lo:hi]
        b = np.flatnonzero(part == 32)
        b = b[b > 0]
        b = b[_MAY_END[part[b - 1]]]
        edge = np.zeros(hi - lo + 1, bool)
        edge[offsets - lo] = True
        follows = np.append(part, 32)[b + 1]
        b = b[_MAY_BEGIN[follows] | edge[b + 1]]
        texts = np.unique(np.searchsorted(offsets, b + lo, "right") - 1)
        return [t for t in texts.tolist() if _ODD_BLANKS.search(data[offsets[t]:offsets[t + 1]].tobytes().decode())]


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first[i] .. first[i] + size[i] - 1 for every i, one after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    end = np.cumsum(size)
    return np.arange(int(end[-1])) + np.repeat(first - end + size, size)


def _worker_encoder(tokenizer: str) -> PieceEncoder:
    """The encoder of this Python worker, which keeps its pieces from task to task until another step's task runs here."""
    store = worker_store("encoders")
    if tokenizer not in store:
        store[tokenizer] = PieceEncoder(tokenizer)
    return store[tokenizer]


def cut_stream(total: int, places: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """The cheapest window starts and the end, for a stream of ``total`` tokens that may be cut at ``places`` (rising,
    the last one ``total``) at the given penalties; neighbouring places lie at most ``size`` apart."""
    p = np.r_[0, places]
    free: list[list[int]] = [[] for _ in range(len(p))]
    for k in range(size.bit_length()):
        length = 1 << k
        if length > size:
            break
        at = np.searchsorted(p, p - length)
        for j in np.flatnonzero((p >= length) & (p[np.minimum(at, len(p) - 1)] == p - length)).tolist():
            free[j].append(int(at[j]))
    pos, pen = p.tolist(), np.r_[0, penalty].tolist()
    cost, back = [0] * len(pos), [0] * len(pos)
    queue: deque = deque([(0, 0)])  # (cost + place, index), rising in cost
    for j in range(1, len(pos)):
        here = pos[j]
        while pos[queue[0][1]] < here - size:
            queue.popleft()
        best, came = queue[0][0] + size - here, queue[0][1]
        for i in free[j]:
            if cost[i] < best:
                best, came = cost[i], i
        cost[j] = best = best + WINDOW_COST + pen[j]
        back[j] = came
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [len(pos) - 1], len(pos) - 1
    while j:
        j = back[j]
        cuts.append(j)
    return p[np.array(cuts[::-1])]


def _places(total: int, ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places where the stream may be cut, and their penalties."""
    places = np.union1d(ends, sentences)
    gap = np.diff(np.r_[0, places])
    wide = np.flatnonzero(gap > 2 * GRID)
    inner = [np.arange(places[i] - gap[i] + GRID, places[i], GRID) for i in wide]
    every = np.union1d(places, np.concatenate(inner)) if inner else places
    penalty = np.full(len(every), INSIDE)
    penalty[np.searchsorted(every, sentences)] = SENTENCE
    penalty[np.searchsorted(every, ends)] = 0
    return every, penalty


def pack_segment(keys: list, ids: np.ndarray, n: np.ndarray, sentences: np.ndarray, size: int, name: int):
    """(record batch of pieces, sequences used) of some documents in order: their ids with separators, one after
    the other, and how many each has."""
    ends = np.cumsum(n)
    begin = ends - n
    total = int(ends[-1])
    cuts = cut_stream(total, *_places(total, ends, sentences), size)
    starts = np.union1d(cuts[:-1], begin)
    stops = np.r_[starts[1:], total]
    doc = np.searchsorted(begin, starts, "right") - 1
    window = np.searchsorted(cuts, starts, "right") - 1
    stream = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(stream[4 * a:4 * z]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array(starts - begin[doc], pa.int64()),
         pa.array(stops - starts, pa.int64()), pa.array(crc, pa.int64()), pa.array(n[doc], pa.int64()),
         pa.array(window + name, pa.int64()), pa.array(starts - cuts[window], pa.int64())], schema=SCHEMA)
    return batch, len(cuts) - 1


def with_separators(ids: np.ndarray, count: np.ndarray, sentences: np.ndarray, separator: int):
    """Ids, counts and sentence places once every text has the separator behind it."""
    ends = np.cumsum(count)
    out = np.insert(ids, ends, np.uint32(separator)) if len(count) else ids
    return out, count + 1, sentences + np.searchsorted(ends, sentences, "left")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` cut into pieces and packed: one row per piece with ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset`` (all long). ``tokenizer``: path of a tokenizer file, on every machine."""

    def run(batches):
        coder = _worker_encoder(tokenizer)
        name = TaskContext.get().partitionId() << 40
        held: list = []
        total = 0

        def flush():
            nonlocal held, total, name
            keys = [k for part in held for k in part[0]]
            counts = np.concatenate([p[2] for p in held])
            shift = np.cumsum([0] + [len(p[1]) for p in held[:-1]])
            places = np.concatenate([p[3] + s for p, s in zip(held, shift.tolist(), strict=True)])
            batch, used = pack_segment(keys, np.concatenate([p[1] for p in held]), counts, places, size, name)
            name += used
            held, total = [], 0
            return batch

        for b in batches:
            keys = b.column("doc_id").to_pylist()
            data, offsets = text_buffer(b.column("text"))
            for i, j in chunks(offsets, SEGMENT_BYTES):
                got = with_separators(*coder.encode(data, offsets[i:j + 1]), separator)
                held.append((keys[i:j], *got))
                total += len(got[0])
                if total >= SEGMENT:
                    yield flush()
        if held:
            yield flush()
        give_back("encoders")

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DDL)
