"""Helpers of this package: text buffers, vectorised word hashes, durable tables, checked joins.

Text is read straight from Arrow buffers. A word is a maximal run of bytes
outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased; its 64-bit hash is a polynomial
over the bytes, computed for a whole batch with prefix sums.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.session import checkpoint_dir
from shotweave.sources.tables import file_system

#: Sides with at most this many rows (of a few longs each) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: The same for rows of names and labels, which are longer.
FEW_ROWS = 100_000
#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 19
#: Bytes of rows in a batch that Spark hands to a task's Python, within ``small_batches``.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Helper tables written within ``recorded``, until ``drop_helpers`` deletes them.
_HELPERS: list[str] = []
_RECORDING = [False]


@contextmanager
def recorded():
    """Helper tables that ``durable`` writes meanwhile are noted down for ``drop_helpers``."""
    _RECORDING[0] = True
    try:
        yield
    finally:
        _RECORDING[0] = False


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends at a table
    that survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/shotweave-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _RECORDING[0]:
        _HELPERS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_helpers(docs: DataFrame) -> None:
    """Deletes the recorded helper tables, but those that ``docs`` reads. For callers that have written down the results
    they were for."""
    spark = docs.sparkSession
    used = "\n".join(docs.inputFiles())
    kept = []
    while _HELPERS:
        path = _HELPERS.pop()
        if path.rsplit("/", 1)[-1] in used:
            kept.append(path)
        else:
            fs, p = file_system(spark, path)
            fs.delete(p, True)
    _HELPERS.extend(kept)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def semi_join(big: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``big`` whose key is in ``ids`` (durable): broadcast when the counted rows allow it,
    else an ordinary shuffled semi join."""
    small = ids.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(ids) if small else ids, key, "left_semi")


def few(rows: DataFrame) -> DataFrame:
    """A durable table of names and labels, broadcast to joins where its counted rows are few, else shuffled."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run meanwhile hand rows to Python in batches of about ``BATCH_BYTES``: an executor's JVM and its Python workers
    each hold a whole batch for every task, and keep the memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def worker_store(name: str) -> dict:
    """What this Python worker keeps under ``name`` from task to task, until a task of another step gives it back."""
    return sys.modules.setdefault(f"_shotweave_{name}", types.ModuleType(name)).__dict__.setdefault("kept", {})


def give_back(keep: str | None = None) -> None:
    """Returns memory that this worker has freed to the system: workers stay for the stages after, whose JVM needs it. What other
    steps than ``keep`` have stored in the worker goes too."""
    for name in [n for n in sys.modules if n.startswith("_shotweave_") and n != f"_shotweave_{keep}"]:
        del sys.modules[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OCTET = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
    """(starts, ends, first word of each text and the total) of ``data[offsets[0]:offsets[-1]]``,
    as positions in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~breaks[data[lo:hi]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets - lo
    at = edge[edge < hi - lo]
    begin[at] = inside[at]
    at = edge[edge > 0] - 1
    end[at] = inside[at]
    starts, ends = np.flatnonzero(begin) + lo, np.flatnonzero(end) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18,
                table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of every span; equal spans (A-Z as a-z, or by ``table``) hash alike wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), block):
        s, e = starts[a:a + block], ends[a:a + block]
        lo, hi = int(s[0]), int(e.max())
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        out[a:a + block] = (sums[e - lo] - sums[s - lo]) * down[s - lo]
    return mix64(out + (ends - starts).astype(np.uint64))


def rolling_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the ``k`` bytes from every place on; equal strings hash alike wherever they stand."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_OCTET[data] * up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[:n - k + 1])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the total)."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


_PLACE = mix64(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text and the total): one for each run of ``k`` words;
    a text of 1 to k-1 words has its whole sequence as the only one."""
    count = np.diff(first)
    n = len(words)
    full = np.zeros(n, np.uint64)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc += words[j:n - k + 1 + j] * _PLACE[j]
        full[:n - k + 1] = mix64(acc)
    for t in np.flatnonzero((count > 0) & (count < k)):
        a, b = int(first[t]), int(first[t + 1])
        acc = np.array([b - a], np.uint64)
        for j in range(b - a):
            acc += words[a + j:a + j + 1] * _PLACE[8 + j]
        full[a] = mix64(acc)[0]
    kept = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.zeros(len(first), np.int64)
    np.cumsum(kept, out=out[1:])
    take = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], kept)
    return full[take], out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(flat: np.ndarray, lengths: np.ndarray, kind=None) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    if not isinstance(flat, pa.Array):
        flat = pa.array(flat, kind) if kind else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)
