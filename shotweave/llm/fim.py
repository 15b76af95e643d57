"""Fill-in-the-middle by displacement scatter.

A text of n code points is cut at two places; prefix, middle and suffix change order around three markers. The cuts of
all texts of a batch are found by one scan for bytes that start a code point. Every piece moves as a whole, so the
shift of its bytes is written once, as a difference, at the piece's first byte; the cumulative sum gives every byte of the
batch its shift and one scatter builds all outputs. Restoring scans an output for its markers, builds the shifts of the
way back the same way and gathers.

Cuts and forms depend on ``sha256('<seed>:<key>')`` only, so they don't change with partitions or retries: the first two
8-digit groups modulo n + 1 are the cuts, the third modulo 100 decides whether the text is cut at all (below ``rate``),
the fourth modulo 100 whether the suffix comes first (``spm``, below ``spm_rate``) or the prefix (``psm``). Texts that are
empty or contain a marker stay as they are (form ``plain``), so every other output holds each marker once.

Defined results: a null text counts as empty; a null key as one without digits; rows that repeat a key are cut by the same
hash, each in its own text; a text of one code point may have two empty pieces; further columns, whatever their names,
are left out; an empty table gives an empty result. No rows meet, so nothing is shuffled; a task holds about 2 MB of
texts at once, or one text where it is longer, and some 40 bytes for each byte of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.common import chunks, text_buffer

MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_SIZE = 3
#: Middle letters of the markers, in the order of MARKERS.
_LETTER = np.frombuffer(b"PSM", np.uint8)
SCHEMA = "doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output string"


def _cuts(docs: DataFrame, key: str, text: str, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """``doc_id, text, n, form, a, b``: the form and the two cuts in code points."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.withColumn("n", F.char_length("text").cast("long"))
    h = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for m in MARKERS:
        marked |= F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= rate), PLAIN).when(h[3] % 100 < spm_rate, SPM).otherwise(PSM)
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).alias("a"),
                       F.greatest(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).alias("b"))


def displacements(places: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """The shift of each of ``size`` bytes, where the pieces that begin at ``places`` (in rising order, empty ones too) move by
    ``shifts``: a difference array, summed up."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, places, np.diff(shifts, prepend=0))
    return np.cumsum(step)[:size]


def scatter(data: np.ndarray, off: np.ndarray, form: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output bytes, offsets) of the texts ``data[off[i]:off[i + 1]]`` (``off[0]`` is 0), cut at code points ``a`` and ``b``;
    ``form``: 0 plain, 1 psm, 2 spm."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(begins, off)
    begins = np.r_[begins, len(data)]
    start, end = off[:-1], off[1:]
    cut = [np.minimum(begins[np.minimum(first[:-1] + c, first[1:])], end) for c in (a, b)]
    cut = [np.where(form == 0, end, c) for c in cut]
    p, m, s = cut[0] - start, cut[1] - cut[0], end - cut[1]
    out_off = np.zeros(len(off), np.int64)
    np.cumsum(end - start + np.where(form == 0, 0, 3 * _SIZE), out=out_off[1:])
    base = out_off[:-1]
    # where the three pieces begin in the output
    at_p = np.select([form == 0, form == 1], [0, _SIZE], 2 * _SIZE + s)
    at_s = np.where(form == 1, 2 * _SIZE + p, _SIZE)
    at_m = 3 * _SIZE + p + s
    places = np.stack([start, cut[0], cut[1]], 1).ravel()
    shifts = np.stack([base + at_p - start, base + at_m - cut[0], base + at_s - cut[1]], 1).ravel()
    out = np.empty(int(out_off[-1]), np.uint8)
    out[np.arange(len(data)) + displacements(places, shifts, len(data))] = data
    cutting = form != 0
    for letter, at in zip(_LETTER, (at_p, at_s, at_m), strict=True):
        where = (base + at - _SIZE)[cutting]
        out[where], out[where + 1], out[where + 2] = 60, letter, 62
    return out, out_off


def gather(data: np.ndarray, off: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text bytes, offsets) rebuilt from outputs and their forms; the inverse of ``scatter``."""
    cutting = np.flatnonzero(form != 0)
    found = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], _LETTER)) if len(data) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(off, found, "right") - 1
    found = found[(form[row] != 0) & (found + _SIZE <= off[row + 1])]
    mark = found.reshape(-1, 3) if len(found) == 3 * len(cutting) else None
    if mark is None or (mark < off[cutting, None]).any() or (mark >= off[cutting + 1, None]).any():
        raise ValueError("an output doesn't hold each of its markers once")
    swapped = form[cutting] == 2
    want = np.where(swapped[:, None], _LETTER[[1, 0, 2]], _LETTER[[0, 1, 2]])
    if (data[mark + 1] != want).any():
        raise ValueError("the markers of an output don't stand in the order of its form")
    start, end = off[:-1], off[1:]
    # pieces as they stand in the output: their begin and length; plain ones are all prefix
    begin = np.repeat(start[:, None], 3, 1)
    size = np.zeros((len(start), 3), np.int64)
    size[:, 0] = end - start
    begin[cutting] = mark + _SIZE
    size[cutting] = np.c_[mark[:, 1:], end[cutting]] - begin[cutting]
    order = np.tile([0, 2, 1], (len(start), 1))  # prefix, middle, suffix of psm
    order[cutting[swapped]] = [1, 2, 0]
    begin, size = np.take_along_axis(begin, order, 1).ravel(), np.take_along_axis(size, order, 1).ravel()
    ends = np.cumsum(size)
    places = ends - size
    total = int(ends[-1]) if len(ends) else 0
    text_off = np.r_[0, ends[2::3]]
    return data[np.arange(total) + displacements(places, begin - places, total)], text_off


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _codes(forms: pa.Array) -> np.ndarray:
    forms = np.asarray(forms.to_pylist(), object)
    return np.select([forms == PSM, forms == SPM], [1, 2], 0).astype(np.int64)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90,
                   spm_rate: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row; lengths in code points, null for ``plain``."""
    rows = _cuts(docs, key, text, seed, rate, spm_rate)
    schema = SCHEMA.format(key=docs.schema[key].dataType.simpleString())

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            form = _codes(batch.column("form"))
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for i, j in chunks(off):
                lo = int(off[i])
                out, ends = scatter(data[lo:int(off[j])], off[i:j + 1] - lo, form[i:j], a[i:j], b[i:j])
                plain = form[i:j] == 0
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n"), part.column("form"), pa.array(a[i:j], mask=plain),
                     pa.array(b[i:j] - a[i:j], mask=plain), _strings(out, ends)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form", to: str = "text") -> DataFrame:
    """``rows`` with the text that an output was made of as column ``to``; a null output gives an empty text."""
    if to in rows.columns:
        raise ValueError(f"there is a column {to} already")
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(output))
            code = _codes(batch.column(form))
            for i, j in chunks(off):
                lo = int(off[i])
                texts, ends = gather(data[lo:int(off[j])], off[i:j + 1] - lo, code[i:j])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(texts, ends)], [*part.schema.names, to])

    return rows.mapInArrow(run, schema)
