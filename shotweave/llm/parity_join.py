"""N-gram Jaccard join by parity sketches.

A document's distinct word shingles are XOR-hashed into a wide, sparse bit sketch:
each shingle flips one bit. Equal shingles cancel between two sketches, so their
Hamming distance never exceeds the symmetric difference of the two sets. A pair
with Jaccard >= t has a symmetric difference of at most (1-t)/(1+t) of the summed
sizes, D say. The sketch of a size band is cut into blocks; a difference spoils one
block at most, so two linked documents agree in some occupied block as long as more
than D blocks are occupied (blocks are sized so that this holds but for a chance
below 1e-14; both documents of a pair would have to miss it). Among the D + 1 first
occupied blocks in any one global order both documents name a common block, so each
document emits only those, rare blocks first. Documents that share a block are
candidates; exact Jaccard decides.

Defined results: null or empty texts and texts without words have an empty set and
link with nothing; documents with equal sets (exact copies) always link and are
handled as one node; rows that repeat a doc_id are taken as documents of their own
with that id; rows with a null doc_id link with nothing (component null); further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import (chunks, durable, give_back, list_array, mix64, semi_join, shingles, signed, small_batches,
                                  text_buffer, word_hashes)
from shotweave.llm.graph import linked_components

#: Each size band spans a factor of 4; its sketch has a block for every 2.4 shingles of its largest set,
#: and 16 for each shingle in the small bands, where chance would leave too few blocks occupied.
BAND_BITS, FILL, SMALL = 2, 2.4, 128
#: Counts of shared shingles are kept in 2 ** FREQ_BITS hash buckets (a fixed size) and only order the blocks.
FREQ_BITS = 21
COUNT_BLOCK = 1 << 21  # shingles that a task compares at a time when it looks for shared ones
SEEN = 1 << 18  # set keys a task remembers so as to emit the blocks of equal sets once

ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                 ("tokens", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
ROW_DDL = "doc_id long, n long, k1 long, k2 long, tokens array<long>, sketch array<long>"


def band_of(n: int) -> int:
    return (int(n).bit_length() - 1) // BAND_BITS


def band_blocks(band: int) -> int:
    top = 1 << (BAND_BITS * (band + 1))
    return 16 * top if top <= SMALL * 2 else int(np.ceil(top / FILL))


def max_difference(n: int, band: int, percent: int) -> int:
    """Largest symmetric difference of a set of n shingles and a linked one, the larger in ``band``."""
    partner = min(n * 100 // percent, (1 << (BAND_BITS * (band + 1))) - 1)
    return (100 - percent) * (n + max(partner, n)) // (100 + percent)


def block_tokens(items: np.ndarray, freq: np.ndarray, percent: int) -> np.ndarray:
    """The blocks a set (distinct hashes) emits, in each band it can meet a linked set in."""
    n = len(items)
    if not n:
        return np.zeros(0, np.uint64)
    own = band_of(n)
    out = []
    bits = mix64(items ^ np.uint64(0xA5A5A5A5DEADBEEF))  # the bit that a shingle flips
    common = freq[bucket(items)]
    for band in range(own, band_of(max(n, n * 100 // percent)) + 1):
        blocks = band_blocks(band)
        block = (items >> np.uint64(16)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        at = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
        word = np.bitwise_xor.reduceat(bits[order], at)
        rare = np.minimum.reduceat(common[order], at)
        token = mix64(word + (block[order][at] << np.uint64(8)) + np.uint64(band + 1))
        token, rare = token[word != 0], rare[word != 0]
        keep = max_difference(n, band, percent) + 1
        out.append(token[np.lexsort((token, rare))[:keep]])
    return np.concatenate(out)


def set_keys(items: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    with np.errstate(over="ignore"):
        return (int(mix64(items).sum(dtype=np.uint64).view(np.int64)),
                int((mix64(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(items))).view(np.int64)))


def set_chunks(column, k: int):
    """(first row, distinct sorted shingle hashes of each text) of every chunk of an Arrow column's texts, so that
    what is made of a batch goes out chunk by chunk, however long its texts are."""
    data, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        words, first = word_hashes(data, offsets[i:j + 1])
        sh, at = shingles(words, first, k)
        yield i, [np.unique(sh[at[t]:at[t + 1]]) for t in range(j - i)]


def each_set(column, k: int):
    """The distinct sorted shingle hashes of every text of an Arrow column."""
    for _, sets in set_chunks(column, k):
        yield from sets


def bucket(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - FREQ_BITS)).astype(np.int64)


def frequencies(docs: DataFrame, each) -> np.ndarray:
    """Counts of the sets' items (``each(column)`` gives the sets of an Arrow text column): of those that a task meets in several different
    sets, summed over all documents by hash bucket. Items of one set only don't count, so these order first. The counts only order blocks; any order
    gives the same links."""

    def count(batches):
        total = np.zeros(1 << FREQ_BITS, np.int64)
        held, size, seen = [], 0, set()

        def look():
            every = np.concatenate(held)
            held.clear()
            every.sort()
            edge = np.diff(np.r_[False, every[1:] == every[:-1], False].view(np.int8))  # of runs of equal items
            begin = np.flatnonzero(edge == 1)
            np.add.at(total, bucket(every[begin]), np.flatnonzero(edge == -1) - begin + 1)

        give_back()  # what the steps before have left here
        for b in batches:
            for items in each(b.column("text")):
                key = (len(items), int(items[:8].sum()), int(items[-8:].sum()))
                if not len(items) or key in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(key)
                held.append(items)
                size += len(items)
                if size >= COUNT_BLOCK:
                    look()
                    size = 0
        if held:
            look()
        hot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hot, pa.int32()), pa.array(total[hot], pa.int64())], ["bucket", "c"])
        seen.clear()
        give_back()

    rows = durable(docs.select("text").mapInArrow(count, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")),
                   "frequencies")
    # items that share a bucket by chance add up to the mean: only what stands out from it counts, at every size
    mean = int(rows.agg(F.sum("c")).first()[0] or 0) // (1 << FREQ_BITS)
    rows = rows.where(F.col("c") >= 8 + 2 * mean).toPandas()
    out = np.zeros(1 << FREQ_BITS, np.int32)
    out[rows["bucket"].to_numpy(np.int64)] = np.minimum(rows["c"].to_numpy(np.int64) - 2 * mean, 1 << 30)
    return out


def sketch_rows(docs: DataFrame, freq: np.ndarray, k: int, percent: int) -> DataFrame:
    """Per document: set size, set key and the blocks it emits (none where the task has emitted this set's before, or
    without a doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(freq)

    def run(batches):
        table, seen = shared.value, set()
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            for at, sets in set_chunks(b.column("text"), k):
                n, k1, k2, flat, size, sketch = [], [], [], [], [], []
                for items, has_id in zip(sets, named[at:at + len(sets)].tolist(), strict=True):
                    key = set_keys(items)
                    n.append(len(items))
                    k1.append(key[0])
                    k2.append(key[1])
                    if len(seen) > SEEN:
                        seen.clear()
                    new = has_id and len(items) > 0 and key not in seen
                    if has_id:
                        seen.add(key)
                    tokens = block_tokens(items, table, percent) if new else np.zeros(0, np.uint64)
                    flat.append(tokens)
                    size.append(len(tokens))
                    sketch.append(parity_sketch(items) if new else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     list_array(signed(np.concatenate(flat)), np.array(size, np.int64), pa.int64()), _lists(sketch)], schema=ROW)
        seen.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROW_DDL)


def parity_sketch(items: np.ndarray) -> np.ndarray:
    """A dense parity sketch for comparing two sets: a power of two of bits, 256 and one for each item at least."""
    bits = 1 << max(8, int(len(items) - 1).bit_length())
    place = (mix64(items ^ np.uint64(0x1234567887654321)) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return list_array(flat, np.array([len(x) for x in arrays], np.int64), pa.int64())


def item_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(node, items)``: the shingle sets of the given documents."""

    def run(batches):
        for b in batches:
            for at, sets in set_chunks(b.column("text"), k):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(sets)), _lists([signed(s) for s in sets])], ["node", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, items array<long>")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Rows ``(token, k, n)`` of tokens that at least two different keys have, without repeats. The test of a token is an
    aggregate, so a token of very many rows is reduced before it is dealt out, and the join may split it."""
    # written down, so that the aggregate's shuffle is gone before that of the join; joined the same way at every size
    some = durable(tokens.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("token"),
                   "shared-tokens")
    return tokens.join(some, "token", "left_semi").select("token", "k", "n").distinct()


def ngram_jaccard_join(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """Classes of ``docs(doc_id, text)`` under links of Jaccard >= percent/100 on distinct word shingles.

    Returns ``doc_id, n_shingles long, component_id long`` (smallest doc_id reachable), one row per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        freq = frequencies(docs, lambda column: each_set(column, shingle))
        rows = durable(sketch_rows(docs, freq, shingle, percent), "sketches")
        of = _classes(docs, rows, shingle, percent)
    # sets that several rows share are joined on the set; the class of any other set is that of its only row
    return rows.select("doc_id", "n", "k1", "k2").join(of, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _classes(docs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(k1, k2, component_id)`` of every set. A node is a set, named by its smallest doc_id; where one doc_id
    has rows with different sets, the empty one included, by its key instead."""
    used = rows.where("n > 0 and doc_id is not null")
    reps = durable(used.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n")), "reps")
    own = F.struct("k1", "k2")
    twice = (rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
             .where("lo != hi").limit(1).count())
    key = F.concat_ws(":", "k1", "k2") if twice else F.col("first_id")
    named = reps.withColumn("node", key)
    tokens = rows.where("doc_id is not null").select(F.explode("tokens").alias("token"), F.col("k1").alias("k"), "n")
    shared = durable(shared_tokens(tokens).join(named.select(F.col("k1").alias("k"), "node"), "k")
                     .select("token", "node", "n"), "shared")
    near = durable(shared.select("node").distinct(), "nodes")
    sketches = durable(rows.where("doc_id is not null and size(sketch) > 0").select("k1", "k2", "sketch")
                       .join(named.join(near, "node", "left_semi").select("k1", "k2", "node"), ["k1", "k2"])
                       .groupBy("node").agg(F.first("sketch").alias("sketch")), "parities")

    def sets_of(ids):
        if not twice:  # a node is named by its document
            return item_sets(semi_join(docs, ids.withColumnRenamed("node", "doc_id"), "doc_id"), shingle).dropDuplicates(["node"])
        wanted = durable(named.join(ids, "node").select(F.col("first_id").alias("doc_id")).distinct(), "wanted")
        keyed = keyed_sets(semi_join(docs.where("doc_id is not null"), wanted, "doc_id"), shingle)
        return keyed.join(ids, "node", "left_semi").dropDuplicates(["node"])

    label, _ = linked_components(shared, sketches, sets_of, percent)
    named = named.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if not twice:
        return durable(named.select("k1", "k2", F.col("label").alias("component_id")), "classes")
    low = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return durable(named.join(low, "label").select("k1", "k2", "component_id"), "classes")


def keyed_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(node, items)`` with the set's key as the node."""

    def run(batches):
        for b in batches:
            for _, sets in set_chunks(b.column("text"), k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["%d:%d" % set_keys(s) for s in sets], pa.string()), _lists([signed(s) for s in sets])],
                    ["node", "items"])

    return docs.select("text").mapInArrow(run, "node string, items array<long>")
