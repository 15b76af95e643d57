"""What jobs leave on disk: shuffle files of written tables, helper tables of rounds, and how lines and synonyms are dealt out."""

import time

from pyspark.sql import functions as F

from shotweave.operators import eda as E
from shotweave.sources import tables

WORDS = [a + b for a in "bcdfghjk" for b in ("a", "e", "i", "ou")]


def _shuffles(spark) -> set:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffles(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("c"))
    t = tables.durable(rows, "counted")
    for _ in range(100):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") != "true"
    assert t.count() == 50 and t.agg(F.sum("c")).first()[0] == 5000
    assert t.inputFiles()[0].endswith(".zstd.parquet")
    folder = t.inputFiles()[0].rsplit("/", 1)[0]
    tables.discard(t)
    fs, p = tables.file_system(spark, folder)
    assert not fs.exists(p)


def test_word_edits_deal_out_packed_rows_and_drop_their_rounds(spark, monkeypatch):
    """a chunk's lines and synonyms are few packed rows, columns that aren't kept are not written, rounds leave no tables."""
    written, dropped = [], []
    durable, discard = E.durable, E.discard
    monkeypatch.setattr(E, "durable", lambda df, name: written.append((name, durable(df, name))) or written[-1][1])
    monkeypatch.setattr(E, "discard", lambda df: dropped.append(df) or discard(df))
    th = spark.createDataFrame(list(zip(WORDS, WORDS[1:])), "word string, synonym string")
    rows = [(str(i), " ".join(WORDS[(i + 3 * j) % 20] for j in range(6)), "more") for i in range(400)]
    lines = spark.createDataFrame(rows, "eid string, text string, other string").repartition(3)
    every = ("eid", "technique", "variant", "aug_text")
    got = E.eda(lines, th, 0.3, 0.8, 0.1, 0.1, 9, keep=("eid",))
    assert got.columns == list(every)
    assert sorted(got.collect()) == sorted(E.eda(lines, th, 0.3, 0.8, 0.1, 0.1, 9).select(*every).collect())

    first = written[:[name for name, _ in written].index("eda-lines", 1)]
    assert dict(first)["eda-lines"].columns == ["eid", "_eid", "_na", "_clean"]
    rounds = [t for name, t in first if name == "eda-open"]
    assert len(rounds) >= 3 and all(any(t is d for d in dropped) for t in rounds[:-1]) and rounds[-1].isEmpty()
    known = [t for name, t in first if name == "eda-known"]
    chunks = got.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in known[0].inputFiles()}).select("_chunk").distinct().count()
    assert known[0].columns == ["_chunk", "_known"] and known[0].count() <= 8 * chunks
    entries = E._unpack_words([r["_known"] for r in known[0].collect()])
    assert set(entries["word"].to_pylist()) == set(WORDS[:20]) and all(s is not None for s in entries["syns"].to_pylist())


def test_packed_words_are_the_same_words():
    pa, asked = E.pa, [["ba", ["be", "x y"]], ["", ["q"]], ["bi", None], ["bo", [""]]]
    packed = [E._pack_words(pa.array(["\t".join([w, *(s or [])]) for w, s in some]), flag) for some, flag in ((asked, True), (asked[1:2], False), ([["", None]], True))]
    known = E._unpack_words(packed)
    assert [list(x) for x in zip(known["word"].to_pylist(), known["syns"].to_pylist())] == [*asked, asked[1], ["", None]]
    assert known["asked"].to_pylist() == [True] * 4 + [False, True]
    assert E._unpack_words([]).num_rows == 0
