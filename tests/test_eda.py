"""EDA against a brute-force Python version of the same keyed rule."""

import hashlib
import math
import re
import time

from pyspark.sql import functions as F

from shotweave.functions.rand import seed_pair, stream
from shotweave.functions.text import STOP_WORDS
from shotweave.operators import eda as E


def clean(line):
    line = line.replace("’", "").replace("'", "").replace("-", " ").replace("\t", " ").replace("\n", " ").lower()
    out = "".join(c if c in "qwertyuiopasdfghjklzxcvbnm " else " " for c in line)
    out = re.sub(" +", " ", out)
    return out[1:] if out[:1] == " " else out


def draws(*keys):
    """The stream of a key, draw by draw, in plain integers."""
    h = hashlib.md5("|".join(str(k) for k in keys).encode()).hexdigest()
    s1, s2 = int(h[:7], 16), int(h[7:14], 16)
    p = 2 ** 31 - 1

    def at(i):
        z = (s1 + (i + 1) * 1566083941) % p
        z = (z * z + s2) % p
        z = (z * 48271 + s1) % p
        return (z * z + i) % p / p
    return at


def choice(arr, u):
    return arr[math.floor(u * len(arr))]


def replaced(words, n, syn, u):
    """One word after the other, over the whole line each time."""
    cand = [w for i, w in enumerate(words) if w not in words[:i] and w not in STOP_WORDS]
    new, done = list(words), 0
    for _, k in sorted((u(2 * k), k) for k in range(len(cand))):
        if syn.get(cand[k]):
            s = choice(syn[cand[k]], u(2 * k + 1))
            new = [s if w == cand[k] else w for w in new]
            done += 1
        if done >= n:
            break
    return new


def inserted(words, n, syn, u):
    new = list(words)
    for s in range(n):
        for j in range(9):
            w = choice(new, u(11 * s + j))
            if syn.get(w):
                new.insert(math.floor(u(11 * s + 10) * len(new)), choice(syn[w], u(11 * s + 9)))
                break
    return new


def swapped(words, n, u):
    new = list(words)
    for s in range(n):
        a = math.floor(u(4 * s) * len(new))
        for j in (1, 2, 3):
            b = math.floor(u(4 * s + j) * len(new))
            if a != b:
                new[a], new[b] = new[b], new[a]
                break
    return new


def brute(eid, text, syn, a, num_aug, seed="eda"):
    words = [w for w in clean(text).split(" ") if w]
    if not words:
        return set()
    techs = [t for t, x in zip(["sr", "ri", "rs", "rd"], a) if x > 0]
    npt = int(num_aug / 4) + 1
    left = [(t, v) for t in techs for v in range(npt)]
    if num_aug >= 1:
        u = draws(seed, "shuffle", eid)
        for i in range(max(len(left) - int(num_aug), 0)):
            del left[math.floor(u(i) * len(left))]
    else:
        left = [(t, v) for t, v in left if draws(seed, "keep", eid, t, v)(0) < num_aug / len(left)]
    out = set()
    for t, v in left:
        u = draws(seed, eid, t, v)
        n = {k: max(1, int(x * len(words))) for k, x in zip(["sr", "ri", "rs"], a)}
        if t == "sr":
            res = replaced(words, n["sr"], syn, u)
        elif t == "ri":
            res = inserted(words, n["ri"], syn, u)
        elif t == "rs":
            res = swapped(words, n["rs"], u)
        elif len(words) == 1:
            res = words
        else:
            res = [w for k, w in enumerate(words) if u(k) > a[3]] or [choice(words, u(len(words)))]
        txt = clean(" ".join(res))
        if txt:
            out.add((eid, t, v, txt))
    return out


LINES = [
    ("l1", "The quick brown fox jumps over the lazy dog"),
    ("l2", "Book a table for two at the Italian place"),
    ("l3", "what's the weather like in Paris tomorrow?"),
    ("l4", "hello"),
    ("l5", "Transfer 200 dollars to my savings account please"),
    ("l6", "12345"),
    ("l7", "Play some jazz music and turn the volume up high now"),
]
THESAURUS = [("quick", "fast"), ("quick", "speedy"), ("fast", "rapid"), ("dog", "hound"), ("dog", "Canis_familiaris"),
             ("table", "board"), ("book", "reserve"), ("weather", "conditions"), ("hello", "hi"), ("hello", "hello"),
             ("music", "melody"), ("jazz", "swing"), ("high", "elevated"), ("savings", "nest-egg"),
             ("account", "report"), ("account", "history"), ("melody", "tune")]


def _syn():
    out = {}
    for w, s in THESAURUS:
        n = re.sub("[^a-z ]", "", s.replace("_", " ").replace("-", " ").lower())
        if n != w:
            out.setdefault(w, set()).add(n)
    return {k: sorted(v) for k, v in out.items()}


def test_eda_matches_brute_force(spark):
    lines = spark.createDataFrame(LINES, "eid string, text string")
    th = spark.createDataFrame(THESAURUS, "word string, synonym string")
    syn = _syn()
    for a, na in [((0.1, 0.1, 0.1, 0.1), 9), ((0.3, 0.3, 0.3, 0.3), 4), ((0.2, 0.0, 0.0, 0.5), 2), ((0.9, 0.9, 0.9, 0.9), 0.5),
                  ((0.9, 0.9, 0.9, 0.1), 30)]:
        got = {(r.eid, r.technique, r.variant, r.aug_text)
               for r in E.eda(lines, th, *a, num_aug=na).collect()}
        want = set()
        for eid, text in LINES:
            want |= brute(eid, text, syn, a, na)
        assert got == want, (a, got ^ want)


def test_eda_partition_invariant(spark):
    lines = spark.createDataFrame(LINES, "eid string, text string")
    th = spark.createDataFrame(THESAURUS, "word string, synonym string")
    a = E.eda(lines.repartition(1), th, 0.2, 0.2, 0.2, 0.2, 8).select("eid", "technique", "variant", "aug_text")
    b = E.eda(lines.repartition(5), th, 0.2, 0.2, 0.2, 0.2, 8).select("eid", "technique", "variant", "aug_text")
    assert sorted(a.collect()) == sorted(b.collect())


def test_synonym_table_normalises(spark):
    th = spark.createDataFrame(THESAURUS, "word string, synonym string")
    got = {r.word: r.syns for r in E.synonym_table(th).collect()}
    assert got["dog"] == ["canis familiaris", "hound"]
    assert "hello" in got and got["hello"] == ["hi"]      # self-synonym removed
    assert got["savings"] == ["nest egg"]


def test_no_rows_for_wordless_lines(spark):
    lines = spark.createDataFrame([("x", "123 !!")], "eid string, text string")
    th = spark.createDataFrame(THESAURUS, "word string, synonym string")
    assert E.eda(lines, th, num_aug=4).count() == 0
    _ = F


def test_generated_keys_differ_for_thousands_of_variants(spark):
    from shotweave.operators.eda import _pair
    rows = spark.range(3 * 5000).selectExpr("cast(id % 3 as int) AS line", "cast(floor(id / 3) as int) AS variant")
    assert rows.select(_pair(F.col("line"), F.col("variant"))).distinct().count() == 3 * 5000


CHAIN = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def test_insertions_of_inserted_words(spark, monkeypatch):
    """Only the first word of the chain stands in the line: all others are found by joins of later rounds."""
    th = spark.createDataFrame(list(zip(CHAIN, CHAIN[1:])), "word string, synonym string")
    syn = {a: [b] for a, b in zip(CHAIN, CHAIN[1:])}
    rounds = []
    inner = E.durable
    monkeypatch.setattr(E, "durable", lambda df, name: rounds.append(name) or inner(df, name))
    lines = [("1", "ab " + "x " * 3), ("2", "ab " * 7), ("3", "x y")]
    a = (0.0, 4.0, 0.0, 0.0)
    got = {(r.eid, r.technique, r.variant, r.aug_text)
           for r in E.eda(spark.createDataFrame(lines, "eid string, text string"), th, *a, num_aug=20).collect()}
    want = set().union(*(brute(eid, text, syn, a, 20) for eid, text in lines))
    assert got == want
    longest = max(max((CHAIN.index(w) for w in t.split() if w in CHAIN), default=0) for _, _, _, t in got)
    assert longest >= 5 and len(rounds) >= longest


def test_a_replacement_is_replaced_in_turn():
    seen = set()
    for seeds in [(i, 7 * i + 1) for i in range(20)]:
        out = E.synonym_replace(["cat", "dog"], ["cat", "dog"], 2, {"cat": ["dog"], "dog": ["wolf"]}, seeds)
        u = stream(seeds, 0, 4)
        assert out == (["wolf", "wolf"] if u[0] < u[2] else ["dog", "wolf"])
        seen.add(tuple(out))
    assert len(seen) == 2


def test_stream_equals_plain_integers():
    u = draws("a", 1)
    assert stream(seed_pair("a", 1), 0, 50).tolist() == [u(i) for i in range(50)]
    assert stream(seed_pair("a", 1), 20, 5).tolist() == [u(i) for i in range(20, 25)]


def test_swaps_take_linear_time():
    def seconds(n):
        words = [str(i) for i in range(n)]
        t = time.perf_counter()
        for i in range(100_000 // n):
            E.random_swap(words, n // 10, (i, 5))
        return time.perf_counter() - t
    seconds(100)
    assert min(seconds(10_000) for _ in range(3)) < 2 * min(seconds(100) for _ in range(3))


def test_blocks_of_variants(spark):
    """One line's variants are dealt out over tasks before they are made, and are the same as in one piece."""
    lines = spark.createDataFrame(LINES[:1], "eid string, text string").withColumn("na", F.lit(5000))
    th = spark.createDataFrame(THESAURUS, "word string, synonym string")
    out = E.eda(lines, th, 0.1, 0.0, 0.1, 0.1, F.col("na"))
    assert "REPARTITION" in out._jdf.queryExecution().toString().split("MapInArrow")[-1]
    got = [(r.eid, r.technique, r.variant, r.aug_text) for r in out.collect()]
    assert set(got) == brute(*LINES[0], _syn(), (0.1, 0.0, 0.1, 0.1), 5000) and len(got) == 3 * 1251
    tasks = out.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_upsampling_in_blocks(spark):
    from shotweave.operators.augment import UPSAMPLE_BLOCK, upsample
    p = spark.createDataFrame([("d", "d_a", 1, 0, ["x", "y", "z"], ""), ("d", "d_b", 2, 0, ["w"], "")],
                              "domain string, intent string, intent_id int, prompt_id int, lines array<string>, prompt string")
    n = 10 * UPSAMPLE_BLOCK + 1
    out = upsample(p, spark.createDataFrame([("d", n)], "val_domain string, quota long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("REPARTITION_BY_NUM")  # printed from the top: the emit is above the shuffle
    rows = out.groupBy("intent").agg(F.count("*").alias("n"), F.countDistinct("gen_idx").alias("k"), F.max("gen_idx").alias("last"),
                                     F.count_if(F.col("text") == F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")),
                                                                              (F.col("gen_idx") % 3 + 1).cast("int"))).alias("ok")).collect()
    assert sorted(map(tuple, rows)) == [("d_a", n, n, n - 1, n), ("d_b", n, n, n - 1, 0)]
    none = upsample(p, spark.createDataFrame([("d", 0)], "val_domain string, quota long"))
    assert none.count() == 0
