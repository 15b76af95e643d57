"""Each operator against a plain version on small tables with nulls, ties, repeats, long and empty texts, clashing columns."""

import functools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotweave.llm import (balltree, chat_repair, decontaminate, packing, paragraphs, parity_join, pseudo_lm, site_lines,
                           toxic_segments, url_rules)
from shotweave.llm.common import text_buffer, word_hashes
from shotweave.llm.queries import tokenizer_path

WORDS = [a + b for a in "ba ce di fo gu ha je ki".split() for b in "lan mer nis pot rud sek tav wox".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in t.split())


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    base = [text(rng, n) for n in (0, 1, 4, 5, 9, 40, 150, 700)]
    rows = list(enumerate(base))
    for t in base[3:]:
        rows += [(len(rows) + i, edited(rng, t, s)) for i, s in enumerate((0, 0, 0.01, 0.02, 0.03, 0.06))]
    passage = text(rng, 60)
    rows += [(1000 + i, passage + " " + text(rng, i % 30)) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (None, base[5]), (7, base[7]), (2003, text(rng, 8000))]
    # names that operators use inside must not clash
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")


def shingle_set(t):
    w = t.encode().lower().split() if t else []
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join_equals_all_pairs(documents):
    rows, df = documents
    sets = {}
    for i, t in rows:
        if i is not None and shingle_set(t):
            sets.setdefault(shingle_set(t), []).append(i)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            k = len(keys[a] & keys[b])
            if 100 * k >= 75 * len(keys[a] | keys[b]):
                root[find(a)] = find(b)
    low = {}
    for a, k in enumerate(keys):
        low[find(a)] = min(low.get(find(a), 1 << 60), *sets[k])
    want = sorted((i is None, i, len(shingle_set(t)), None if i is None else low[find(keys.index(shingle_set(t)))]
                   if shingle_set(t) else i) for i, t in rows if i is not None)
    got = parity_join.ngram_jaccard_join(df).collect()
    assert sorted((False, r[0], r[1], r[2]) for r in got if r[0] is not None) == want
    assert [r[2] for r in got if r[0] is None] == [None] and len(got) == len(rows)


def test_set_first_met_without_an_id(spark):
    rng = random.Random(18)
    a = text(rng, 200)
    rows = [(None, a), (3, a), (8, a.replace(a.split()[100], "other", 1)), (9, text(rng, 200))]
    got = parity_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {None: None, 3: 3, 8: 3, 9: 9}


@pytest.mark.parametrize("other", [None, "", "shared"])
def test_ids_with_several_sets(spark, other):
    rng = random.Random(19)
    rows, want = [], {}
    for i in range(12):
        a, b = text(rng, 150), text(rng, 150) if other == "shared" else other
        # the row with the other set stands first; where it has words, a smaller id has it too
        rows += [(500 + i, b), (500 + i, a), (900 + i, a.replace(a.split()[70], "changed", 1))]
        rows += [(i, b)] if other == "shared" else []
        want[900 + i] = 500 + i
    got = parity_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id >= 900} == want
    assert len(got) == len(rows)


def test_join_of_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert parity_join.ngram_jaccard_join(none).count() == 0


def test_blocks_meet_for_every_linked_pair():
    rng = np.random.default_rng(2)
    freq = np.zeros(1 << parity_join.FREQ_BITS, np.int32)
    for n in (1, 2, 4, 7, 15, 16, 63, 64, 200, 255, 256, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            d = int(rng.integers(0, n // 7 + 1))
            b = np.unique(np.r_[a[d:], rng.integers(0, 1 << 63, d).astype(np.uint64)])
            k = len(np.intersect1d(a, b))
            if 100 * k >= 75 * (len(a) + len(b) - k):
                assert np.intersect1d(parity_join.block_tokens(a, freq, 75), parity_join.block_tokens(b, freq, 75)).size


def test_paragraphs(spark):
    rng = random.Random(5)
    p, q = text(rng, 60), text(rng, 80)
    near = edited(rng, p, 0.02)
    rows = [(1, f"{text(rng, 40)}\n{p}\n{text(rng, 5)}"), (2, f"{near}\n{text(rng, 50)}"), (3, p), (4, q), (5, None), (6, ""),
            (7, "short line\n" * 5), (None, p)]
    got = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.para, r.class_doc_id, r.class_para, r.class_size, r.removed) for r in got) == [
        (1, 1, 1, 1, 3, False), (2, 0, 1, 1, 3, True), (3, 0, 1, 1, 3, True)]
    assert paragraphs.tune_bands(75) == (16, 3)


def test_passages_of_short_lines_and_inside_long_ones(spark):
    rng = random.Random(15)

    def lines(t, n):
        w = t.split()
        return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    p, q, whole = text(rng, 60), text(rng, 60), text(rng, 64)
    long = text(rng, 400)
    rows = [(1, f"{text(rng, 70)} {p} {text(rng, 70)}"), (2, f"{text(rng, 90)} {p} {text(rng, 50)}"),  # inside long lines
            (3, lines(f"{text(rng, 33)} {q} {text(rng, 12)}", 9)), (4, f"{text(rng, 8)} {q} {text(rng, 31)}"),  # short lines, a line
            (5, lines(whole, 7)), (6, lines(whole, 25)),  # a text laid out in two ways
            (7, lines(long, 11)), (8, lines(edited(rng, long, 0.01), 8)),  # an edited copy
            (9, text(rng, 200)), (10, "one two " * 200), (None, f"{p} {q}")]
    got = paragraphs.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {i: t.split() for i, t in rows if i is not None}
    for a, b in ((1, 2), (3, 4), (5, 6), (7, 8)):
        assert {r.class_doc_id for r in got if r.doc_id in (a, b)} == {a}
        assert {r.removed for r in got if r.doc_id == b} == {True} and not any(r.removed for r in got if r.doc_id == a)
    assert not any(r.doc_id in (9, None) for r in got)
    for r in got:
        own = words[r.doc_id][r.first_word:r.first_word + r.n_words]
        assert len(own) == r.n_words and r.para == next(
            i for i in range(500) if sum(len(x.split()) for x in dict(rows)[r.doc_id].split("\n")[:i + 1]) > r.first_word)
        if r.doc_id == 2 or r.doc_id == 4:
            assert own == words[r.class_doc_id][r.class_first_word:r.class_first_word + r.n_words]
    assert sum(r.n_words for r in got if r.doc_id == 6) == 64


def test_every_common_passage_holds_a_common_window():
    rng = np.random.default_rng(16)
    for _ in range(200):
        both = rng.integers(1, 1 << 62, 50).astype(np.uint64)
        found = []
        for _ in range(2):
            a, z = (rng.integers(1, 1 << 62, int(rng.integers(0, 90))).astype(np.uint64) for _ in range(2))
            words = np.r_[a, both, z]
            run = paragraphs._runs(words, 5)
            at = paragraphs.window_places(run, np.array([0, len(words)]), 30, 50, 5)
            found.append({bytes(words[i:i + 30]) for i in at})
        assert found[0] & found[1]


def test_ball_tree(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(float)
    v[200:260] = v[3]
    rows = [(int(i), v[i].tolist()) for i in range(300)] + [(400, None), (401, [None] + [0.0] * 7), (402, [float("nan")] * 8),
                                                          (None, v[0].tolist()), (403, [])]
    got = balltree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    w = np.floor(256 * v).astype(int)
    for q in range(0, 300, 50):
        s = sorted((-int(w[q] @ w[i]), i) for i in range(300) if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -x) for x, i in s]
    assert len(got) == 30


def cheapest(roles):
    """Least cost by plain enumeration of states."""
    best = {chat_repair.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for cost, t, *_ in chat_repair.ACTIONS[r][s]:
                new[t] = min(new.get(t, 1 << 30), c + cost)
        best = new
    return min(c + chat_repair.CLOSING[s][0] for s, c in best.items())


def test_chat_repair(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), f"t{c}.{t}") for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(["user", "assistant"]), None) for t in range(400)] + [(None, 0, "user", "x"), (98, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_repair.repair_chats(df).collect()
    by = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((c, t, r, x))
    for c, own in by.items():
        whole = chat_repair.repair(own)
        assert sum(r[5] for r in whole) == cheapest([chat_repair.role_code(r[2]) for r in own])
        # conversations cut by ranges come out as in one piece
        assert sorted(map(repr, whole)) == sorted(repr(tuple(r)) for r in got if r.conv_id == c)
    assert len(got) == len(rows) - 1


def test_segments_equal_all_subarrays():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.choice([-2.0, -0.5, 1.0, 1.5], 14)
        got = toxic_segments.maximal_segments(s)
        best = max([s[a:b].sum() for a in range(14) for b in range(a + 1, 15)])
        assert (max((g[2] for g in got), default=0) == pytest.approx(max(best, 0))) and all(
            g[1] <= h[0] for g, h in zip(got, got[1:], strict=False))


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        w = text(rng, rng.randint(20, 80)).split()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "vilex" + rng.choice(["a", "on", "ed", "um"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None)], "doc_id long, toxic int")
    model = toxic_segments.fit_segments(docs, labels.where(~toxic_segments.held_out("doc_id")))
    got = {r.doc_id: r.score for r in toxic_segments.score_toxicity(docs, model).collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert out and all((got[i] >= 0.3) == (i % 5 == 0) for i in out)
    assert got[9000] == got[9001] < 0.3
    empty = toxic_segments.fit_segments(docs, labels.where("false"))
    assert toxic_segments.score_toxicity(docs, empty).count() == len(rows) + 3


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(8)
    rows = [(i, ". ".join(text(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a  b \n  c   "), (103, "é  x\n\ny "), (7, "again"), (None, "z"), (104, "word" * 9000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                   for ids in want[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(9)
    for _ in range(40):
        places = np.unique(rng.integers(1, 60, 14))
        pen = rng.choice([0, 4, 64], len(places))
        pen[-1] = 0
        size = 16
        every = np.unique(np.r_[places, np.arange(8, places[-1], 8)])
        penalty = np.full(len(every), 64)
        penalty[np.searchsorted(every, places)] = pen
        p, cost = [0, *every.tolist()], [0]

        def window(n):
            return packing.WINDOW_COST + (0 if n & (n - 1) == 0 else size - n)

        for j in range(1, len(p)):
            cost.append(min(cost[i] + window(p[j] - p[i]) for i in range(j) if p[j] - p[i] <= size) + int(penalty[j - 1]))
        cuts = packing.cut_stream(int(every[-1]), every, penalty, size)
        got = sum(window(int(b - a)) for a, b in zip(cuts, cuts[1:], strict=False)) + int(penalty[np.searchsorted(every, cuts[1:])].sum())
        assert got == cost[-1]


def test_decontamination(spark):
    rng = random.Random(10)
    items = [(i, text(rng, n)) for i, n in enumerate((3, 12, 25, 50, 50))] + [(None, "x"), (9, None)]
    docs = [(1, text(rng, 100)), (2, f"{text(rng, 30)} {items[2][1].upper()}, {text(rng, 20)}"), (3, edited(rng, items[3][1], 0.1)),
            (4, None), (5, ""), (6, text(rng, 9000) + " " + items[1][1]), (None, items[4][1]), (7, items[4][1]), (7, items[4][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(2, 2), (3, 3), (6, 1), (7, 4)]
    assert {r.doc_id: r.edits for r in got if r.doc_id != 3} == {2: 0, 6: 0, 7: 0}
    assert decontaminate.recall(30, 6, 100) >= 0.95


def test_item_that_repeats_its_opening_at_a_texts_start():
    rng = random.Random(17)

    def words(t):
        return next((w, first) for _, w, first in decontaminate.text_words(pa.array([t])))

    for _ in range(20):
        opening, rest = text(rng, 10), [f"{text(rng, 1)}{i}" for i in range(30)]
        item = f"{opening} {' '.join(rest)} {opening}"
        own, first = words(item)
        index = decontaminate.ItemIndex(np.array([0]), own, first, 8, 0.2).parts()
        for lead in (0, 1, 4, 9, 30):
            t = " ".join(f"lead{i}" for i in range(lead)) + f" {item} " + text(rng, 40)
            assert decontaminate.matches(index, *words(t)) == [(0, 0, 0, lead, 50)]


def test_site_lines(spark):
    rows = [(i, f"head {i}\nshared by all \nfoot", f"s{i % 12}") for i in range(24)] + [
        (50, "only\nshared by all", None), (51, None, "s1"), (52, "", "s1"), (53, "shared by all", "s2"), (None, "x\nfoot", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in site_lines.remove_site_lines(df, 12, counts=True).collect()}
    assert got[3].text == "head 3" and got[3].removed == [1, 2] and got[3].n_lines == 3
    assert got[50].text == "only" and got[51].text is None and got[52].text == "" and got[53].text == "" and got[None].text == "x"
    assert site_lines.remove_site_lines(df, 13).where("text = 'head 3'").count() == 0


def test_url_rules(spark):
    rng = random.Random(11)
    hosts = ["net", "a.net", "x.example.net", "example.net", "EXAMPLE.org", "notexample.net", "b.org", ""]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/fr/1', '?q=/en/', '#/x'])}" for _ in range(300)]
    urls += [None, "no scheme", "https://x.example.net/en/a"] + ["https://hot.net/"] * 200
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "block"), (None, "/", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.match_rules(
        df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules[:3] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"), u


def test_pseudo_likelihood_prefers_real_order(spark):
    rng = random.Random(12)
    line = text(rng, 40)
    rows = [(i, edited(rng, line, 0.05)) for i in range(400)] + [(900, " ".join(sorted(line.split()))), (901, None), (902, ""), (None, line)]
    got = {r.doc_id: r for r in pseudo_lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None].mean_log_likelihood > got[900].mean_log_likelihood
    assert got[901].n_tokens == 0 and got[901].log_likelihood == 0 and got[902].mean_log_likelihood is None
    w = pseudo_lm.start_weights(np.ones(pseudo_lm.VOCABULARY))
    ids, first = np.array([1, 2, 3, 4, 5], np.int16), np.array([0, 3, 5])
    around = pseudo_lm.contexts(ids, first)
    assert around[:, 0].tolist() == [pseudo_lm.EDGE, pseudo_lm.EDGE, 2, 3] and around[2, 2] == pseudo_lm.EDGE
    g, eps = pseudo_lm.gradients(w, ids, around), 1e-2
    up = {k: v.copy() for k, v in w.items()}
    up["embed"][3, 2] += eps
    slope = (pseudo_lm.forward(up, ids, around)[0].mean() - pseudo_lm.forward(w, ids, around)[0].mean()) / eps
    assert slope == pytest.approx(float(g["embed"][3, 2]), abs=1e-3)


@functools.cache
def hashed(w):
    return int(word_hashes(*text_buffer(pa.array([w])))[0][0])


def plain_score(model, t, counts):
    """Sum of the log-probabilities of the words of ``t``, word by word, with plain softmaxes."""
    v, w = model.vocabulary, model.weights
    known = dict(zip(v.known.tolist(), v.rank.tolist()))
    group = Counter()
    for word, n in counts.items():
        if hashed(word) not in known:
            group[hashed(word) >> 56] += n + 1
    words = t.lower().split()
    ids = [known.get(hashed(x), pseudo_lm.WORDS + (hashed(x) >> 56)) for x in words]
    total = 0.0
    for i, token in enumerate(ids):
        near = [ids[i + o] if 0 <= i + o < len(ids) else pseudo_lm.EDGE for o in pseudo_lm.AROUND]
        h = np.tanh(w["hidden"] + sum(w["embed"][x] * w["place"][k] for k, x in enumerate(near)))
        c = np.exp(w["class_w"] @ h + w["class_b"])
        own = np.exp(w["word_w"][token // 32] @ h + w["word_b"][token // 32])
        total += np.log(c[token // 32] / c.sum()) + np.log(own[token % 32] / own.sum())
        if token >= pseudo_lm.WORDS:
            total += np.log((counts[words[i]] + 0.5) / max(group[token - pseudo_lm.WORDS], 1))
    return total


@pytest.mark.parametrize("kept", [1 << 20, 300])
def test_pseudo_likelihood_equals_plain_scores(spark, monkeypatch, kept):
    monkeypatch.setattr(pseudo_lm, "KEPT", kept)
    rng = random.Random(23)
    words = [a + b + c for a in WORDS for b in ("ra", "lo", "") for c in WORDS[:8]]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=60)) + f" once{i}") for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[3][1]), (7, rows[9][1]), (503, rows[9][1].upper()),
             (504, " ".join(rng.choice(words) for _ in range(3000)))]
    # an operator's own names must not clash with further columns
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, rest string, row int, n int")
    counts = Counter(w for _, t in rows for w in (t or "").lower().split())
    model = pseudo_lm.fit(df)
    got = pseudo_lm.score(df, model).collect()
    want = sorted((i is None, i or 0, len((t or "").split()), round(plain_score(model, t or "", counts), 1)) for i, t in rows)
    assert [w[:3] for w in want] == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got)
    for r, w in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.log_likelihood)), want):
        assert r.log_likelihood == pytest.approx(w[3], abs=0.06 + 1e-5 * abs(w[3]))
    new = spark.createDataFrame([(1, "never seen words"), (2, " ".join(words[-3:])), (3, "")], "doc_id long, text string")
    other = {r.doc_id: r.log_likelihood for r in pseudo_lm.score(new, model).collect()}
    assert other == {1: pytest.approx(plain_score(model, "never seen words", counts), abs=0.01),
                     2: pytest.approx(plain_score(model, " ".join(words[-3:]), counts), abs=0.01), 3: 0}
    assert pseudo_lm.pseudo_likelihood(df.limit(0)).count() == 0


def test_garbled_words_score_below_rare_ones(spark):
    rng = random.Random(24)
    common, rare = [f"c{k}" for k in range(900)], [f"r{k}" for k in range(600)]
    rows = [(i, " ".join(rng.choices(common, k=80) + rng.sample(rare, 6))) for i in range(400)]
    rows += [(1000, " ".join(rng.sample(rare, 40))), (1001, " ".join(f"g{k}x" for k in range(40)))]
    got = {r.doc_id: r.mean_log_likelihood for r in
           pseudo_lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1001] < got[1000] - 0.5


def test_components_joined_later(spark):
    from shotweave.llm.graph import components, joined

    first = [(1, 5), (5, 9), (2, 6), (20, 21)]
    later = [(9, 6), (30, 2), (40, 41), (5, 1)]
    label = joined(components(spark.createDataFrame(first, "a long, b long")), spark.createDataFrame(later, "a long, b long"))
    at_once = components(spark.createDataFrame(first + later, "a long, b long"))
    assert sorted(map(tuple, label.collect())) == sorted(map(tuple, at_once.collect()))
    assert dict(map(tuple, label.collect()))[30] == 1


def test_pipeline_decides_row_by_row(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(20)

    def toxic(t):
        w = t.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), "vilex" + rng.choice(["a", "on", "ed", "um"]))
        return " ".join(w)

    base = [text(rng, rng.randint(20, 80)) for _ in range(400)]
    base = [toxic(t) if i % 5 == 0 else t for i, t in enumerate(base)]
    item, alone = text(rng, 25), text(rng, 60)
    rows = list(enumerate(base)) + [
        (None, toxic(text(rng, 50))), (None, text(rng, 50)), (None, f"{text(rng, 9)} {item}"), (None, base[21]), (None, alone),
        (None, alone), (11, text(rng, 50)), (11, toxic(text(rng, 50))), (12, f"{item} {text(rng, 30)}"), (13, base[14]),
        (16, base[16]), (16, base[16]), (17, ""), (17, ""), (None, None), (18, base[9] + " more")]
    rows = [(i, t if n % 30 else f"{t}\nfoot of many sites", f"s{n % 17}") for n, (i, t) in enumerate(rows)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(20, 400)], "doc_id long, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if "vilex" not in (r[1] or "")]
    sites = {}
    for _, t, source in left:
        for line in (t or "").split("\n"):
            sites.setdefault(line, set()).add(source)
    left = [(i, t and "\n".join(x for x in t.split("\n") if not x or len(sites[x]) < 10)) for i, t, _ in left]
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    kept = []
    for i, t in left:  # copies here are copies of a kept row
        own = shingle_set(t)
        if not any(own and 100 * len(own & k) >= 75 * len(own | k) for _, _, k in kept):
            kept.append((i, t, own))
    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted((i is None, i or 0, len(tok.encode(t or "", add_special_tokens=False).ids) + 1)
                  for i, t, _ in kept if item not in (t or ""))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n for *_, n in want)


def test_site_lines_keep_columns_of_any_name(spark):
    rows = [(i, f"same line\nown {i}", f"s{i % 12}", i, "g", 7, "r", 1) for i in range(24)]
    rows += [(99, None, None, 0, "g", 7, "r", 1), (98, "", "s1", 0, "g", 7, "r", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `__row` int, `__gone` string, n_lines int, removed string, h int")
    out = site_lines.remove_site_lines(df, 12)
    assert out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[5].text == "own 5" and got[5]["__row"] == 5 and got[5]["__gone"] == "g" and got[5].n_lines == 7
    assert got[99].text is None and got[98].text == ""
    assert site_lines.remove_site_lines(df.limit(0), 12, counts=True).count() == 0
    counted = {r.doc_id: (r.n_lines, r.removed) for r in site_lines.remove_site_lines(df, 12, counts=True).collect()}
    assert counted[5] == (2, [0]) and counted[98] == (0, []) and counted[99][1] == []


def test_site_lines_of_very_long_texts(spark):
    import time

    def seconds(n):
        t = "\n".join(f"boilerplate {i}" for i in range(n))
        df = spark.createDataFrame([(i, t + f"\nown {i}", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
        start = time.perf_counter()
        assert {r.text for r in site_lines.remove_site_lines(df, 12).collect()} == {f"own {i}" for i in range(12)}
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(30_000) < 2.2 * seconds(15_000) + 1


def test_fit_and_score_use_the_same_evidence(spark):
    """A text of 200 toxic passages between clean ones, beside short ones: its evidence isn't cut when fitting."""
    rng = random.Random(31)
    bad = ["vilgrax", "morbidoo", "snarkling"]
    long = " ".join(text(rng, 120) + " " + " ".join(rng.choice(bad) for _ in range(4)) for _ in range(200))
    rows = [(0, long, 1)] + [(i, text(rng, 40) + (" " + " ".join(rng.choice(bad) for _ in range(6)) if i % 4 == 0 else ""), int(i % 4 == 0))
                             for i in range(1, 200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxic_segments.fit_segments(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxic_segments.score_toxicity(docs, model).collect()}
    assert len(got[0].passages) > 150
    x = sum(model.lam * p.score - np.log(model.k * len(long.split())) for p in got[0].passages)
    assert abs(model.at[-1] - x) < 1e-6 * x  # the last step of the fit ends at the evidence by which the text is scored
    assert toxic_segments.score_toxicity(docs.limit(0), model).count() == 0
    twice = docs.unionByName(docs).withColumn("score", F.lit("x")).withColumn("lang", F.lit("de"))
    assert {r.doc_id: r.score for r in toxic_segments.score_toxicity(twice, model).collect()} == {i: r.score for i, r in got.items()}
    assert docs.limit(1).select(toxic_segments.held_out("text")).first()[0] in (True, False)
    null = spark.createDataFrame([(None,)], "doc_id long").select(toxic_segments.held_out("doc_id")).first()[0]
    assert null is False


def all_segments(s):
    """Maximal scoring segments by their definition: the best segment, then the same on both sides of it."""
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    return all_segments(s[:a]) + [(a, b)] + [(b + x, b + y) for x, y in all_segments(s[b:])]


def test_all_maximal_segments():
    rng = np.random.default_rng(6)
    for _ in range(150):
        s = rng.standard_normal(rng.integers(0, 14)).round(3)
        assert sorted((a, b) for a, b, _ in toxic_segments.maximal_segments(s)) == all_segments(s.tolist())


def test_helpers_go_when_the_next_stage_begins(spark):
    from shotweave.llm import common
    df = spark.range(5)
    outside = common.durable(df, "outside")
    with common.recorded():
        a, b = common.durable(df, "a"), common.durable(df, "b")
    common.drop_helpers(a)
    assert a.count() == 5 and outside.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        b.count()
    common.drop_helpers(df)
    assert common.free_name(spark.createDataFrame([(1, 2)], "k int, _K int"), "k") == "__k"
