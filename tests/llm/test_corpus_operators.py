"""The corpus operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframes.llm import common, context_mixing, html_extraction, ngram_join, piece_lattice, quality_rules, source_mixing, token_store, url_filters, vector_graphs, warc_bundles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class string"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(LOREM, n).tolist())


def documents(spark, texts, ids=None):
    """Rows with extra columns whose names clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, len(t or ""), None, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


ODD = [None, "", "   \n\t", "one", "ab " * 4000, text(1, 60), text(1, 60), "é ü a b", "x" * 5000, text(2, 40) + "\n" + text(2, 40)]


@pytest.fixture(scope="module")
def odd(spark):
    d = documents(spark, ODD + [text(3, 30)], [*range(len(ODD)), None])
    return d.union(d.filter("doc_id = 5"))


# ---- quality rules


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 500 else {i + k for i in range(len(grams)) for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_measures(odd):
    for r in quality_rules.judge(odd).collect():
        if r["doc_id"] is None:
            continue
        want = brute_quality(ODD[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality_rules.judge(odd).count() == len(ODD) + 2


def test_hosts_are_shrunk_and_rejected(spark):
    rows = [(i, "bad" if i < 60 else "good", "a b" if i < 55 or i == 99 else text(i, 30)) for i in range(160)] + [(200, "tiny", "a b"), (201, "tiny", text(7, 30))]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    assert not got[57]["kept"] and not got[57]["base_failed"] and got[120]["kept"] and got[201]["kept"]
    k, n = got[200]["host_failed"], got[200]["host_docs"]
    assert k / n > got[200]["host_rate"] > 0
    kept = quality_rules.keep(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_texts_are_shuffled_for_long_lists_only(spark):
    d = spark.createDataFrame([(i, "bad" if i < 60 else None, "a b" if i < 55 else text(i, 30)) for i in range(90)], "doc_id long, source string, text string")
    plans, kept = [], []
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            out = quality_rules.keep(d)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            kept.append(sorted(r["doc_id"] for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert kept[0] == kept[1] == list(range(60, 90))
    assert "Exchange hashpartitioning" not in plans[0] and "Exchange hashpartitioning" in plans[1]


def test_prior_strength_bounds():
    assert quality_rules.prior_strength(0, 0, 0, 0, 0) == (0.0, quality_rules.MAX_STRENGTH)
    assert quality_rules.prior_strength(2, 20, 0, 200, 0)[1] == quality_rules.MAX_STRENGTH
    assert quality_rules.prior_strength(2, 200, 100, 20000, 100.0)[1] == quality_rules.MIN_STRENGTH


# ---- near duplicates


def brute_links(texts):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [grams(t) for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(s)), 2) if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}


def near_copies(n, words, changes, seed):
    rng = np.random.default_rng(seed)
    base = text(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[int(rng.integers(len(w)))] = f"w{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_links_equal_brute_force(spark, monkeypatch):
    texts = ODD + near_copies(25, 120, 2, 11) + near_copies(10, 60, 2, 12) + near_copies(4, 300, 12, 13) + [text(i, 80) for i in range(20, 40)] + [text(21, 80)] * 3
    want = brute_links(texts)
    for weight in (ngram_join.BLOCK_WEIGHT, 1500):  # one block, and many
        monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", weight)
        got = {r["doc_id"]: r for r in ngram_join.near_duplicates(documents(spark, texts)).collect()}
        n, label = dict.fromkeys(range(len(texts)), 0), list(range(len(texts)))
        for i, j in want:
            n[i] += 1
            n[j] += 1
        changed = True
        while changed:
            changed = False
            for i, j in want:
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
        assert {i: r["n_links"] for i, r in got.items()} == n
        assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(label))


def test_one_of_each_class_stays(spark, odd):
    kept = ngram_join.keep_one(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9] and None in ids
    empty = odd.limit(0)
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_null_and_repeated_ids_take_part(spark):
    a, b, c = text(1, 40), text(2, 40), text(3, 40)
    near = a + " more"
    rows = [(None, a), (None, a), (5, near), (5, a), (7, b), (7, b + " more"), (None, c), (None, c), (None, ""), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 5, 3)] * 2 + [(5, 5, 3)] * 2 + [(7, 7, 1)] * 2 + [(None, None, 1)] * 2 + [(None, None, 0)] + [(9, 9, 0)] * 2, key=repr)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted((rows[r["place"]] for r in kept.collect()), key=repr)
    assert [x for x in left if x[0] == 5] in ([(5, a)], [(5, near)]) and len([x for x in left if x[0] == 7]) == 1
    assert [x for x in left if x[0] not in (5, 7)] == sorted([(9, None)] * 2 + [(None, c), (None, "")], key=repr)


def test_bands_reach_the_recall():
    b, r = ngram_join.plan_bands()
    assert 1 - (1 - 0.8**r) ** b >= ngram_join.RECALL and b * r <= ngram_join.MAX_HASHES


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["u"]: r["v"] for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {a: b for a, b in label.items() if a != b}


def test_long_words_and_overlaps():
    assert len(ngram_join.word_hashes("a" * 200_000 + " b")) == 2
    assert ngram_join.word_hashes("a" * 65536 + "b")[0] != ngram_join.word_hashes("b" + "a" * 65536)[0]
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, 80).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert np.array_equal(ngram_join.overlaps(sets), want)


# ---- context mixing


def test_scores(spark, odd):
    got = context_mixing.score(odd).collect()
    assert len(got) == len(ODD) + 2
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    train = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    tokens = [w for t in train for w in [*(t or "").encode().lower().split(), None]]
    n, v = len(tokens), len(set(tokens))
    by = {i: t for i, t in rows}
    for r in got:
        own = [*(by[r["doc_id"]] or "").encode().lower().split(), None]
        want = sum(math.log10((tokens.count(w) + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(w in tokens for w in own)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["score"] < 0
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    assert context_mixing.score(odd.limit(0)).count() == 0


def test_held_out_text_beats_the_base(spark):
    def chain(seed):  # each word tells the next but for one in ten
        rng, w, out = np.random.default_rng(seed), 0, []
        for _ in range(200):
            w = int(rng.integers(len(LOREM))) if rng.random() < 0.1 else (5 * w + 7) % len(LOREM)
            out.append(LOREM[w])
        return " ".join(out)

    d = documents(spark, [chain(i) for i in range(120)])
    s = context_mixing.score(d).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert s[0] > s[1] and s[2] < 1.2


def code_of(texts):
    data = np.frombuffer(b"".join(b"\0\0" + t + b"\0" for t in texts), np.uint8).astype(int)
    alone = np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16).reshape(256, 256)
    pairs = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        pairs.setdefault(int(a << 8 | b), np.zeros(256, int))[c] += 1
    return context_mixing.Code(alone, {k: v for k, v in pairs.items() if v.sum() > 40})


def replies_to(blocks, code, bits):
    """Each block's replies by kind, as the buckets give them."""
    import zstandard

    sent = {}
    for i, (training, texts) in enumerate(blocks):
        for kind, bucket, packed in context_mixing.messages(texts, training, code, bits):
            sent.setdefault((kind, bucket), []).append((i, packed))
    out = [[[] for _ in context_mixing.FEWER] for _ in blocks]
    for (kind, _), rows in sorted(sent.items()):
        found = context_mixing.word_answers([x for _, x in rows])[0] if kind == context_mixing.WORDS else context_mixing.answers([x for _, x in rows])
        for (i, _), x in zip(rows, found, strict=True):
            out[i][kind].append(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int8))
    return [[np.concatenate(x) for x in found[: context_mixing.WORDS]] for found in out]


def plain_bits(t, code):
    """(bit, its context nodes by column) of a text, by the docstring."""
    data, out, unit, before, word = t + b"\0", [], b"", b"", b""
    prev = 0
    for at, c in enumerate(data):
        back = b"\0\0\0\0" + bytes([prev]) + unit
        tree = prev if not unit else int(code.tree[back[-2] << 8 | back[-1]])
        n, bits = int(code.lens[tree << 8 | c]), int(code.codes[tree << 8 | c])
        path = tuple(bits >> (n - 1 - k) & 1 for k in range(n))
        if not unit:
            first, open_ = (), True
        open_ = open_ and len(unit) < context_mixing.LETTERS and (not unit or len(first) + n < context_mixing.PATH_BITS)
        for k, bit in enumerate(path):
            near = ("pair", before, first + path[:k]) if open_ else ("four", back[-4:], path[:k])
            out.append((bit, [(i, back[-i:], path[:k]) for i in (2, 3, 5)] + [("unit", tree, unit, path[:k]), near], ("four", back[-4:], path[:k])))
        if open_:
            first += path
        unit += bytes([c])
        if c in b" \t\n\r\x0b\x0c" or at == len(data) - 1:
            before, unit, prev = (unit[:-1] or before), b"", c
    return out


def plain_score(bits, odds):
    """log2 probability, a bit at a time; what is learnt of a step is used from the next step on."""
    cm = context_mixing
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    w = [[*cm.START, 0.0] for _ in range(cm.GATES)]
    curve = [[cm.PRIOR] * 6 for _ in range(cm.GATES)]
    hits = [[sigmoid((b - cm.BUCKETS // 2) / 2) * cm.APM_PRIOR for b in range(cm.BUCKETS)] for _ in range(cm.GATES)]
    seen = [[cm.APM_PRIOR] * cm.BUCKETS for _ in range(cm.GATES)]
    total, at = 0.0, 0
    while at < len(bits):
        step = 64 if at < 2048 else 128 if at < 8192 else 512
        slope, sway, took = [[0.0] * 6 for _ in w], [0.0] * len(w), []
        square = [0.0] * 6
        width = min(step, len(bits) - at)
        for y, o in zip(bits[at : at + step], odds[at : at + step]):
            x = [v / cm.SCALE for v in o] + [3 / cm.SCALE]
            g = sum(v != 0 for v in o[2:])
            z = max(-12.0, min(12.0, sum(a * b for a, b in zip(w[g], x))))
            p = sigmoid(z)
            b = int(max(0, min(cm.BUCKETS - 1, np.rint(np.float32(2 * z)) + cm.BUCKETS // 2)))
            fine = (p + hits[g][b] / seen[g][b]) / 2
            total += math.log2(max(1e-6, fine if y else 1 - fine))
            took.append((g, b, y))
            sway[g] += p * (1 - p)
            for k in range(6):
                slope[g][k] += (y - p) * x[k]
                square[k] += x[k] * x[k] / width
        for g in range(len(w)):
            for k in range(6):
                curve[g][k] += sway[g] * square[k]
                w[g][k] += cm.RATE * slope[g][k] / curve[g][k]
        for g, b, y in took:
            hits[g][b] += y
            seen[g][b] += 1
        at += step
    return total


def test_scores_equal_a_plain_model():
    """Counts, cross-fitting by block and mixing against dictionaries and loops."""
    rng = np.random.default_rng(9)
    texts = [text(i, 60).encode() for i in range(8)] + [b"", b"x" * 700, "é ü  ab\n\ncd".encode() * 20, bytes(rng.integers(0, 256, 300, dtype=np.uint8)), b"alpha beta " * 300]
    texts += [texts[0]]  # a copy, in another block
    blocks = [(True, texts[:5]), (True, texts[5:10]), (False, texts[10:12]), (True, texts[12:])]
    code = code_of([t for training, ts in blocks if training for t in ts])
    counts = [{} for _ in blocks]
    for own, (training, ts) in zip(counts, blocks, strict=True):
        for t in ts if training else ():
            for bit, nodes, four in plain_bits(t, code):
                for node in {*nodes, four}:
                    own.setdefault(node, [0, 0])[bit] += 1

    def odds(node, block):
        zeros, ones = (sum(c.get(node, (0, 0))[k] for i, c in enumerate(counts) if i != block) for k in (0, 1))
        return max(-127, min(127, int(np.rint(math.log((ones + 0.4) / (zeros + 0.4)) * context_mixing.SCALE))))

    for bits in ([0] * 7, [2, 0, 3, 1, 0, 2, 1]):
        for b, ((_, ts), found) in enumerate(zip(blocks, replies_to(blocks, code, bits), strict=True)):
            got = context_mixing.score_texts(context_mixing.Block(ts, code), found)
            for t, x in zip(ts, got.tolist(), strict=True):
                rows = plain_bits(t, code)
                want = plain_score([r[0] for r in rows], [[odds(n, b) for n in r[1]] for r in rows])
                assert abs(x - want) < 2e-3 * max(1, abs(want)), (t[:20], x, want)


def test_codes_and_entries():
    code = code_of([text(i, 80).encode() for i in range(4)])
    for tree in range(len(code.lens) // 256):
        assert abs(sum(2.0 ** -code.lens[256 * tree : 256 * tree + 256].astype(float)) - 1) < 1e-9
    assert code.lens.max() <= 21
    keys, path, n = np.array([5, 5, 9], np.uint64), np.array([3, 1 << 29, 7], np.uint32), np.array([1, 0, 70000])
    assert all(np.array_equal(a, b) for a, b in zip(context_mixing.unpack(context_mixing.pack(keys, path, n)), (keys, path, n), strict=True))
    assert context_mixing.path_lengths(np.array([1 << 29, 1, 3 << 28], np.uint32)).tolist() == [0, 29, 1]
    assert context_mixing.unpack_words(context_mixing.pack_words([b"a", b"bc"], np.array([3, 4])))[0] == [b"a", b"bc"]
    # the slower order of very many bytes gives the same entries
    block = context_mixing.Block([text(i, 300).encode() for i in range(3)], code)
    h = next(block.contexts())
    fast = block.entries(h, True)
    bits, context_mixing.FAST_BITS = context_mixing.FAST_BITS, 1
    try:
        assert sorted(zip(h[fast[0]].tolist(), block.ranks[fast[0]].tolist(), fast[1].tolist())) == sorted(zip(*((h[a].tolist(), block.ranks[a].tolist(), b.tolist()) for a, b in [block.entries(h, True)]).__next__()))
    finally:
        context_mixing.FAST_BITS = bits


def test_probabilities_of_all_continuations_sum_to_one():
    """With the end mark, the shares of all one-byte texts and their extensions can't exceed 1."""
    texts = [bytes([b]) for b in range(1, 256)] + [b""]
    code = code_of([b"abcabcab"])
    blocks = [(False, texts), (True, [b"abcabcab"])]
    got = context_mixing.score_texts(context_mixing.Block(texts, code), replies_to(blocks, code, [0] * 7)[0])
    assert sum(2.0**x for x in got.tolist()) <= 1 + 1e-6


def test_copies_score_apart(spark):
    rng = np.random.default_rng(4)
    own = lambda: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60))
    texts = [own() for _ in range(60)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in context_mixing.score(documents(spark, texts + texts[:5])).collect()}
    train = [i for i in range(5) if all(zlib.crc32(str(x).encode()) % 5 != 1 for x in (i, 60 + i))]
    assert train and max(got[i] for i in train) < 0.7 * min(got[i] for i in range(5, 60))


def test_long_text_and_small_blocks(spark, monkeypatch):
    d = documents(spark, [text(i, 200) for i in range(30)] + [text(99, 60_000), None, ""])
    assert context_mixing.score(d).count() == 33
    monkeypatch.setattr(context_mixing, "GROUP_BITS", 1000)
    monkeypatch.setattr(context_mixing, "CHUNK_BYTES", 100)
    code = code_of([text(1, 50).encode()])
    few = [text(i, 40).encode() for i in range(5)] + [b""]
    blocks = [(True, few), (True, [text(7, 90).encode()])]
    small = context_mixing.score_texts(context_mixing.Block(few, code), replies_to(blocks, code, [1] * 7)[0])
    monkeypatch.undo()
    assert np.allclose(small, context_mixing.score_texts(context_mixing.Block(few, code), replies_to(blocks, code, [1] * 7)[0]), rtol=1e-5)


# ---- vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def test_neighbours_have_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:140] = x[7]
    d = vectors(spark, [(i, v.tolist(), 0, None) for i, v in enumerate(x)])
    got = {}
    index = vector_graphs.build_index(d, shard_rows=400)
    for r in vector_graphs.nearest(d.filter("vec_id % 50 = 0"), index).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    wide = x.astype(float)
    unit = np.sqrt((wide * wide).sum(1))
    hits = 0
    for q in range(0, 1500, 50):
        s = wide @ wide[q] / (unit * unit[q])
        order = [i for i in sorted(range(1500), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        hits += len(set(order) & {v for v, _ in got[q].values()})
        assert all(abs(s[v] - c) < 1e-9 for v, c in got[q].values()) and sorted(got[q]) == [1, 2, 3, 4, 5]
    assert hits / 150 > 0.97
    assert [got[100][k][0] for k in range(1, 6)] == [7, 101, 102, 103, 104]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0, None), (50, [1.0, 0.1], 0, None), (1, None, 0, None), (2, [0.0, 0.0], 0, None), (3, [1.0, None], 0, None), (4, [math.nan, 1.0], 0, None), (5, [math.inf, 1.0], 0, None), (6, [1.0, 2.0, 3.0], 0, None), (None, [1.0, 1.0], 0, None), (7, [2.0, 0.0], 0, None), (7, [2.0, 0.0], 0, None)]
    d = vectors(spark, rows)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in vector_graphs.nearest(d.filter("vec_id % 50 = 0"), vector_graphs.build_index(d)).collect()]
    assert sorted(got) == [(0, 1, 7), (0, 2, 50), (50, 1, 0), (50, 2, 7)]
    none = d.limit(0)
    assert vector_graphs.nearest(none, vector_graphs.build_index(none)).count() == 0


# ---- WARC


def test_archives(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/ b", big), (2, "http://a/2", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", big), (8, "u", "é" * 90), (2, "http://a/2", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash")).repartition(2)
    index = warc_bundles.write_bundles(d, str(tmp_path / "w"), frame_bytes=600, bundle_bytes=900)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_bundles.read_bundles(index).collect()), key=repr)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == big and i != 2
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=repr)
    for r in index.collect():
        record = warc_bundles.read_record(r["bundle"], r["frame"], r["offset"], r["length"])
        _, head, _ = next(warc_bundles.decode_records(record))
        assert warc_bundles.page_of(head["WARC-Record-ID"]) == r["page_id"]
    assert len({r["bundle"] for r in index.collect()}) > 1
    import zstandard

    name = index.first()["bundle"]
    with open(name, "rb") as f:  # any Zstandard reader takes the bundle: the seek table is a skippable frame
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1")
    empty = warc_bundles.write_bundles(d.limit(0), str(tmp_path / "e"))
    assert warc_bundles.read_bundles(empty).count() == 0


# ---- token ids


def test_code_lengths_are_limited_and_decode():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lens = token_store.code_lengths(np.array(fib))
    assert lens.max() <= token_store.LIMIT and sum(2.0 ** -int(x) for x in lens) <= 1
    assert token_store.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and token_store.code_lengths(np.zeros(4, int)).sum() == 0
    rng = np.random.default_rng(4)
    ids = rng.choice(40, 20_000, p=np.array(fib) / sum(fib))
    codes, (symbol, size) = token_store.canonical_codes(lens), token_store.decode_table(lens)
    blocks = [(*(x := token_store.encode_block(ids[i : i + 7000], codes, lens))[:1], min(7000, len(ids) - i), x[1]) for i in range(0, len(ids), 7000)]
    assert np.array_equal(token_store.decode_blocks(blocks, symbol, size), ids)


def test_chunks_equal_the_library():
    coder = token_store.ChunkTokenizer(token_store.default_tokenizer())
    texts = [*(t or "" for t in ODD), "Don't stop!! it's 12.5%... <|endoftext|> a<|startoftext|>b ÉÉ é ́q ΣΑΣ x\x1cy\x85z foo,bar 'S ((a)) 가 ###", "THE*** end***\nend### Ünï,", "İ! aİ.", "a\x1cb!\x1c! x\x00y", "“quoted” a…, (b)", "it's 'tis 'select", "½ x² ٣", "K K! Ω, ﬁ"]
    for t, x in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files(spark, odd, tmp_path):
    got = token_store.read_tokens(token_store.write_tokens(odd, str(tmp_path / "t"))).collect()
    coder = token_store.ChunkTokenizer(token_store.default_tokenizer())
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, coder.encode([r["text"] and r["text"].encode()])[0]) for r in odd.collect()))
    start = 0
    for (there, i, ids), r in zip(rows, sorted(got, key=lambda r: r["start"]), strict=True):
        ids += np.array([2], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i if there else None, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert os.listdir(tmp_path / "t") and not [x for x in os.listdir(tmp_path / "t") if x.endswith(".part")]
    assert token_store.read_tokens(token_store.write_tokens(odd.limit(0), str(tmp_path / "e"))).count() == 0


# ---- URL filters


def test_entries_are_evaluated_as_of_the_fetch(spark):
    e = spark.createDataFrame([("domain", "b.com", "add", 10, "x"), ("domain", "b.com", "remove", 20, "x"), ("domain", "b.com", "add", 30, "y"), ("domain", "a.b.com", "add", 15, "z"), ("url", "a.b.com/p", "add", 5, "u"), ("url", "a.b.com/p", "remove", 16, "u"), ("domain", "c.com", "add", 7, "q"), ("domain", "c.com", "remove", 7, "q")], "kind string, key string, action string, since long, category string")
    rows = [(1, "http://A.b.com:80/p/?q#f", 12), (2, "http://a.b.com/p", 15), (3, "http://b.com", 20), (4, "http://x.b.com/", 19), (5, "https://u@b.com/", 30), (6, "http://bb.com", 30), (7, None, 12), (8, "nonsense", 12), (9, "http://b.com", None), (10, "http://c.com", 7), (1, "http://A.b.com:80/p/?q#f", 12)]
    d = spark.createDataFrame(rows, "id long, url string, fetched_at long")
    got = sorted(((r["id"], r["blocked"], r["n_active"], r["rule"], r["category"]) for r in url_filters.judge(d, e).collect()), key=lambda x: (x[0], x[2]))
    assert got == [(1, True, 2, "a.b.com/p", "u"), (1, True, 2, "a.b.com/p", "u"), (2, True, 3, "a.b.com/p", "u"), (3, False, 0, None, None), (4, True, 1, "b.com", "x"), (5, True, 1, "b.com", "y"), (6, False, 0, None, None), (7, False, 0, None, None), (8, False, 0, None, None), (9, False, 0, None, None), (10, False, 0, None, None)]
    assert url_filters.judge(d.limit(0), e).count() == 0 and url_filters.judge(d, e.limit(0)).filter("blocked").count() == 0


def test_captures_may_have_names_of_results(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x", 50, "mine", True, "r")], "page_id long, url string, fetched_at long, host string, Blocked boolean, rule string")
    entries = spark.createDataFrame([("domain", "a.com", "add", 10, "spam")], "kind string, key string, action string, since long, category string")
    got = url_filters.judge(rows, entries)
    assert [c.lower() for c in got.columns].count("host") == 1 and got.select("host", "blocked", "rule").first() == ("a.com", True, "a.com")


# ---- mixing


def test_raking_meets_the_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(50, 5000))) for a in range(4) for b in range(3) for c in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    total = sum(r[3] for r in rows)
    targets = {d: source_mixing.tempered(cells, d, total, 0.3) for d in source_mixing.DIMS}
    raked = source_mixing.rake(cells, targets, sweeps=12)
    for d in source_mixing.DIMS:
        want = {r[d]: r["target"] for r in targets[d].collect()}
        assert all(abs(r["w"] / want[r[d]] - 1) < 1e-6 for r in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect())
    odds = {(r["source"], r["lang"], r["topic"]): r["weight"] / r["tokens"] for r in raked.collect()}
    x = odds["s0", "l0", "t0"] * odds["s1", "l1", "t0"] / (odds["s0", "l1", "t0"] * odds["s1", "l0", "t0"])
    assert abs(x - 1) < 1e-9  # weights are a product of one factor per dimension
    p = source_mixing.calibrate(raked, 0.6, 20)
    assert abs(p.agg(F.sum(F.col("tokens") * F.col("prob"))).first()[0] / total - 0.6) < 1e-6


def test_mixture_of_odd_rows(odd):
    got = source_mixing.mix(odd).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["prob"] <= 1 for r in got)
    kept = source_mixing.sample(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["sampled"])
    assert source_mixing.mix(odd.limit(0)).count() == 0


# ---- HTML


def extract(page):
    return html_extraction.main_text(html_extraction.parse(page))


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Head</header><nav><ul><li>Menu</ul></nav>
    <div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>One<br>two&nbsp;three <p>Four<!-- no --> five<i>six</i></p><script>var t="</p>";</script><ul><li>a<li>b</ul>
    <div id="comments"><p>Nice!</p></div><aside>Side</aside><table><tr><td>1<td>2</table><form>x</form></article><footer>Foot</footer></body>"""
    assert extract(page) == "Title & more One two three Four fivesix a b 1 2"
    assert extract("") == "" and extract("<p>a<p>b") == "a b" and extract("x < y &lt;z") == "x < y <z"
    assert extract('<div class="content sidebar-left"><article>In</article></div><article class="comment">Out</article>') == "In"
    assert extract("<main><p>A</p></main><p>B</p>") == "A" and extract("<article>1</article><p>x</p><article>2</article>") == "1 2"
    assert extract("<script>never closed <p>x") == "" and extract("<p title='a>b'>q</p>") == "q"
    assert extract("<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize(("page", "want"), [
    ('<article><div aria-hidden="false">keep me</div></article>', "keep me"), ('<article><p title="the hidden valley">keep me</p></article>', "keep me"),
    ('<article><p data-id="comments">keep me</p></article>', "keep me"), ('<article><p class=a data-x="class=menu">k</p></article>', "k"),
    ('<article><h2 class="section-header">keep</h2><p class="share-price">me</p></article>', "keep me"),
    ("<main><h1>Title</h1><article>a</article><h2>Related</h2></main>", "Title a"), ("<main>A</main><main>B</main>", "A B"),
    ("<main><header><h1>T</h1></header><article>a</article><article>b</article></main>", "T a b"),
    ('<body><div class="site-header">x</div><h2 class="section-header">k</h2><div class="ad-slot">x</div><div class="shareholders">y</div></body>', "k y"),
    ('<article>a<div class="comments">x</div><div id="comment-list">x</div><div class="header">h</div><section class="page-header">g</section></article>', "a h g"),
    ('<body><article class="comment">x</article><article>a</article></body>', "a"), ("<article hidden>x</article><p>y</p>", "y"),
    ("<main><h1>T</h1><p>x</p></main>", "T x"), ("<header><h1>Site</h1></header><p>x</p>", "x"), ('<p class="notice">n</p><p>x</p>', "x"), ('<div CLASS = sideBar>n</div><p>x</p>', "x"),
])
def test_marks_are_whole_names(page, want):
    assert extract(page) == want


def test_all_main_elements_stay():
    assert extract('<p>x</p><div itemprop="articleBody"><p>A</p></div><p>y</p><div itemprop="articleBody"><p>B</p></div>') == "A B"
    assert extract('<main><div itemprop="articleBody">A</div>B</main><p>y</p><div role="main">C</div>') == "A B C"


def test_site_templates_go(spark):
    page = lambda i, host: (i, f"http://{host}/{i}", f"<html><body><div>Share this now</div><p>{text(i, 20)}</p><p>Common words</p><div>{i % 7}</div></body></html>")
    rows = [page(i, "a.com") for i in range(20)] + [page(i, "b.com") for i in range(30, 33)] + [(100, None, "<p>x</p>"), (101, "http://a.com", None), (None, "bad", "<p>y")] + [(200 + i, f"http://c.com/{i}", "<p>same</p>") for i in range(20)]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), min_pages=5).collect()}
    assert got[3]["text"] == f"{text(3, 20)} 3" and got[31]["text"] == f"Share this now {text(31, 20)} Common words 3"
    assert got[101]["text"] == "" and got[101]["n_chars"] == 0 and got[None]["text"] == "y" and got[205]["text"] == "same"
    assert len(got) == len(rows)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_only_counts_tell_templates(spark, monkeypatch, most):
    """No element has a mark; a brute-force count of the blocks decides, whether templates are broadcast or joined."""
    monkeypatch.setattr(html_extraction, "BROADCAST", most)
    block = lambda i, k: f"block {k} {i if k % 2 else i % 4}"
    rows = [(i, f"http://{'ab'[i % 2]}.com/{i}", "<article>" + "".join(f"<div><p>{block(i, k)}</p></div>" for k in range(6)) + "</article>") for i in range(80)] + [(80, "http://b.com/1", None)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    pages = {host: [i for i in range(80) if i % 2 == host] for host in (0, 1)}
    for i in range(80):
        often = lambda x: sum(x in {block(j, k) for k in range(6)} for j in pages[i % 2])  # noqa: B023, E731
        assert got[i] == " ".join(x for x in (block(i, k) for k in range(6)) if often(x) < max(10, 0.1 * len(pages[i % 2])))
    assert got[80] == "" and len(got) == 81


def test_templates_of_mixed_hosts_go(spark):
    rows = [(i, f"http://a.com/{i}", f"<body><div>Section {i % 3} offers</div><p>{text(i, 20)}</p></body>") for i in range(60)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 60 and all(r["text"] == text(r["page_id"], 20) for r in got)


# ---- pieces


@pytest.fixture(scope="module")
def encoder():
    return piece_lattice.Encoder()


def brute_segmentations(lattice, s):
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        for j, found, x in lattice.arcs_from(s, i):
            go(j, score + x, ids + found)

    go(0, 0.0, ())
    return sorted(out, reverse=True)


@pytest.mark.parametrize("t", ["thonthe", "a", "ééx✓1", "foo,bar", "ab thon, é", "a\nb  c", "12.5!!"])
def test_nbest_equals_brute_force(encoder, t):
    lattice = encoder.lattice
    want = brute_segmentations(lattice, piece_lattice.MARK + t.replace(" ", piece_lattice.MARK))
    ids, score, best, sound = encoder.encode([t])[0]
    assert np.allclose(best, [s for s, _ in want[: len(best)]]) and len(best) == min(4, len(want)) and abs(score - want[0][0]) < 1e-9
    assert sound and lattice.decode(np.frombuffer(ids, "<i4").tolist()) == t
    for part in lattice.split(t):
        for piece in lattice.cut(part):
            found = lattice.nbest(piece, 6)
            assert np.allclose([s for s, _ in found], [s for s, _ in brute_segmentations(lattice, piece)[:6]])
            top, _, second = lattice.best_two(piece)
            assert abs(top - found[0][0]) < 1e-9 and (second == -math.inf if len(found) < 2 else abs(second - found[1][0]) < 1e-9)


def test_nbest_segmentations(spark, encoder):
    lattice, texts = encoder.lattice, ["thonthe", "a", "ééx✓1", "foo,bar", "a\nb  c", "12.5!!", "the the the thon a the"]
    rows = piece_lattice.segment(documents(spark, texts).coalesce(1), with_ids=True).collect()
    for r in rows:
        t, found = texts[r["doc_id"]], [tuple(x) for x in r["nbest_ids"]]
        assert len(found) == len(set(found)) == len(r["nbest_scores"]) and list(found[0]) == r["piece_ids"]
        assert r["nbest_pieces"] == list(map(len, found)) and r["nbest_crc32"] == [zlib.crc32(np.array(x, "<i4").tobytes()) for x in found]
        s = piece_lattice.MARK + t.replace(" ", piece_lattice.MARK)
        if len(s) < 10:
            scores = {ids: x for x, ids in brute_segmentations(lattice, s)}
            assert all(abs(scores[x] - y) < 1e-9 for x, y in zip(found, r["nbest_scores"], strict=True))
        assert all(lattice.decode(x) == t for x in found)
    assert len(rows) == len(texts) and sum(len(r["nbest_ids"]) for r in rows) > 20


def test_decoding_equals_the_library(encoder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.default_model())
    for t in [x for x in ODD if x] + ["  lead", "tail  ", "a\tb\r\n☃ 漢字"]:
        ids = np.frombuffer(encoder.encode([t])[0][0], "<i4").tolist()
        assert encoder.lattice.decode(ids) == t == sp.decode(ids)


def test_segment_rows(odd):
    got = piece_lattice.segment(odd, with_ids=True).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) and r["nbest_scores"][0] == r["score"] and sorted(r["nbest_scores"], reverse=True) == r["nbest_scores"]
    assert piece_lattice.segment(odd.limit(0)).count() == 0
    assert not piece_lattice.Encoder().encode(["a▁b"])[0][3]


def test_round_trip_tells_wrong_ids():
    encoder = piece_lattice.Encoder()
    assert [x[3] for x in encoder.encode(["the thon", "the"])] == [True, True]
    at = encoder.index["▁thon"]
    encoder.ids[at] = encoder.ids[encoder.index["▁the"]]
    assert [x[3] for x in encoder.encode(["the thon", "the"])] == [False, True]


# ---- shared


def test_scratch_reads_the_session(spark):
    root = common.shared_root(spark)
    assert common.scratch(spark, "x").startswith(root + "/") and common.materialize(spark.range(3), "y").count() == 3


def test_token_coder_outlives_tasks_and_agrees_with_the_library():
    import random

    import pyarrow as pa

    words = ["Don't", "a1b22c", "x--y", "<|endoftext|>", "naïve", "İstanbul", "3.14", "你好", "(end).", "tab\tnew\x0bline\n", "\x1c", "café's", "…", "A", "é"]
    rng = random.Random(11)
    texts = [None, "", " \t", *(" ".join(rng.choice(words) + rng.choice(["", " ", ",", "7"]) for _ in range(rng.randrange(1, 12))) for _ in range(1500))]
    path = token_store.default_tokenizer()
    for part in (texts[:700], texts[700:]):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part[a : a + 300]))), pa.array(part[a : a + 300], pa.string())], ["doc_id", "text"]) for a in range(0, len(part), 300)]
        got = pa.Table.from_batches(list(token_store._tokenize(path, 2)(iter(batches))))
        assert got["doc_id"].to_pylist() == list(range(len(part)))
        library = token_store._coder(path, 2).tokenizer
        for text, ids in zip(part, got["ids"].to_pylist(), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, token_store.END_ID], text
    assert list(token_store._tokenize(path, 2)(iter([]))) == [] and token_store._coder(path, 2) is token_store._coder(path, 2)


def test_narrower_contexts_are_entries_of_the_widest_one():
    rng = np.random.default_rng(12)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 9))) for _ in range(60)).encode() for _ in range(30)] + [b"", b"\x00a b", "é ñ".encode()]
    alone = np.ones((256, 256), np.int64)
    block = context_mixing.Block(texts, context_mixing.Code(alone, {}))
    packed = {k: context_mixing.unpack(p) for k, _, p in context_mixing.messages(texts, True, context_mixing.Code(alone, {}), [0] * 7) if k < context_mixing.WORDS}
    replies = []
    for k in range(context_mixing.N_CONTEXTS):
        first, n = block.entries(block.context(k), True)  # over all bytes
        keys, path, counts = packed[k]
        assert np.array_equal(path, block.paths[first]) and np.array_equal(counts, n) and np.array_equal(keys, block.context(k)[first] >> np.uint64(32))
        replies.append(rng.integers(-99, 99, int(block.code_lens[first].astype(int).sum())).astype(np.int8))
    rows = context_mixing.unit_rows(block, replies)[0]
    lens = block.code_lens.astype(int)
    for k, reply in enumerate(replies):
        first, mine = block.entries(block.context(k), False)
        starts = np.cumsum(lens[first]) - lens[first]
        assert np.array_equal(rows[:, k], np.concatenate([reply[starts[m] : starts[m] + n] for m, n in zip(mine, lens, strict=True)]))
