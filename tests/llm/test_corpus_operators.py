"""The corpus operators against brute force, exact round trips, held-out accuracy, and awkward inputs."""

import dataclasses
import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bpe, components, grulm, iblt, media, packing, quality, simhash, toxicity, urlrules, warc
from loomgraph.llm._ranges import range_cuts
from tests.oracle import same

SPEC = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, Label string"
LONG = "word " * 30_000 + "x" * 20_000
ODD = [
    (1, "alpha beta gamma delta epsilon zeta.\nsecond line here", "en", "s", 5, 0.1, "x"),
    (1, "alpha beta gamma delta epsilon zeta.\nsecond line here", "en", "s", 5, 0.1, "x"),
    (2, None, None, None, None, None, None), (3, "", "en", "s", 0, 0.0, ""), (None, "no id at all but words", "en", None, 3, 0.5, "y"),
    (4, " \t\n ", "en", "s", 4, 0.0, "z"), (5, LONG, "en", "s", len(LONG), 0.2, "l"), (6, "<|endoftext|> don't  stop\u00a0\u3000 1234 \u00e9\u00e8 \U0001f600", "fr", "s", 9, 0.3, "q"), (7, "one", "en", "t", 3, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# BPE


def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer
    his, mine = Tokenizer.from_file(SPEC), bpe.codec(SPEC)
    rng = np.random.default_rng(5)
    texts = [r.text for r in docs(spark, sf).collect()] + [t or "" for _, t, *_ in ODD] + ["a  b", " a", "a ", "a\x1c b", "x\n y\r\n\r\n z", "'s don't 'LL", "a<|endoftext|>b<|endoftext|>", "$" * 50, "ab" * 200]
    texts += ["".join(rng.choice(list("ab c\n\t'1!\u00e9\u3042\u2003"), 60)) for _ in range(300)]
    for t in texts:
        want = his.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want
        assert mine.decode(want) == his.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, odd, none):
    got = bpe.digest_documents(odd, SPEC)
    assert got.count() == len(ODD) and bpe.digest_documents(none, SPEC).count() == 0
    empty = got.where("doc_id = 2").first()
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest() == empty.decoded_sha256
    back = bpe.decode_documents(bpe.encode_documents(odd, SPEC), SPEC).where("doc_id = 6").first()
    assert back.text == ODD[7][1]


def test_small_automaton_is_what_merging_gives():
    """Any merge list, not only a well-known one: pairs merged in order of rank, leftmost first."""
    chars = {v: k for k, v in bpe.byte_alphabet().items()}
    a, b, c = (chars[ord(x)] for x in "abc")
    merges = [(a, b), (a, a), (a + b, c), (c, a), (a + a, a + b)]
    vocab = {x: i for i, x in enumerate([a, b, c, *(u + v for u, v in merges)])}
    auto = bpe.Automaton(vocab, merges)
    for n in range(1, 8):
        for k in range(3 ** n):
            word = "".join("abc"[k // 3 ** i % 3] for i in range(n))
            parts = [chars[ord(x)] for x in word]
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i:i + 2] = [u + v]
                    i += 1
            assert auto.encode_word(word.encode()) == [vocab[x] for x in parts], word


# SimHash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf):
    d = docs(spark, sf).where("doc_id < 120").select("doc_id", "text")
    near = [(1000 + i, f"{t} tail {i}") for i in range(15) for t in [d.first().text]]
    both = d.unionByName(spark.createDataFrame([*near, (2000, None), (2001, "")], "doc_id long, text string"))
    fps = {r.doc_id: brute_fp(r.text) for r in both.collect()}
    want = brute_components(fps)
    for tile in (4096, 3):  # with and without tiles of hot keys
        got = simhash.near_duplicates(both, simhash.SimHash(tile=tile)).collect()
        assert {r.doc_id: (r.f0 % 2 ** 64, r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd)
    assert got.count() == len(ODD) and simhash.near_duplicates(none).count() == 0
    assert {r.component_id for r in got.where("doc_id in (2, 3, 4)").collect()} == {2}


def test_keep_one_keeps_columns_and_one_of_each(spark, odd, none):
    text = " ".join(f"w{i}" for i in range(400))
    near = [(i, text if i < 3 else text.replace("w7 ", f"z{i} "), "en", "s", 1, 0.5, "k") for i in range(100, 106)]
    got = simhash.keep_one(odd.unionByName(spark.createDataFrame(near, SCHEMA)))
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 5, 6, 7, 100] and ids.count(None) == 1
    assert simhash.keep_one(none).count() == 0


def test_keep_one_compares_what_fingerprints_bring_together(spark):
    """With bands that no two of these sets share, near copies meet by their fingerprints alone."""
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:900], "other", *words[901:]]), " ".join(f"v{i}" for i in range(2000))]
    p = simhash.Similar(bands=1, rows=4000)
    sets = [np.unique(simhash.shingles(t, p.shingle)) for t in texts]
    assert len({simhash.band_keys(s, p)[0] for s in sets}) == 3
    a, b = (int(simhash.majority(s, p.prints)[0]) for s in sets[:2])
    assert (a ^ b).bit_count() <= p.prints.distance
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p)
    assert sorted(r.doc_id for r in got.collect()) == [0, 2]


def test_keep_one_equals_brute_force_on_shingle_sets(spark, sf):
    rows = [(r.doc_id, r.text) for r in docs(spark, sf).select("doc_id", "text").collect()]
    base = [f"w{i}" for i in range(400)]
    for k in range(60):  # from under to over 0.8 as words at even distances are replaced, each in its own copy
        text = [f"{w}k{k // 2}" for w in base]
        for j in range(0, 4 + k // 5):
            text[j * 390 // (4 + k // 5)] += f"x{k % 2}"
        rows.append((1_000_000 + k, " ".join(text)))
    grams = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in ((t or "").lower().split() for _, t in rows)]
    having, root = {}, {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(grams):
        common = Counter(j for g in a for j in having.get(g, ()))
        for j, n in common.items():
            if 5 * n >= 4 * (len(a) + len(grams[j]) - n) and find(i) != find(j):
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[y] = x
        for g in a:
            having.setdefault(g, []).append(i)
    want = sorted(rows[i][0] for i in root if find(i) == i)
    both = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (512, 3):  # with and without tiles of large groups
        assert sorted(r.doc_id for r in simhash.keep_one(both, simhash.Similar(tile=tile)).collect()) == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()))
    assert set(got.values()) == {0, 1000} and len(got) == 301 + 201
    assert components.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# Sketches


def test_iblt_likeness_is_that_of_the_sets(spark, sf):
    texts = [r.text for r in docs(spark, sf).orderBy("doc_id").collect()]
    edited = [iblt.edit(t, f) for t, f in zip(texts, texts[1:] + texts[:1])]

    def brute(a, b):
        x, y = Counter(pieces_of(a)), Counter(pieces_of(b))
        most = max(sum(x.values()), sum(y.values()))
        return sum((x & y).values()) / most if most else 1.0
    got = iblt.fingerprint_documents(docs(spark, sf), iblt.Sketch(shard_rows=17, batch_bytes=5000)).orderBy("doc_id").collect()
    assert [r.edited_sha256 for r in got] == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert np.allclose([r.near_edited for r in got], [brute(a, b) for a, b in zip(texts, edited)])
    assert np.allclose([r.near_next for r in got], [brute(a, b) for a, b in zip(texts, texts[1:] + texts[:1])])
    assert len({r.sketch for r in got}) == len(set(texts))


def pieces_of(text):
    """Paragraphs read off character by character: a run ends at line feeds, and at spaces after a word that ends in
    a closing sign; what is longer than 128 is cut after a character divisible by 16 from 64 on, or at 512."""
    out, x, i = [], "", 0
    while i < len(text):
        if text[i] == "\n" or text[i] == " " and i and text[i - 1] in "acegikmoqsuwy.!?|\u3002":
            sign = text[i]
            while i < len(text) and text[i] == sign:
                i += 1
            out.append(x)
            x = ""
        else:
            x += text[i]
            i += 1
    cut = []
    for x in [*out, x]:
        while len(x) > 128:
            k = next((k for k in range(64, min(len(x), 513)) if not ord(x[k]) % 16), 512)
            if k >= len(x):
                break
            cut.append(x[:k + 1])
            x = x[k + 1:]
            if len(x) <= 128:
                k = next((k for k in range(64, len(x)) if not ord(x[k]) % 16), None)
                if k is not None:
                    cut.append(x[:k + 1])
                    x = x[k + 1:]
                break
        if x:
            cut.append(x)
    return cut


def test_iblt_likeness_moves_little_with_a_small_edit():
    words = [f"w{i}{'aestn'[i % 5]}" for i in range(40)]
    for n in range(2, 40):
        a, b = " ".join(words[:n]), " ".join([*words[:n - 1], "Changed"])
        x, y = iblt.digests([a]), iblt.digests([b])
        got = iblt.likeness(x, y, 1)[0]
        assert got >= 1 - 2.0 / len(iblt.paragraphs(a)) - 1e-9
    raw = iblt.sketches(x, 1)[0], iblt.sketches(y, 1)[0]
    left = iblt.subtract(*map(iblt.read_sketch, raw))
    _, key, side, whole = iblt.peel(left, 1, iblt.DEFAULT.cells)
    assert whole.all() and set(key[side == 1]) == set(x[1]) - set(y[1])


def test_iblt_peels_out_the_differences():
    a, b = iblt.digests(["p one.\np two.\np three.\nx y z s.\nq s.\nr s."]), iblt.digests(["p one.\np 2.\np three.\nx y z s.\nq s.\nr s."])
    s = iblt.subtract(iblt.build(*a, 1, 24), iblt.build(*b, 1, 24))
    _, key, side, whole = iblt.peel(s, 1, 24)
    assert whole.all()
    assert set(key[side == 1]) == set(a[1]) - set(b[1]) and set(key[side == -1]) == set(b[1]) - set(a[1])


def test_iblt_odd_rows(odd, none, spark):
    got = iblt.fingerprint_documents(odd)
    assert got.count() == len(ODD) and iblt.fingerprint_documents(none).count() == 0
    assert got.where("doc_id = 2").first().n_chars == 0
    alone = iblt.fingerprint_documents(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


# Classifiers


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(s[y == 1] > x).mean() + 0.5 * (s[y == 1] == x).mean() for x in s[y == 0]])


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op3_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    rows = got.collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert auc([r.quality for r in rows], [r.score for r in rows]) > 0.97


def test_toxicity_learns_what_compresses():
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(["river", "stone", "meadow", "lantern", "harvest", "window", "copper", "garden"], 60)) for _ in range(300)]
    bad = [t.replace("stone", "vilezork").replace("copper", "gruntspit") for t in plain[:60]]
    texts, y = plain[60:] + bad, [0] * 240 + [1] * 60
    order = rng.permutation(len(texts))
    m = toxicity.train([texts[i] for i in order[:200]], [y[i] for i in order[:200]]).dump()
    rest = order[200:]
    s = [toxicity.score_text(texts[i], m) for i in rest]
    assert auc([y[i] for i in rest], s) > 0.99
    assert all(v < 0.7 for v, i in zip(s, rest) if not y[i])


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, none, labels, op):
    got = op.classify(odd, labels)
    assert got.count() == len(ODD) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert op.classify(none, labels).count() == 0
    unlabelled = labels.limit(0)
    assert op.classify(odd, unlabelled).count() == len(ODD)
    keep = quality.keep_good if op is quality else toxicity.keep_clean
    kept = keep(odd.withColumn("loom_score", F.lit(1)), unlabelled)
    assert kept.columns == [*odd.columns, "loom_score"]


# Language model


def test_base_score_and_counts(spark, sf):
    p = grulm.Gru(outputs=96, buckets=32, classes=8, hidden=8, head=300, train_rows=40, epochs=1, streams=8)
    d = docs(spark, sf).where("doc_id < 80")
    rows = d.collect()
    c = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            c.update(r.text.encode().lower().split())
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in grulm.score_documents(d, p).collect()}
    for r in rows:
        w = r.text.encode().lower().split() + [b""]
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(c[a] > 0 for a in w), n)
        assert x.base_score == pytest.approx(sum(np.log10((c[a] + 0.1) / (n + 0.1 * (v + 1))) for a in w))
        assert x.score < 0


def test_network_is_a_distribution_and_carries_state():
    p = grulm.Gru(outputs=10, buckets=6, classes=4, hidden=5, train_rows=1, streams=2, unroll=4, window=3, together=2)
    net = grulm.Network.new(p, np.arange(16.0))
    rng = np.random.default_rng(0)
    net.learn(rng.integers(0, 16, 200), 0, p.streams)
    h = rng.normal(size=(3, 5)).astype(np.float32)
    total = sum(np.exp(net.log_p(h, np.full(3, t))[0]) for t in range(16))
    assert np.allclose(total, 1, atol=1e-4)
    texts = [rng.integers(1, 16, k) for k in (1, 9, 4, 25)]
    whole = net.score(texts, 0)
    for t, s in zip(texts, whole):  # one step at a time
        state, last, own = np.zeros((1, 5), np.float32), 0, 0.0
        for x in t:
            states, _ = net.run(state, np.array([[last]]))
            state, last = states[-1], x
            own += net.log_p(state, np.array([x]))[0][0]
        assert own == pytest.approx(s, rel=1e-4)


def test_gradients_of_backpropagation():
    p = grulm.Gru(outputs=6, buckets=2, classes=2, hidden=4)
    net = grulm.Network.new(p, np.ones(8))
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    s, t = np.random.default_rng(1).normal(size=(5, 4)), np.array([0, 3, 7, 4, 1])
    grads = {k: np.zeros_like(v) for k, v in net.parts.items()}
    net.log_p(s, t, grads)
    for k, at in (("wc", (1, 0)), ("ww", (1, 2, 3)), ("bw", (0, 1)), ("bc", (1,))):
        e = 1e-5
        net.parts[k][at] += e
        up = net.log_p(s, t)[0].sum()
        net.parts[k][at] -= 2 * e
        down = net.log_p(s, t)[0].sum()
        net.parts[k][at] += e
        assert grads[k][at] == pytest.approx(-(up - down) / (2 * e), abs=1e-5)


def test_model_beats_the_base_on_held_out_text(spark):
    p = grulm.Gru(outputs=992, buckets=32, classes=32, hidden=24, train_rows=400, epochs=2, streams=32)
    got = grulm.score_documents(docs(spark, "/root/testdata/sf0.01"), p).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_the_whole_fold_is_learned(spark):
    """The rounds alone make the likelihood better, in any partitions; no documents change nothing; means are by weight."""
    p = grulm.Gru(outputs=28, buckets=4, classes=4, hidden=8, train_rows=1, epochs=1, streams=2, unroll=8, rounds=2, lanes=8, block=300, share=400)
    rows = [(i, "one two three four " * (12 if i % 7 else 40)) for i in range(150)]
    got = {}
    for parts in (1, 6):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        n = d.where(~grulm.held_out(F.col("doc_id"))).agg(F.sum(F.size(F.split(F.trim("text"), " ")) + 1)).first()[0]
        learned = d.where(~grulm.held_out(F.col("doc_id")))
        v = grulm.vocabulary(grulm.count_words(learned), p)
        assert v.total == n
        start = grulm.train([], v, p)
        net = grulm.Network.load(p, grulm.learn_all(learned, start.dump(), v, p))
        e = grulm.Encoder(v, p)
        text = e("one two three four " * 12)[0]
        got[parts] = (start.score([text], e.end)[0], net.score([text], e.end)[0])
        assert got[parts][1] > got[parts][0]
        assert grulm.learn_all(learned.where("false"), start.dump(), v, p) == start.dump()
    networks = spark.createDataFrame([(bytearray(start.dump()), 3)] * 70, "network binary, tokens long")
    same = grulm.Network.load(p, grulm._merged(networks, p)).parts
    assert all(np.allclose(same[k], start.parts[k], atol=1e-6) for k in same)


def test_texts_are_cut_into_words_by_runs():
    """Tokens, ids, sums and rare words are those of a plain loop over words, however the rows are divided."""
    texts = [" One  two\tTWO ", "", None, "\x1ca\x0b\x85b \x0c\u0130A one", "rare rare new one " * 9, "é"]
    want = [(t or "").encode().lower().split() + [b""] for t in texts]
    for most in (1, 30, 1 << 20):
        got = []
        for words, tokens, ends in grulm.tokens_of(pa.array(texts, pa.string()), most):
            got += [[words[i].as_py() for i in row.tolist()] for row in np.split(tokens, ends[:-1] + 1)]
            assert ends[-1] == len(tokens) - 1
        assert got == want
    p = grulm.Gru(outputs=2, buckets=3, classes=2, hidden=4)
    known = {b"": 9, b"one": 5, b"two": 4, b"a": 1}
    v = grulm.Vocabulary(list(known), np.array(list(known.values())), 19, 4, np.array([2.5, 1.5, 0.5]))
    e, at = grulm.Encoder(v, p), list(known)
    for text, words in zip(texts, want):
        ids, s = e(text)
        assert ids.tolist() == [at.index(w) if w in at[:2] else 2 + grulm.bucket_of(w, 3) for w in words]
        assert (s["n"], s["known"], s["rest"]) == (len(words), sum(w in known for w in words), Counter(w for w in words if w not in known))
        assert s["log_count"] == pytest.approx(sum(np.log10(known[w] + 0.1) for w in words if w in known))
        assert s["share"] == pytest.approx(sum((np.log10(known[w] + 0.1) if w in known else 0) - np.log10(v.mass[grulm.bucket_of(w, 3)]) for w in words if w not in at[:2]))


def test_rounds_and_scores_read_ids_not_texts(spark):
    """What is learned and scored is the ids written once: they say what the texts say, and no round needs a text."""
    p = grulm.Gru(outputs=28, buckets=4, classes=4, hidden=8, rounds=2, lanes=8, unroll=8, block=300, share=400)
    d = spark.createDataFrame([(i, "one two three four " * (i % 9)) for i in range(60)], "doc_id long, text string").coalesce(1)
    learned = d.where(~grulm.held_out(F.col("doc_id")))
    v = grulm.vocabulary(grulm.count_words(learned), p)
    rows = grulm.encoded(d, spark.sparkContext.broadcast(v), p)
    e = grulm.Encoder(v, p)
    got = {r.doc_id: r for r in rows.collect()}
    assert len({r.row for r in got.values()}) == 60
    for r in d.collect():
        assert np.frombuffer(got[r.doc_id].ids, p.kind).tolist() == e(r.text)[0].tolist()
        assert (got[r.doc_id].turn is None) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    start = grulm.train([], v, p).dump()
    one = grulm.Network.load(p, grulm.learn_rounds(rows, start, v, p)).parts
    two = grulm.Network.load(p, grulm.learn_all(learned, start, v, p)).parts
    assert "text" not in rows.columns and all(np.allclose(one[k], two[k], atol=1e-5) for k in one)


def test_blocks_of_a_softmax_and_sums_by_row_change_nothing():
    rng = np.random.default_rng(3)
    s, t = rng.normal(size=(50, 4)).astype(np.float32), rng.integers(0, 8, 50)
    got = []
    for near in (1, 7, 1000):
        net = grulm.Network.new(grulm.Gru(outputs=6, buckets=2, classes=2, hidden=4, near=near), np.ones(8))
        grads = {k: np.zeros_like(x) for k, x in net.parts.items()}
        got.append((*net.log_p(s, t, grads), *grads.values()))
    for other in got[1:]:
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got[0], other))
    rows = rng.normal(size=(50, 3))
    want = np.zeros((8, 3))
    np.add.at(want, t, rows)
    for often in (2, 5, 48):
        have = np.zeros((8, 3))
        grulm._add_rows(have, t, rows, often)
        assert np.allclose(want, have)


def test_language_model_odd_rows(odd, none):
    p = grulm.Gru(outputs=96, buckets=32, classes=8, hidden=8, head=50, train_rows=5, epochs=1, streams=2)
    got = grulm.score_documents(odd, p)
    assert got.count() == len(ODD) and got.where("score is null or base_score is null").count() == 0
    assert got.where("doc_id = 2").first().n_tokens == 1
    assert grulm.score_documents(none, p).count() == 0


# Packing


def test_packing_keeps_every_token_and_every_bin_within_its_size(spark, sf, odd, none):
    p = packing.Packing(capacities=(16, 64, 256), group_rows=50)
    for d in (docs(spark, sf), odd):
        want = Counter()
        for r in d.collect():
            want[r.doc_id] += len((r.text or "").encode().split()) + 1
        got = packing.pack_documents(d, p).toPandas()
        have = Counter()
        for r in got.itertuples():
            have[None if np.isnan(r.doc_id) else int(r.doc_id)] += r.n_tokens
        assert have == want
        for _, b in got.groupby(["group_id", "bin"]):
            b = b.sort_values("offset")
            ends = (b.offset + b.n_tokens).tolist()
            assert b.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= b.capacity.iloc[0]
            assert b.capacity.iloc[0] == min(c for c in p.capacities if c >= ends[-1])
    assert packing.pack_documents(none, p).count() == 0


def cheapest(items, p):
    """The least cost of any division of ``items`` into bins, by trying all."""
    best = [float("inf")]

    def go(k, bins, cost):
        if cost >= best[0]:
            return
        if k == len(items):
            best[0] = cost
            return
        for i, b in enumerate(bins):
            if b + items[k] <= p.capacities[-1]:
                more = size(b + items[k]) - size(b)
                go(k + 1, [*bins[:i], b + items[k], *bins[i + 1:]], cost + more)
        go(k + 1, [*bins, items[k]], cost + size(items[k]))

    def size(n):
        return p.cost(min(c for c in p.capacities if c >= n))
    go(0, [], 0.0)
    return best[0]


def packed_cost(placed, p):
    return sum(p.cost(c) for c in {r[-4]: r[-1] for r in placed}.values())


def test_packing_is_near_the_cheapest_division():
    p = packing.Packing(capacities=(8, 12, 20), overhead=2, attention=40)
    rng = np.random.default_rng(3)
    ratios = []
    for _ in range(60):
        items = rng.integers(1, 21, rng.integers(2, 8)).tolist()
        got = packed_cost(packing.pack([(n, i) for i, n in enumerate(items)], p), p)
        least = cheapest(sorted(items, reverse=True), p)
        assert got >= least - 1e-9
        ratios.append(got / least)
    assert max(ratios) < 1.3 and np.mean(ratios) < 1.03


def test_packing_chooses_sizes_jointly():
    """No single size is as cheap, and smaller sizes are opened in the middle of a group, not only at its end."""
    rng = np.random.default_rng(5)
    items = [(int(n), i) for i, n in enumerate(np.clip(rng.lognormal(5.5, 1.0, 3000), 1, 4096))]
    p = packing.DEFAULT
    placed = packing.pack(items, p)
    order = sorted(items, key=lambda x: (-x[0], x[1:]))
    for c in p.capacities:
        if c == p.capacities[-1]:
            assert packed_cost(placed, p) < packing.fit(order, (c,), p)[0]
    sizes = {r[-4]: r[-1] for r in placed}
    assert len(set(sizes.values())) > 2 and Counter(sizes.values())[4096] < len(sizes) / 2


# URL rules


def test_url_rules(spark):
    urls = ["http://A.Example.net/en/x", "https://example.net/fr/?q=1", "http://notexample.net/", "http://example.com/de/1#a", "http://x.org/fr/", "http://x.org/de/", None, "nothing", "ftp://h?x=/en/", "http://net/", "http://u://v.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5][2:] == (None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][:2] == ("h", "") and got[9][2] == "net/" and got[10][0] == "u:"


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'pills' if i % 4 == 0 else 'news'}.{'shop' if i % 2 else 'site'}.biz/{'buy' if i % 3 else 'read'}/{i}") for i in range(400)]
    pages = spark.createDataFrame([*rows, *rows[:3]], "page_id long, url string")
    labels = spark.createDataFrame([(i, "pills" in u and "buy" in u) for i, u in rows if i < 300], "page_id long, bad boolean")
    got = urlrules.judge(pages, labels).collect()
    assert len(got) == 403
    assert all((r.verdict == "block") == ("pills" in r.host and "/buy" in r.path) for r in got)
    assert urlrules.judge(pages.limit(0), labels).count() == 0


# WARC


def test_archive_round_trip_is_deterministic(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"<p>{i}</p>" * (i + 1)) for i in range(60)] + [(3, "http://h/again", "same"), (None, "u\r\nX: y", None), (99, None, ""), (98, "v", "\u00e9" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    p = warc.Archive(shard_bytes=(4000, 4000), roll_bytes=1500)
    digests = []
    for k, frame in enumerate((pages, pages.repartition(5, "url"))):
        root = f"file://{tmp_path}/{k}"
        manifest = warc.write_archive(frame, root, p)
        files = sorted(map(tuple, manifest.select("file", "records", "bytes", "sha256").collect()))
        assert len(files) > 5 and sum(f[1] for f in files) == len(rows)
        digests.append(files)
        got = warc.read_archive(manifest, root, payload=True).collect()
        assert len(got) == len(rows)
        assert Counter(r.page_id for r in got if r.record_type == "revisit") == Counter([3, *range(3, 60, 3), None])
        assert [r.refers_to for r in got if r.page_id is None] == [99]
        by = {r.page_id: r for r in got if r.record_type == "response"}
        assert bytes(by[98].payload).decode() == "\u00e9" * 5000 and by[0].refers_to is None
        assert all(r.refers_to == 0 and r.payload_bytes == 4 for r in got if r.record_type == "revisit" and r.page_id is not None and r.page_id < 60)
        assert not list((tmp_path / str(k) / "_tmp").glob("*"))
    assert digests[0] == digests[1]


def test_damaged_record_is_noticed():
    raw = bytearray(warc.record(1, "u", b"payload", None, warc.DEFAULT))
    assert next(warc.parse(io.BufferedReader(io.BytesIO(bytes(raw)))))["payload"] == b"payload"
    raw[-6] ^= 1
    with pytest.raises(ValueError):
        next(warc.parse(io.BufferedReader(io.BytesIO(bytes(raw)))))


def test_archive_query_matches_sql(spark, sf):
    same(warc.op10_warc(spark, sf), warc.OP10_SQL, sf)


def test_empty_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    root = f"file://{tmp_path}/none"
    assert warc.read_archive(warc.write_archive(none, root), root).count() == 0


def test_range_cuts_balance_clustered_keys(spark):
    keys = [(i, 1) for i in range(1000)] + [(2 ** 60 + i, 1) for i in range(1000)] + [(-(2 ** 63), 50)]
    cuts = range_cuts(spark.createDataFrame(keys, "key long, weight long"), 100)
    sizes = Counter()
    for k, w in keys:
        sizes[int(np.searchsorted(cuts, k, side="right"))] += w
    assert max(sizes.values()) <= 100 and len(sizes) <= 45


# Media


def voted_components(images, p):
    """Components by the votes of all pairs of images."""
    found = {}
    for i, image in images.items():
        who, at, words = media.describe([image], p)
        found[i] = media.entries(who, at, words)
    root = {i: i for i in images}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in sorted(found):
        where = {t: k for k, t in enumerate(media.token(found[x]).tolist())}
        for y in (y for y in found if y > x):
            both = [(where[t], k) for k, t in enumerate(media.token(found[y]).tolist()) if t in where]
            if len(both) < p.votes:
                continue
            a, b = found[x][[i for i, _ in both]], found[y][[j for _, j in both]]
            ok = media.near(a, b, p)
            most = 0
            for oy in (0, p.bin // 2):
                for ox in (0, p.bin // 2):
                    votes = Counter()
                    for s in media.shifts(a[ok], b[ok], p).tolist():
                        dy, dx = (s >> 26) % (2 * media.MID) - media.MID, s % (2 * media.MID) - media.MID
                        votes[s >> 52, (dy + oy) // p.bin, (dx + ox) // p.bin] += 1
                    most = max([most, *votes.values()])
            if most >= p.votes:
                u, v = sorted((find(x), find(y)))
                root[v] = u
    return {i: find(i) for i in images}


def as_media(spark, rows):
    return spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in rows], "id long, media binary")


def glyphs(rng, rows, columns, size):
    return rng.integers(0, 256, (rows, columns)).astype(np.uint8).repeat(size, 0).repeat(size, 1)


@pytest.mark.parametrize("direct, votes", [(16, 9), (2, 24), (1, 60)])
def test_media_links_equal_those_of_all_pairs(spark, direct, votes):
    """Blocks shared by many images, some by nearly all: entries with few and with many images."""
    rng = np.random.default_rng(4)
    p = dataclasses.replace(media.PAGES, direct=direct, votes=votes)
    tiles = [glyphs(rng, 12, 12, 4) for _ in range(30)]
    images = {i: np.concatenate([tiles[k] for k in rng.choice(12, 6, replace=False)]) for i in range(24)}
    images |= {i: np.concatenate([tiles[20], glyphs(rng, 60, 12, 4)]) for i in range(40, 52)}
    images |= {60: images[0], 61: images[3][50:200]}
    frame = as_media(spark, [(i, media.encode_pgm(m)) for i, m in images.items()]).repartition(5)
    assert {r.id: r.component_id for r in media.copies(frame, p).collect()} == voted_components(images, p)


def test_media_links_across_keys_that_others_crowd(spark):
    """Two images share eight blocks, each of which ten others have too, other ones for each block."""
    rng = np.random.default_rng(6)
    shared = [glyphs(rng, 6, 12, 4) for _ in range(8)]
    pair = [np.concatenate([x for s in shared for x in (s, glyphs(rng, 6, 12, 4))]) for _ in range(2)]
    images = {0: pair[0], 1000: pair[1]}
    for k, s in enumerate(shared):
        images |= {1 + 10 * k + j: np.concatenate([glyphs(rng, 12, 12, 4), s, glyphs(rng, 12, 12, 4)]) for j in range(10)}
    p = dataclasses.replace(media.PAGES, direct=3, votes=30)
    want = voted_components(images, p)
    assert want[1000] == 0
    got = media.copies(as_media(spark, [(i, media.encode_pgm(m)) for i, m in images.items()]), p)
    assert {r.id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("tile", [512, 8])
def test_media_counts_every_link_in_groups_of_near_copies(spark, monkeypatch, tile):
    """Near copies share entries that many have: links are those of all pairs, not what spans the group."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(media, "TILE", tile)
    p = dataclasses.replace(media.PAGES, direct=4)
    shared = [glyphs(rng, 8, 12, 4) for _ in range(9)]
    images = {}
    for i in range(30):
        parts = [shared[k] for k in range(9) if k != i % 9][: 3 + i % 6]
        parts.insert(i % 3, glyphs(rng, 2 + i % 4, 12, 4))
        images[i] = np.concatenate(parts)
    images |= {100 + i: glyphs(rng, 30, 12, 4) for i in range(3)}
    rows = [(i, media.encode_pgm(m)) for i, m in images.items()]
    rows = sorted(rows, key=lambda r: hashlib.md5(r[1]).digest())  # votes go from the smaller digest to the greater
    found = {i: media.entries(*media.describe([images[i]], p)) for i, _ in rows}
    want = Counter()
    for x, (i, _) in enumerate(rows):
        for j, _ in rows[x + 1:]:
            both, u, v = np.intersect1d(media.token(found[i]), media.token(found[j]), return_indices=True)
            a, b = found[i][u], found[j][v]
            ok = media.near(a, b, p)
            s = media.shifts(a[ok], b[ok], p)
            dy, dx = (s >> 26) % (2 * media.MID) - media.MID, s % (2 * media.MID) - media.MID
            bins = [Counter(zip(s >> 52, (dy + oy) // p.bin, (dx + ox) // p.bin)) for oy in (0, p.bin // 2) for ox in (0, p.bin // 2)]
            if max(max(c.values(), default=0) for c in bins) >= p.votes:
                want.update((i, j))
    got = {r.id: r.links for r in media.copies(as_media(spark, rows).repartition(5), p).collect()}
    assert got == {i: want[i] for i in images}
    assert sum(want.values()) > 2 * len(images) and want[100] == 0


def test_media_finds_crops_edits_and_noise(spark):
    rng = np.random.default_rng(2)
    ims = [glyphs(rng, 24, 16, 10) for _ in range(6)]
    rows = [(i, media.encode_pgm(x)) for i, x in enumerate(ims)]
    rows += [(100 + i, media.encode_pgm(x[20:200, 10:150])) for i, x in enumerate(ims[:3])]
    rows += [(200 + i, media.encode_pgm(np.clip(x * 0.8 + 20, 0, 255))) for i, x in enumerate(ims[:3])]
    rows += [(250 + i, media.encode_pgm(np.clip(x + rng.normal(0, 3, x.shape), 0, 255))) for i, x in enumerate(ims[:3])]
    rows += [(300, None), (301, b""), (302, b"P5 9 9 255\nshort"), (303, b""), (0, rows[0][1]), (None, rows[0][1]), (None, None), (310, media.encode_pgm(ims[0][:3, :3])), (311, media.encode_pgm(ims[0][:3, :3]))]
    got = media.copies(as_media(spark, rows).withColumn("Copies", F.lit(1)).withColumn("digest", F.lit("x"))).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    for k in (100, 200, 250):
        assert [by[k + i].component_id for i in range(3)] == [0, 1, 2]
    assert [by[i].component_id for i in range(6)] == list(range(6)) and by[300].component_id == 300 and by[302].component_id == 302
    assert by[303].component_id == 301 and by[311].component_id == 310 and by[0].copies == 2 and by[None].component_id is None
    assert media.copies(as_media(spark, [])).count() == 0


def test_media_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").limit(40).collect()
    rows = [(r.page_id, r.html) for r in pages] + [(10_000 + r.page_id, r.html[:len(r.html) * 3 // 4]) for r in pages[:10]] + [(20_000, None), (20_001, ""), (20_002, "<p>"), (20_003, "<p>" + "long " * 40_000)]
    frame = spark.createDataFrame(rows, "id long, media string")
    by = {r.id: r.component_id for r in media.copies(frame, media.PAGES, html=True).collect()}
    images = {i: media.render(h) for i, h in rows if h}
    images = {i: m for i, m in images.items() if m.size}
    want = voted_components(images, media.PAGES)
    assert {i: by[i] for i in want} == want
    assert sum(by[10_000 + r.page_id] == by[r.page_id] for r in pages[:10]) >= 6


# Pipeline


def test_pipeline_stages(spark, sf, labels):
    d = docs(spark, sf)
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == d.columns
        assert 0 < after.count() <= kept.count()
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, sf):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        assert got.count() >= 0 and stage(spark, none, sf).count() == 0
        if name != "packing":
            assert got.columns == odd.columns
