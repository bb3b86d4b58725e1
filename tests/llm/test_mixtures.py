"""Resampling, vector codes and mixing against brute force, and on awkward tables."""

import dataclasses
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from loomgraph.llm import _common, mixing, resampling, vectorcodes
from tests.oracle import rows, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, Weight string"
LONG = "word two three " * 60_000 + "x" * 3_000 + " end"
ODD = [
    (1, "Alpha beta, gamma! delta", "en", "a", 5, 0.1, "x"), (1, "Alpha beta, gamma! delta", "en", "a", 5, 0.1, "x"),
    (2, None, None, None, None, None, None), (3, "", "en", "b", 0, 0.0, ""), (None, "no id at all but words " * 5, "en", None, 3, 0.5, "y"),
    (4, " \t\n ", "en", "s", 4, 0.0, "z"), (5, LONG, "en", "a", len(LONG), 0.2, "l"), (6, "Été あい \U0001f600x 12 AÄ", "fr", "é", 9, 0.3, "q"),
    (7, "one", "en", "b", 3, None, None), (None, "no id at all but words " * 5, "en", None, 3, 0.5, "y"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Resampling


def runs_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def resampled(docs, target):
    """doc_id, n_features, weight, score, rank by the formula, without postings."""
    counted = [(i, *runs_of(t)) for i, t in docs]
    own, other = Counter(), Counter()
    for _, _, c in counted:
        own.update(c)
    for t in target:
        other.update(runs_of(t)[1])
    s, t = sum(own.values()), sum(other.values())
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in own}
    out = []
    for i, n, c in counted:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    fit = sorted((k for k, o in enumerate(out) if o[4] >= 20), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0]))
    place = {k: r for r, k in enumerate(fit[:5 * len(fit) // 100], 1)}
    return pd.DataFrame([[*o[:4], place.get(k)] for k, o in enumerate(out)], columns=["doc_id", "n_features", "weight", "score", "rank"])


def test_resampling_of_documents(spark, sf):
    docs, target = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    got = resampling.op11_resampling(spark, sf)
    assert {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert rows(got.toPandas()) == rows(resampled(zip(docs.doc_id, docs.text), target.text))


@pytest.mark.parametrize("block_bytes, slab", [(1 << 16, 1), (300, 2)])
def test_resampling_in_many_blocks(spark, odd, block_bytes, slab):
    many = [(i, f"w{i % 7} common words here {i % 11} and w{i % 3} again the " * 3) for i in range(300)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(many, "doc_id long, text string"))
    target = spark.createDataFrame([(1, "common words w3"), (2, None), (3, LONG)], "item_id long, text string")
    p = dataclasses.replace(resampling.DEFAULT, block_bytes=block_bytes, block_docs=50, slab=slab, parts=7)
    got = resampling.resample(docs, target, p).toPandas()
    assert rows(got) == rows(resampled([(i, t) for i, t, *_ in ODD] + many, ["common words w3", None, LONG]))


def test_resampling_of_empty_tables(spark, odd, none):
    assert resampling.resample(none, none).count() == 0
    assert rows(resampling.resample(odd, none).toPandas()) == rows(resampled([(i, t) for i, t, *_ in ODD], []))


def test_crcs_of_runs_are_those_of_their_text():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(1, n))) for n in (3, 9, 90, 400, 5000) for _ in range(6)]
    rng.shuffle(words)
    p = dataclasses.replace(resampling.DEFAULT, buckets=2**32 - 1, block_bytes=600)
    raw = b" ".join(words)
    found, stream, at = Counter(), resampling._Runs(p), 0
    for at, piece in resampling._pieces(raw, 600):
        buf = np.frombuffer(piece, np.uint8)
        edge = np.flatnonzero(np.diff((buf != 32).view(np.int8), prepend=0, append=0))
        if len(edge):
            found.update(stream.buckets(buf, edge[::2], edge[1::2], np.zeros(len(edge) // 2, np.int64))[0].tolist())
    assert found == Counter(zlib.crc32(b" ".join(words[i:i + n])) % p.buckets for n in (1, 2, 3) for i in range(len(words) - n + 1))


def test_postings_unpack():
    rng = np.random.default_rng(4)
    bucket = np.sort(rng.integers(0, 9, 500))
    doc, count = rng.integers(0, 8192, 500), rng.integers(1, 2**31, 500)
    got = resampling.unpack(resampling.pack(np.bincount(bucket, minlength=9), doc, count), 9)
    assert [x.tolist() for x in got] == [bucket.tolist(), doc.tolist(), count.tolist()]
    assert [len(x) for x in resampling.unpack(resampling.pack(np.zeros(5, int), doc[:0], count[:0]), 5)] == [0, 0, 0]


# Vector codes


def test_codes_equal_sql(spark, sf):
    same(vectorcodes.op12_codes(spark, sf), vectorcodes.OP12_SQL, sf)


@pytest.mark.parametrize("width, spread", [(1, 5), (2, 50), (7, 300), (8, 2000), (16, 2**20), (32, 9)])
def test_bounds_lose_no_nearest_entry(width, spread):
    rng = np.random.default_rng(width)
    book = rng.integers(-spread, spread + 1, (16, width))
    book[9] = book[3]
    x = np.concatenate([rng.integers(-spread, spread + 1, (500, width)), book, (book[:8] + book[8:]) // 2, book * 3 + 1])
    entry, far, _ = vectorcodes.nearest(x, book, 3)
    every = np.square(x[:, None, :] - book[None]).sum(axis=2)
    assert entry.tolist() == every.argmin(axis=1).tolist() and far.tolist() == every.min(axis=1).tolist()


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (16, 8))
    x = book[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    assert vectorcodes.nearest(x, book)[2] < 4000 * 16 / 4


def coded(vectors, parts=8, entries=16, rounds=6):
    """Codes by plain loops in whole numbers: {row: (code, error)}, codebooks' digest."""
    x = {k: [math.floor(4096 * c) for c in v] for k, (_, v) in vectors.items()}
    width = len(next(iter(x.values())))
    edge = [i * width // parts for i in range(parts + 1)]
    first = sorted(vectors, key=lambda k: (vectors[k][0] is None, vectors[k][0], x[k]))[:entries]
    books = [[x[k][a:b] for k in first] for a, b in zip(edge, edge[1:])]

    def near(part, book):
        d = [sum((p - q) ** 2 for p, q in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        for n, (a, b) in enumerate(zip(edge, edge[1:])):
            members = defaultdict(list)
            for v in x.values():
                members[near(v[a:b], books[n])[0]].append(v[a:b])
            books[n] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if members[e] else old for e, old in enumerate(books[n])]
    out = {k: [near(v[a:b], books[n]) for n, (a, b) in enumerate(zip(edge, edge[1:]))] for k, v in x.items()}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {k: ("".join(f"{e:02x}" for e, _ in v), sum(d for _, d in v)) for k, v in out.items()}, digest


@pytest.mark.parametrize("width, number", [(8, 5), (20, 60), (64, 40)])
def test_codes_by_loops(spark, width, number):
    rng = np.random.default_rng(width)
    good = [(i if i else None, rng.normal(size=width).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(number)]
    good += [(3, good[3][1], 1), (number + 9, good[4][1], None), (number + 10, [5000.0] * width, 7)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [None] + [1.0] * (width - 1), 1), (-4, [float("nan")] * width, 2), (-5, [float("inf")] * width, None), (-6, [1.0] * (width + 1), 1)]
    table = spark.createDataFrame([(*r, "e") for r in good + bad], "vec_id long, embedding array<float>, label int, Code string")
    got = vectorcodes.compress(table).toPandas()
    want, digest = coded(dict(enumerate((i, v) for i, v, _ in good)))
    sums = defaultdict(int)
    for k, (_, _, label) in enumerate(good):
        sums[label] += want[k][1]
    frame = pd.DataFrame([(i, *want[k], sums[label], digest) for k, (i, _, label) in enumerate(good)], columns=["vec_id", "code", "error", "label_error", "codebooks_sha256"])
    assert rows(got) == rows(frame)


def test_codes_of_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectorcodes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 2), (2, [], None)], schema)).count() == 0


def test_codes_of_huge_components(spark):
    table = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 64, i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    got = vectorcodes.compress(table).toPandas()
    assert len(got) == 40 and (got.error == 0).all() and got.code.nunique() == 2


# Mixing


def shared(sizes, weights=(1, 2, 3), most=3):
    """Targets by handing out what stopped sources leave, round by round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, going = {s: 0.0 for s in sizes}, float(sum(sizes.values())), {s for s in sizes if sizes[s]}
    while left > 1e-9 and going:
        unit, left = left / sum(weight[s] for s in going), 0.0
        for s in list(going):
            target[s] += unit * weight[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                going.discard(s)
    return target


def check_mix(docs, got, p=mixing.DEFAULT):
    sizes, largest = Counter(), Counter()
    for _, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = shared(sizes)
    keys = lambda frame: sorted(map(repr, frame))
    assert keys((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sizes[s], round(want[s], 3)) for i, t, s in docs) == \
        keys((r.doc_id, r.size, r.source_size, round(r.target, 3)) for r in got)
    taken = Counter()
    for r in got:
        assert r.taken <= p.most * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        if r.size:
            assert abs(r.taken / r.size - r.target / r.source_size) < 1
        taken[(r.source_size, round(r.target, 3))] += r.taken
    aim, slack = Counter(), Counter()
    for s in sizes:
        aim[(sizes[s], round(want[s], 3))] += want[s]
        slack[(sizes[s], round(want[s], 3))] += largest[s]
    assert all(abs(taken[k] - aim[k]) <= slack[k] + 1e-6 for k in aim)


def test_mixing_of_documents(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = mixing.op13_mixing(spark, sf).collect()
    check_mix(list(zip(docs.doc_id, docs.text, docs.source)), got)
    assert sorted(got) == sorted(mixing.op13_mixing(spark, sf).collect())


@pytest.mark.parametrize("leaf_rows, fan", [(50_000, 64), (40, 3)])
def test_mixing_up_a_tree(spark, leaf_rows, fan):
    rng = np.random.default_rng(9)
    docs = [(i, "w " * int(rng.integers(0, 40)), ["big", "tiny", None, "mid"][min(3, int(rng.integers(0, 12)))] if i % 3 else "hot") for i in range(1500)]
    p = dataclasses.replace(mixing.DEFAULT, leaf_rows=leaf_rows, fan=fan)
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(table, p).collect()
    check_mix(docs, got, p)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(table.repartition(7), p).collect()))


def test_mixing_of_odd_tables(spark, odd, none):
    check_mix([(i, t, s) for i, t, _, s, *_ in ODD], mixing.mix(odd).collect())
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_transfer_keeps_words_and_means():
    rng = np.random.default_rng(2)
    for _ in range(300):
        s, t = rng.integers(1, 500, 2)
        p, q = rng.uniform(0.01, 0.99, 2)
        ends = [mixing.transfer(s, p, t, q, u) for u in (0.0, 1 - 1e-12)]
        for a, b in ends:
            assert abs(s * a + t * b - s * p - t * q) < 1e-6 and (a in (0, 1) or b in (0, 1)) and 0 <= min(a, b) and max(a, b) <= 1
        up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
        chance = down / (up + down)
        assert abs(chance * ends[0][0] + (1 - chance) * ends[1][0] - p) < 1e-9


# Shared steps


def test_numbered_without_one_partition(spark):
    table = spark.createDataFrame([(i % 50, i % 3 or None) for i in range(500)] + [(7, 1)] * 300, "a long, b long")
    got = _common.numbered(table, [table.a.desc(), table.b.asc_nulls_last()], "n", "test").collect()
    assert sorted(r.n for r in got) == list(range(1, 801))
    order = sorted(got, key=lambda r: r.n)
    assert order == sorted(order, key=lambda r: (-r.a, r.b is None, r.b or 0))


def test_values_join_with_and_without_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(200)], "i long, k long")
    values = spark.createDataFrame([(None, 100), (1, 1), (2, 2), (3, 3)], "k long, v long")
    small = sorted(map(tuple, _common.with_values(table, values, "k", table.i).collect()))
    monkeypatch.setattr(_common, "LOOKUP_ROWS", 0)
    assert sorted(map(tuple, _common.with_values(table, values, "k", table.i).collect())) == small
    assert {r[:2]: r[2] for r in small}[(0, None)] == 100 and {r[:2]: r[2] for r in small}[(4, 4)] is None
