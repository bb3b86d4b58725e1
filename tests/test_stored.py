"""The stored index and the links kept up equal what is computed anew after any series of changes."""

import math
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.index import TextIndex, term_counts
from loomgraph.operators.upkeep import Links, changed_files, decision
from loomgraph.plans.buckets import BucketStore, Layout, bucket_of
from loomgraph.plans.tables import plain_tokens

VOCABULARY = [f"w{i}" for i in range(40)] + ["the"] * 12


def _root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def scored(texts, words, tokens=lambda t: t.lower().split()):
    """BM25 by loops: {doc: (score, matched)}."""
    counts = {i: Counter(tokens(t or "")) for i, t in texts.items()}
    n, avg = sum(map(len, counts.values())), sum(sum(c.values()) for c in counts.values()) / max(1, len(counts))
    out = {}
    for w in set(words):
        df = sum(w in c for c in counts.values())
        for i, c in counts.items():
            if w in c:
                s = max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
                a, b = out.get(i, (0.0, 0))
                out[i] = (a + s, b + 1)
    return {i: (round(a, 6), b) for i, (a, b) in out.items()}


def found(index, words):
    return {r.doc_id: (round(r.score, 6), r.matched) for r in index.bm25(words).collect()}


def test_index_after_any_changes(spark, tmp_path):
    rng, texts = random.Random(5), {}
    root = _root(tmp_path)
    index = TextIndex(spark, root, buckets=8)
    make = lambda: " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 30)))
    words = ["w1", "w7", "the", "absent"]
    for step in range(6):
        if step in (2, 4):
            ids = rng.sample(sorted(texts), 9)
            index.delete(_docs(spark, [(i, None) for i in [*ids, 10_000]]))
            for i in ids:
                del texts[i]
        else:
            new = {i: make() for i in rng.sample(range(60), 25)}
            index.append(_docs(spark, list(new.items())))
            texts |= new
        if step == 3:
            index.compact()
            assert len(index.store.versions("postings")) == 1
        assert found(index, words) == scored(texts, words)
        counts = [Counter(t.split()) for t in texts.values()]
        assert index.totals == {"docs": len(texts), "tokens": sum(sum(c.values()) for c in counts), "postings": sum(map(len, counts))}
    # Another reader sees the same, and so after what is no longer live is deleted.
    assert index.store.vacuum() > 0
    again = TextIndex(spark, root, buckets=8)
    assert found(again, words) == scored(texts, words) and again.totals == index.totals
    assert {(r.token, r.doc_id): r.tf for r in again.all_postings().collect()} == {(w, i): k for i, t in texts.items() for w, k in Counter(t.split()).items()}


def test_index_opens_only_the_buckets_of_the_words(spark, sf, tmp_path):
    index = TextIndex(spark, _root(tmp_path), buckets=16)
    index.append(spark.read.parquet(f"{sf}/documents.parquet"))
    postings = index.postings(["thing"])
    buckets = {f.split("bucket=")[1].split("/")[0] for f in postings.inputFiles()}
    assert len(buckets) == 1 and all("/postings/" in f for f in postings.inputFiles())
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,thing)]" in postings._jdf.queryExecution().toString().replace("In(token, [thing])", "EqualTo(token,thing)")
    assert index.postings(["nosuchword"]).count() == 0 == index.postings([]).count()


def test_index_with_stems(spark, tmp_path):
    texts = {1: "Running runners run the getUserName", 2: None, 3: "A user runs", 4: "names of users"}
    index = TextIndex(spark, _root(tmp_path), tokens=T.index_tokens, buckets=4)
    index.append(_docs(spark, list(texts.items())))
    words = T.tokenize("running users")
    assert found(index, words) == scored(texts, words, T.tokenize)


def test_index_of_odd_rows(spark, tmp_path):
    index = TextIndex(spark, _root(tmp_path), buckets=4)
    assert found(index, ["a"]) == {} and index.totals["docs"] == 0
    index.append(_docs(spark, []))
    index.delete(_docs(spark, [(1, "x")]))
    long = "a b " * 50_000
    index.append(_docs(spark, [(1, None), (2, ""), (None, "a"), (3, long)]).withColumn("Token", F.lit("clash")).withColumn("version", F.lit(1)))
    assert index.totals == {"docs": 3, "tokens": 100_000, "postings": 2} and set(found(index, ["a", "a"])) == {3}
    with pytest.raises(ValueError):
        index.append(_docs(spark, [(7, "a"), (7, "b")]))
    assert index.totals["docs"] == 3 and set(found(index, ["a"])) == {3}


def test_index_is_loaded_or_built(spark, tmp_path):
    root, docs = _root(tmp_path), _docs(spark, [(1, "a"), (2, "b")])
    first = TextIndex.load_or_build(spark, root, docs, "s1", buckets=4)
    same = TextIndex.load_or_build(spark, root, docs.where("false"), "s1", buckets=4)
    assert same.store.now.number == first.store.now.number and found(same, ["a"]).keys() == {1}
    other = TextIndex.load_or_build(spark, root, _docs(spark, [(3, "a")]), "s2", buckets=4)
    assert found(other, ["a", "b"]).keys() == {3} and other.totals["docs"] == 1


def test_index_from_a_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), _root(tmp_path)
    for k in range(3):
        _docs(spark, [(i, f"a b{k}") for i in range(k, k + 5)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(lambda df, n: TextIndex(spark, root, buckets=4).append(df)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    index = TextIndex(spark, root, buckets=4)
    assert index.totals["docs"] == 7 and found(index, ["b0"]).keys() == {0} and found(index, ["b2"]).keys() == {2, 3, 4, 5, 6}


def test_terms_without_a_shuffle(spark):
    rows = term_counts(_docs(spark, [(1, "b a b c b")]), plain_tokens)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [("", 1, 3, 5), ("a", 1, 1, 5), ("b", 1, 3, 5), ("c", 1, 1, 5)]


# Store


def test_store_shows_whole_commits(spark, tmp_path):
    root, layouts = _root(tmp_path), {"t": Layout("k string, v long", "k", ("k", "v"), 4)}
    store = BucketStore(spark, root, layouts)
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v long")
    added = {"t": store.write("t", rows)}
    assert BucketStore(spark, root, layouts).read("t").count() == 0
    store.commit(added, notes={"n": 1})
    assert sorted(r.k for r in BucketStore(spark, root, layouts).read("t").collect()) == ["a", "b"]
    b = store.buckets("t", ["a"])
    assert b == store.buckets("t", rows.where("k = 'a'")) == [r[0] for r in rows.where("k = 'a'").select(bucket_of(F.col("k"), 4)).collect()]
    store.write("t", rows)  # a writer that dies before its commit
    store.commit({"t": store.write("t", rows.where("k = 'a'").withColumn("v", F.lit(9).cast("long")))}, {"t": b})
    held = BucketStore(spark, root, layouts)
    kept = {r.k: r.v for r in held.read("t").collect()}
    assert kept["a"] == 9 and held.now.notes == {"n": 1}
    assert held.vacuum() > 0 and {r.k: r.v for r in BucketStore(spark, root, layouts).read("t").collect()} == kept


# Links


def linked(files):
    """(src, dst) by loops over {file: (defs, refs)}."""
    anchors = {}
    for defs, _ in files.values():
        for name, anchor in defs:
            anchors.setdefault(name, set()).add(anchor)
    return {(src, min(anchors[n])) for _, refs in files.values() for n, src in refs if len(anchors.get(n, ())) == 1 and src != min(anchors[n])}


def test_links_after_any_edits(spark, tmp_path):
    rng, files = random.Random(3), {}
    links = Links(spark, _root(tmp_path), buckets=8)

    def content(f):
        names = [f"n{rng.randint(0, 25)}" for _ in range(6)]
        return ([(n, f"{f}#{n}" if rng.random() < 0.8 else "shared") for n in names[:3]], [(n, f) for n in names[3:] + ["n1"]])
    for step in range(5):
        some = [f"f{i}" for i in range(20)] if step == 0 else rng.sample([f"f{i}" for i in range(24)], 4)
        before = linked(files)
        for f in some:
            if step and rng.random() < 0.3:
                files.pop(f, None)
            else:
                files[f] = content(f)
        frame = spark.createDataFrame([(f,) for f in some], "file string")
        defs = spark.createDataFrame([(f, *d) for f in some if f in files for d in files[f][0]] + [("unchanged", "n1", "no")], "file string, name string, anchor string")
        refs = spark.createDataFrame([(f, *r) for f in some if f in files for r in files[f][1]], "file string, name string, src string")
        did = links.update(frame, defs, refs)
        got = {tuple(r) for r in links.links().collect()}
        assert got == linked(files)
        assert did.added >= len(got - before) and did.retracted >= len(before - got)
    again = links.update(frame, defs, refs)
    assert (again.names, again.added, again.retracted) == (0, 0, 0) and {tuple(r) for r in links.links().collect()} == linked(files)


def test_links_touch_only_their_buckets(spark, tmp_path):
    links = Links(spark, _root(tmp_path), buckets=64)
    files = {f"f{i}": ([(f"n{i}", f"a{i}")], [(f"n{i + 1}", f"a{i}")]) for i in range(200)}
    one = lambda fs: spark.createDataFrame([(f,) for f in fs], "file string")
    defs = spark.createDataFrame([(f, *d) for f, (ds, _) in files.items() for d in ds], "file string, name string, anchor string")
    refs = spark.createDataFrame([(f, *r) for f, (_, rs) in files.items() for r in rs], "file string, name string, src string")
    assert links.update(one(files), defs, refs).added == 199
    did = links.update(one(["f5"]), spark.createDataFrame([("f5", "n5", "a5"), ("f5", "n9", "a5")], "file string, name string, anchor string"), refs.where("file = 'f5'"))
    # n9 has two anchors now: the link of f8 goes, nothing else.
    assert (did.names, did.retracted, did.added) == (1, 1, 0) and did.buckets <= 3
    assert links.links().count() == 198


def test_freshness(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "file string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "file string, hash string")
    changes = changed_files(stored, now)
    assert {tuple(r) for r in changes.collect()} == {("b", "changed"), ("d", "new")}
    assert [decision(changes, n).first().decision for n in (4, 40)] == ["rebuild", "update"]
    assert decision(changed_files(now, now), 4).first().decision == "fresh"
