"""Tables with large groups: results of plain loops, and work that grows no faster than the rows."""

import math
import random
import re
import threading
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import analytics, index, linking, retrieval, rules
from loomgraph.plans import tables
from loomgraph.plans.queries import QUERIES


def within(spark, seconds, work):
    """What ``work`` gives; its Spark jobs are stopped, and so fail, after so many seconds."""
    sc = spark.sparkContext
    timer = threading.Timer(seconds, sc.cancelAllJobs)
    timer.start()
    try:
        return work()
    finally:
        timer.cancel()


def shuffled(spark, work):
    """What ``work`` gives, and the bytes that its stages wrote to shuffles."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}
    before = stages()
    out = work()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def resolved(calls, names):
    """Tiers pair by pair."""
    tiers = defaultdict(lambda: ([], [], []))
    for caller, file, module, name in calls:
        for n, anchor, f, m in names:
            if None not in (name, caller, anchor) and n == name and anchor != caller:
                t = 0 if f == file and f is not None else 1 if m == module and m is not None else 2
                tiers[caller, name][t].append(anchor)
    first = {k: next(x for x in v if x) for k, v in tiers.items()}
    return {(*k, v[0]) for k, v in first.items() if len(v) == 1}


CALLS, NAMES = "caller int, file string, module string, name string", "name string, anchor int, file string, module string"


def test_locality_is_what_pairs_give(spark):
    rng = random.Random(3)
    for size in (3, 8, 30, 60):
        pick = lambda of: rng.choice([*of, None])
        calls = [(pick(range(8)), pick("fgh"), pick("mn"), pick("abcdefg"[:size // 4 + 1])) for _ in range(size)]
        names = [(pick("abcdefg"[:size // 4 + 1]), pick(range(8)), pick("fgh"), pick("mn")) for _ in range(size // 2)]
        got = linking.resolve_local(spark.createDataFrame(calls, CALLS), spark.createDataFrame(names, NAMES)).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == resolved(calls, names)


def test_a_name_that_every_caller_has(spark):
    """Two symbols of each file: each caller's is the other one. Met by name they are 3.6 billion pairs."""
    names = spark.range(60_000).select(F.lit("new").alias("name"), F.col("id").alias("anchor"), F.floor(F.col("id") / 2).cast("string").alias("file"), F.lit("m").alias("module"))
    calls = names.withColumnRenamed("anchor", "caller")
    out = linking.resolve_local(calls, names).withColumn("ok", F.col("anchor") == F.col("caller") + 1 - 2 * (F.col("caller") % 2))
    assert within(spark, 60, lambda: [tuple(r) for r in out.groupBy("ok").count().collect()]) == [(True, 60_000)]


def test_pairs_are_dealt_by_rows(spark):
    """A task's rows do not grow with the table, even where all of them would fit one task by their bytes."""
    rows = spark.range(0, 3_000_000, numPartitions=8).select(F.floor(F.col("id") / 2).alias("a"), F.floor(F.col("id") / 6).alias("b"))
    out = tables.distinct_pairs(rows, "a", "b")
    assert out.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count") <= tables.TASK_ROWS).first()[:] == (1_500_000, True)
    assert out.rdd.getNumPartitions() == 6


def nearest_by_loops(rows, threshold, k):
    """(src, dst) of each vector's k nearest others, pair by pair."""
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v]
    out = {}
    for i, v in rows:
        for j, w in rows:
            if i != j and len(v) == len(w) and v.any() and w.any():
                out.setdefault(i, []).append((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 9), j))
    return {(i, j, s) for i, near in out.items() for s, j in sorted(near)[:k] if -s >= threshold}


def test_similar_pairs_are_what_loops_give(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)]
    rows += [(i, [1.0, 2.0, 2.0, 0.0]) for i in range(100, 130)] + [(200, None), (None, [1.0, 0.0, 0.0, 0.0]), (201, [0.0] * 4), (202, [1.0, 2.0]), (203, [2.0, 1.0])]
    for block in (7, 4096):
        got = retrieval.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.5, 3, block=block).collect()
        wanted = nearest_by_loops(rows, 0.5, 3)
        assert sorted((r.src, -round(r.score, 9)) for r in got) == sorted((i, s) for i, _, s in wanted)
        assert {r.dst for r in got if r.src in range(100, 130)} <= {100, 101, 102, 103}


def test_similar_pairs_shuffle_each_vector_once(spark):
    """Twice the vectors are twice the shuffle, not four times."""
    def work(n):
        v = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.sin(F.col("id") * x)).alias("embedding"))
        return shuffled(spark, lambda: retrieval.similar_pairs(v, 2.0, 3, block=100).count())
    (few, a), (many, b) = work(3_000), work(6_000)
    assert few == many == 0 and b < 3 * a


def test_alike_sets_are_what_loops_give(spark):
    rng = random.Random(7)
    sets = lambda n, most: [(i, rng.sample("abcdefghijkl", rng.randint(0, most))) for i in range(n)] + [(n, None)]
    docs, items = sets(60, 12), sets(9, 5)
    got = retrieval.alike_sets(spark.createDataFrame(docs, "doc_id int, s array<string>"), spark.createDataFrame(items, "item_id int, q array<string>"), 0.3).collect()
    pairs = [(i, d, len({*q} & {*s}) / len({*q} | {*s})) for d, s in docs for i, q in items if s and q]
    assert sorted((r.item_id, r.doc_id, round(r.x, 9)) for r in got) == sorted((i, d, round(x, 9)) for i, d, x in pairs if x >= 0.3)


def test_sets_of_other_sizes_are_not_counted(spark):
    """Documents with all words of every item, but far too many others."""
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: x.cast("string")).alias("s"))
    items = spark.range(50).select(F.col("id").alias("item_id"), F.array(F.lit("1"), F.lit("2"), (F.col("id") % 90 + 3).cast("string")).alias("q"))
    rows, size = shuffled(spark, lambda: retrieval.alike_sets(docs, items, 0.3).count())
    assert rows == 0 and size < 100_000


def test_commits_are_dealt_by_rows(spark):
    """Commits are in as many tasks as their rows need, not as few as their bytes would fit."""
    commits = spark.range(3_200_000).select(F.floor(F.col("id") / 4).alias("commit_id"), F.lit(1).alias("file"))
    plan = linking.cochange(commits, 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(commit_id" in plan and ", 7), REPARTITION_BY_NUM" in plan


def test_cochange_is_what_loops_give(spark):
    rng = random.Random(9)
    rows = [(rng.choice([*range(25), None]), rng.choice([*range(12), None])) for _ in range(200)]
    held = defaultdict(set)
    for commit, file in rows:
        if commit is not None and file is not None:
            held[commit].add(file)
    wanted = defaultdict(int)
    for files in held.values():
        if 2 <= len(files) <= 7:
            for a in files:
                for b in files:
                    wanted[a, b] += a < b
    got = linking.cochange(spark.createDataFrame(rows, "commit_id int, file int"), 3, 2, 7).collect()
    assert {tuple(r) for r in got} == {(*p, n) for p, n in wanted.items() if n >= 3} and len(got) == len(set(got))


def test_terms_are_what_a_counter_counts(spark):
    rows = [("a", "b b  a"), ("b", None), ("c", ""), (None, "x"), ("d", " ".join(map(str, range(500))) + " 7")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = index.term_counts(docs, lambda t: F.split(t, " "))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    wanted = set()
    for d, text in rows:
        if d is not None:
            words = [w for w in (text or "").split(" ") if w]
            wanted |= {(w, d, n, len(words)) for w, n in Counter(words).items()} | {(index.SELF, d, len(set(words)), len(words))}
    got = found.collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_orphans_combine_ends_by_hash(spark):
    """Two nodes may have one anchor; ends are made distinct by hash, not listed in sorted groups."""
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "x")], "anchor string, node_type string")
    edges = spark.createDataFrame([("a", "z", "Uses")] * 3 + [("c", "c", "Uses")], "src string, dst string, edge_type string")
    out = rules.orphans(nodes, edges)
    assert sorted(map(tuple, out.collect())) == [("b", "x"), ("b", "y")]
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_document_frequency_shuffles_words_only(spark, sf):
    assert "doc_id" not in QUERIES["discriminative_terms"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_word_pairs_are_what_loops_give(spark):
    """Documents with one id and one length are one; null texts, null ids and letters that are no a-z; batches of any size."""
    rng = random.Random(11)
    pick = lambda: " ".join(rng.choice(["a", "b2", "C", "é", "d-e", "\u212a", "zz.", *map(str, range(30))]) for _ in range(rng.randint(0, 9)))
    rows = [(rng.choice([*range(40), None]), rng.choice([pick(), pick(), None])) for _ in range(90)] + [(1, "x y"), (1, "y x"), (1, " x"), (2, "")]
    postings = {(t, i, len(words)) for i, text in rows for words in [re.findall("[a-z0-9]+", (text or "").lower())] for t in words}
    df = Counter(t for t, *_ in postings)
    held = defaultdict(list)
    for t, i, _ in postings:
        if 3 <= df[t] <= 9 and i is not None:
            held[i].append(t)
    co = Counter((a, b) for words in held.values() for a in words for b in words if a < b)
    wanted = sorted((a, b, k, round(max(0, math.log2(k * len(rows) / df[a] / df[b])), 9)) for (a, b), k in co.items())
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    for most in (1, 60, 8_000_000):
        got = retrieval.ppmi(retrieval.seldom_words(docs, 9, most), docs.agg(F.count(F.lit(1)).alias("n")), 3, 9).collect()
        assert sorted((r.a, r.b, r.co, round(r.score, 9)) for r in got) == wanted and wanted


def test_word_pairs_up_to_a_fifth_of_the_documents(spark, tmp_path):
    """No pair is left out for its words' number of documents, nor for sharing one document only."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, int(60 * rng.random() ** 2) + 6)}" for _ in range(9)) for _ in range(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [set(t.split()) for t in texts]
    df = Counter(w for s in sets for w in s)
    co = Counter((a, b) for s in sets for a in s for b in s if a < b and 3 <= df[a] <= 20 and 3 <= df[b] <= 20)
    wanted = sorted((a, b, k, round(max(0, math.log2(k * 100 / df[a] / df[b])), 6)) for (a, b), k in co.items())
    assert {1, 2} < set(co.values()) and max(df.values()) > 20 and any(df[a] > 5 for a, _ in co)
    assert sorted(map(tuple, QUERIES["ppmi_pairs"](spark, str(tmp_path)).collect())) == wanted


def test_numbers_that_meet_are_counted_in_small_buckets(spark):
    """Any number of pairs a bucket; lists with repeated numbers, of one and of none."""
    rng = random.Random(3)
    lists = [sorted(int(200 * rng.random() ** 3) for _ in range(rng.randint(0, 25))) for _ in range(90)]
    wanted = Counter((x, y) for ids in lists for x in ids for y in ids if y < x)
    table = spark.createDataFrame([(x,) for x in lists], "ids array<int>").repartition(3)
    for most in (40, 2_000, 1 << 24):
        got = retrieval._met(table, most).collect()
        assert len(got) == len(wanted) and {(r.x, r.y): r.co for r in got} == wanted


def test_frequent_words_are_not_shuffled_by_document(spark, tmp_path):
    """Words that all documents have take a row a batch, and texts are cut into words once."""
    spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), F.lit(200)), F.col("id") + 1_000).alias("text")).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows, size = shuffled(spark, lambda: QUERIES["ppmi_pairs"](spark, str(tmp_path)).count())
    assert rows == 0 and size < 400_000


def test_ranks_read_their_edges_once(spark):
    """However many steps there are; parallel edges, loops and nodes beside all edges as in plain loops."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    pairs = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("c", "d")]
    edges = spark.createDataFrame(pairs, "src string, dst string").mapInArrow(count, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdea"], "anchor string")
    got = {r.anchor: r.rank for r in analytics.pagerank(nodes, edges, iterations=3, tolerance=0.0).collect()}
    assert seen.value == len(pairs)
    walked, rank = [(a, b) for a, b in pairs if a != b], dict.fromkeys("abcde", 0.2)
    degree = Counter(a for a, _ in walked)
    for _ in range(3):
        rest = sum(r for x, r in rank.items() if not degree[x])
        rank = {x: 0.15 / 5 + 0.85 * (rest / 5 + sum(rank[a] / degree[a] for a, b in walked if b == x)) for x in rank}
    assert {x: round(r, 9) for x, r in got.items()} == {x: round(r, 9) for x, r in rank.items()}


def louvain_by_loops(rows, gamma, margin, standard):
    """The community of each node, in dictionaries."""
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    loops = [0.0] * len(names)
    for a, b, w in rows:
        i, j = at[a], at[b]
        if i == j:
            loops[i] += w
        else:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    member = list(range(len(names)))
    while True:
        n = len(near)
        k = [sum(near[i].values()) + 2 * loops[i] for i in range(n)]
        m2 = sum(k)
        com, tot = list(range(n)), list(k)
        moved_any = False
        if m2 > 0:
            moved = True
            while moved:
                moved = False
                for i in range(n):
                    into: dict[int, float] = {com[i]: 0.0}
                    for j, w in near[i].items():
                        into[com[j]] = into.get(com[j], 0.0) + w
                    tot[com[i]] -= k[i]
                    value = {c: w - gamma * tot[c] * k[i] / m2 for c, w in into.items()}
                    best = com[i]
                    for c in sorted(value):
                        if value[c] > value[best] + margin:
                            best = c
                    tot[best] += k[i]
                    if best != com[i]:
                        com[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        number = {c: x for x, c in enumerate(sorted(set(com)))}
        com = [number[c] for c in com]
        member = [com[x] for x in member]
        near2: list[dict[int, float]] = [{} for _ in number]
        loops2 = [0.0] * len(number)
        for i in range(n):
            loops2[com[i]] += loops[i]
            for j, w in near[i].items():
                if com[i] == com[j]:
                    loops2[com[i]] += w / 2 if standard else w
                else:
                    near2[com[i]][com[j]] = near2[com[i]].get(com[j], 0.0) + w
        near, loops = near2, loops2
    return {x: member[at[x]] for x in names}


def test_communities_are_what_loops_give(spark):
    """Loops, parallel pairs in both directions, several components; names in order of their code points."""
    rng = random.Random(13)
    for n, size in ((4, 3), (12, 30), (40, 70), (40, 200)):
        names = [rng.choice("aZ\u00e9\U0001f600\uffee") + str(i) for i in range(n)]
        rows = [(rng.choice(names), rng.choice(names), float(rng.randint(0, 3))) for _ in range(size)]
        pairs = spark.createDataFrame(rows, "a string, b string, w double").repartition(3)
        for gamma, standard in ((1.0, True), (1.0, False), (0.5, True)):
            got = {r.anchor: r.community for r in analytics.louvain(pairs, gamma=gamma, standard=standard).collect()}
            member = louvain_by_loops(rows, gamma, 1e-12, standard)
            number = {c: i for i, c in enumerate(dict.fromkeys(member[x] for x in sorted(member)))}
            assert got == {x: number[c] for x, c in member.items()}
    assert analytics.louvain(pairs.where("false")).count() == 0


def test_communities_take_little_memory_a_pair():
    """A star, a path and loose pairs; dictionaries took over 500 bytes a node."""
    n = 60_000
    i = np.arange(n, dtype=np.int32)
    a, b = np.r_[np.zeros(n // 3, np.int32), i[n // 3:-1]], np.r_[i[:n // 3], i[n // 3:-1] + 1]
    tracemalloc.start()
    try:
        found = analytics._louvain(a, b, np.ones(len(a)), n, 1.0, 1e-12)
        assert len(found) == n and tracemalloc.get_traced_memory()[1] < 250 * n
    finally:
        tracemalloc.stop()
