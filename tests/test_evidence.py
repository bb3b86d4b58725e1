"""Evidence for many questions at once, against plain loops over small sets."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evidence

RANKED = "question string, facet int, anchor string, file string, score double"
PACKET = ("request", "role", "anchor", "file", "line", "specificity", "distance", "tokens")


def test_facets_of_questions(spark):
    asked = [
        "Parser reads tokens quickly, store writes snapshot files",
        "How does parser read tokens and where does store write files",
        "parser reads tokens and store writes files",  # neither a comma nor a second question
        "one, two, three",  # parts too short
        "aaa bbb ccc, ddd eee fff, ggg hhh iii, jjj kkk lll",  # too many parts
        "aaa aaa bbb, ccc ddd eee, fff ggg hhh",  # a repeated word counts once
        "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string").select("i", evidence.facets(F.col("q")).alias("f")).orderBy("i").collect()
    assert [r.f for r in rows] == [
        [["parser", "quickly", "reads", "tokens"], ["files", "snapshot", "store", "writes"]],
        [["parser", "read", "tokens"], ["files", "store", "write"]],
        [], [], [], [["ccc", "ddd", "eee"], ["fff", "ggg", "hhh"]], [], [],
    ]


def plain_sources(rows):
    """The sources of one question: every facet looks at all of its rows."""
    rank = [sorted({r for r in rows if r[0] == f}, key=lambda r: (-r[3], r[1])) for f in range(evidence.FACETS)]
    role, taken = lambda r: r[2].split("/")[0], []
    free = lambda r: r[2] not in {t[2] for t in taken}
    other = lambda r: role(r) not in {role(t) for t in taken}
    for found in rank:
        pick = next((r for r in found if free(r) and other(r)), None) or next((r for r in found if free(r)), None)
        taken += [pick] if pick else []
    if len(taken) == 2:
        pick = next((r for found in reversed(rank) for r in found if free(r) and other(r)), None)
        taken += [pick] if pick else []
    return [(r[0], r[1]) for r in taken]


@pytest.mark.parametrize("roles, files, n", [(2, 2, 12), (4, 3, 40), (1, 4, 9), (6, 1, 30), (3, 1, 4)])
def test_sources_equal_a_look_at_all_rows(spark, roles, files, n):
    rng, rows = random.Random(roles * 100 + n), []
    for q in range(40):
        home = {f"a{i}": f"r{rng.randrange(roles)}/f{rng.randrange(files)}" for i in range(n)}
        for facet in range(rng.choice([2, 3])):
            rows += [(f"q{q}", facet, a, home[a], rng.choice([0.0, 0.5, 1.0, 2.5])) for a in rng.sample(sorted(home), rng.randint(0, n))]
    rows += rows[:20]
    nulls = [(None, 0, "a", "r/f", 9.0), ("q0", None, "a", "r/f", 9.0), ("q0", 0, None, "r/f", 9.0), ("q0", 0, "a", None, 9.0), ("q0", 0, "a", "r/f", None)]
    table = spark.createDataFrame(rows + nulls, RANKED).withColumn("role", F.lit("extra")).withColumn("place", F.lit(1))
    got = {}
    for r in evidence.facet_sources(table, lambda f: F.substring_index(f, "/", 1)).orderBy("question", "place").collect():
        got.setdefault(r.question, []).append((r.facet, r.anchor))
    want = {q: plain_sources([r[1:] for r in rows if r[0] == q]) for q in {r[0] for r in rows}}
    assert got == {q: w for q, w in want.items() if w}


def plain_neighbours(calls, start, depth, most):
    level, seen = [start], {start: 0}
    for d in range(1, depth + 1):
        met = {b for a, b in calls if a in level} | {a for a, b in calls if b in level}
        level = sorted(x for x in met if x is not None and x not in seen)[:most - len(seen)]
        seen |= dict.fromkeys(level, d)
    return seen


@pytest.mark.parametrize("most", [1, 4, 9, 64])
def test_neighbourhoods_equal_plain_walks(spark, most):
    rng = random.Random(most)
    calls = [(f"n{rng.randrange(40):02d}", f"n{min(rng.randrange(40), rng.randrange(40)):02d}") for _ in range(90)] + [("n00", f"n{i:02d}") for i in range(40)]
    starts = [f"n{i:02d}" for i in range(0, 40, 3)] + ["alone"]
    table = spark.createDataFrame(calls + calls[:5] + [(None, "n01"), ("n01", None)], "src string, dst string")
    asked = spark.createDataFrame([(s, s) for s in starts + starts[:2]] + [(None, "n01")], "request string, anchor string")
    got = {}
    for r in evidence.call_neighbours(table, asked, 2, most).collect():
        assert got.setdefault(r.request, {}).setdefault(r.anchor, r.distance) == r.distance
    assert got == {s: plain_neighbours(calls, s, 2, most) for s in starts}


def test_lines_of_roles(spark):
    lines = [("f", 1, "  if timeout > deadline: reject(x)"), ("f", 2, "// timeout"), ("f", 3, "# leak"), ("f", 4, " "), ("f", 5, None), ("f", 6, "LEAK " + "x" * 200), ("f", 7, "validate(confine)"), ("f", 8, "nothing")]
    table = spark.createDataFrame(lines, "file string, line int, text string")
    got = {(r.line, r.role): r.specificity for r in evidence.role_lines(table).collect()}
    assert got == {(1, 0): 17, (1, 2): 5 * 16 + 2, (7, 0): 6 * 16 + 2}
    assert (6, 3) in {(r.line, r.role) for r in evidence.role_lines(table, longest=None).collect()}


def plain_packet(near, spans, found, roles, budget, core):
    rows = [(-s, d, a, file, line, role, text) for a, d in near for b, file, first, last in spans if a == b for g, line, role, s, text in found if g == file and first <= line <= last]
    if len({r[5] for r in rows if r[1] == 0}) < core:
        return []
    taken = []
    for role in range(roles):
        pick = min((r for r in rows if r[5] == role and (r[3], r[4]) not in {(t[3], t[4]) for t in taken}), default=None)
        if pick is None:
            return []
        taken.append(pick)
    tokens = -(-sum(len(t[6].encode()) for t in taken) // 4)
    return [(t[5], t[2], t[3], t[4], -t[0], t[1], tokens) for t in taken] if tokens <= budget else []


@pytest.mark.parametrize("roles, budget, core", [(3, 1000, 2), (3, 6, 1), (2, 1000, 2), (4, 9, 0)])
def test_packets_equal_plain_choice(spark, roles, budget, core):
    rng = random.Random(roles * budget)
    found = sorted({(f"f{rng.randrange(3)}", rng.randrange(6), rng.randrange(roles)) for _ in range(40)})
    text = {(f, n): "é" * rng.randint(1, 6) for f, n, _ in found}
    found = [(f, n, r, rng.choice([17, 18, 33]), text[f, n]) for f, n, r in found]
    spans = sorted({(f"n{rng.randrange(8)}", f"f{rng.randrange(3)}", lo := rng.randrange(6), lo + rng.randrange(4)) for _ in range(16)})
    near = {f"q{i}": sorted({f"n{x}": rng.randrange(3) for x in rng.sample(range(8), rng.randint(1, 6))}.items()) for i in range(30)}
    n = spark.createDataFrame([(q, a, d) for q, rows in near.items() for a, d in rows] + [("q0", None, 0), (None, "n1", 0)], "request string, anchor string, distance int")
    s = spark.createDataFrame(spans + spans[:3] + [("n1", None, 1, 2), ("n1", "f1", None, 2)], "anchor string, file string, first int, last int")
    f = spark.createDataFrame(found + found[:4] + [(None, 1, 0, 99, "x")], "file string, line int, role int, specificity int, text string")
    got = {}
    for r in evidence.evidence_packets(n, s, f, roles, budget, core).select(*PACKET).orderBy("request", "role").collect():
        got.setdefault(r.request, []).append(tuple(r)[1:])
    want = {q: plain_packet(rows, spans, found, roles, budget, core) for q, rows in near.items()}
    assert got == {q: w for q, w in want.items() if w}
    assert got and len(got) < len(near)


def test_nothing_is_evidence_of_nothing(spark):
    none = lambda kinds: spark.createDataFrame([], kinds)
    assert evidence.facet_sources(none(RANKED)).count() == 0
    near = evidence.call_neighbours(none("src string, dst string"), none("request string, anchor string"))
    lines = evidence.role_lines(none("file string, line int, text string"))
    assert evidence.evidence_packets(near, none("anchor string, file string, first int, last int"), lines).count() == 0


def test_requests_without_a_core_are_not_walked_around(spark):
    """A request needs lines of two roles of its own; what is left of the requests gives the same packets."""
    found = spark.createDataFrame([("f", 1, 0, 16, "a"), ("f", 2, 1, 16, "b"), ("g", 1, 0, 32, "c"), ("g", 2, 0, 16, "d")], "file string, line int, role int, specificity int, text string")
    spans = spark.createDataFrame([("x", "f", 1, 9), ("y", "g", 1, 9)], "anchor string, file string, first int, last int")
    requests = spark.createDataFrame([("x", "x"), ("y", "y"), (None, "x"), ("z", "z")], "request string, anchor string")
    calls = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "y"), ("x", "x"), ("x", None)], "src string, dst string")
    few = evidence.node_lines(spans, found, 2)
    cored = evidence.with_core(requests.selectExpr("request", "anchor", "0 as distance"), few)
    assert [r.request for r in cored.where("request is not null").collect()] == ["x"]
    near = evidence.call_neighbours(calls, requests.join(cored, "request", "left_semi"))
    assert sorted(map(tuple, near.collect())) == [("x", "x", 0), ("x", "y", 1), ("x", "z", 2)]
    got = sorted(map(tuple, evidence.packets(near, few, 2).collect()))
    assert got == sorted(map(tuple, evidence.evidence_packets(evidence.call_neighbours(calls, requests), spans, found, 2).collect()))
    assert [x[:5] for x in got] == [("x", 0, "y", "g", 1), ("x", 1, "x", "f", 2)]
