"""Nearest strings against all pairs; lines of code; assembly of whole sources."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import answers, assembly, nearest
from tests.test_growth import within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text) + 1)
        text = rng.choice([text[:i] + rng.choice("abcd") + text[i:], text[:i] + text[i + 1:], text[:i] + rng.choice("abcd") + text[i + 1:]])
    return text


@pytest.mark.parametrize("k", [1, 2, 4, 8])
def test_strings_within_some_edits_share_a_key(k):
    rng = random.Random(k)
    for _ in range(1500):
        known = "".join(rng.choices("abcd", k=rng.randint(2 * k, 40)))
        target = changed(rng, known, rng.randint(0, k))
        if 3 * distance(target, known) <= len(target) and distance(target, known) <= k:
            assert nearest.asked_keys(target, k) & nearest.held_keys(known, k)


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(8)
    known = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 30))) for _ in range(300)})
    targets = sorted({changed(rng, rng.choice(known), rng.randint(0, 9)) for _ in range(150)} | {"", "zzzzzz", known[0]})
    want = {}
    for t in targets:
        d, a = min((distance(t, x), x) for x in known)
        if 3 * d <= len(t):
            want[t] = (a, d)
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows] + [(None,), (rows[1],)], f"{name} string")
    got = nearest.nearest(frame(targets, "target"), frame(known, "anchor"))
    assert {r.target: (r.anchor, r.distance) for r in got.collect()} == want
    assert got.count() == len(want) and {d for _, d in want.values()} >= {0, 1, 2, 3, 4}


def test_nearest_below_common_beginnings(spark):
    """Strings that begin alike, nested and of any length, and rests so short that all their signs may change."""
    rng = random.Random(5)
    heads = ["", "ab", "abcdabcd", "abcdabcdddddaaaa", "bbbbbbbbbbbbbb", "abcc"]
    known = sorted({rng.choice(heads) + "".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(400)} - {""})
    starts = nearest.common_starts(spark.createDataFrame([(x,) for x in known], "anchor string"), 20)
    assert {"abcdabcd", "abcdabcdddddaaaa", "bbbbbbbbbbbbbb"} <= set(starts)
    targets = sorted({changed(rng, rng.choice(known), rng.randint(0, 8)) for _ in range(250)})
    for share in (3, 1):
        want = {}
        for t in targets:
            d, a = min((distance(t, x), x) for x in known)
            if share * d <= len(t) and d <= 16:
                want[t] = (a, d)
        got = nearest.nearest(spark.createDataFrame([(x,) for x in targets], "target string"), spark.createDataFrame([(x,) for x in known], "anchor string"), share, common=20)
        assert {r.target: (r.anchor, r.distance) for r in got.collect()} == want and max(d for _, d in want.values()) >= 4


def test_very_many_strings_that_begin_alike(spark):
    """40,000 known strings; met by their common segment they are 400 million pairs a level."""
    ids = spark.range(100_000, 140_000)
    known = ids.select(F.concat(F.lit("module-supplier"), "id").alias("anchor"))
    targets = ids.where("id % 2 = 0").select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("module-supplierx"), "id")).otherwise(F.concat(F.lit("module-the-supplier"), "id")).alias("target"))
    out = nearest.nearest(targets, known).where(F.substring("target", -6, 6) == F.substring("anchor", -6, 6))
    assert within(spark, 100, lambda: {tuple(r) for r in out.groupBy("distance").count().collect()}) == {(1, 10_000), (4, 10_000)}


def test_nearest_of_odd_tables(spark):
    none, one = spark.createDataFrame([], "target string"), spark.createDataFrame([("x" * 30_000,), ("abcdef",)], "target string")
    known = one.select(F.concat("target", F.lit("y")).alias("anchor"))
    assert nearest.nearest(none, known).count() == 0 == nearest.nearest(one, known.where("false")).count()
    assert sorted(r.distance for r in nearest.nearest(one, known).collect()) == [1, 1]


def test_stale_references_of_several_edits(spark):
    refs = spark.createDataFrame([("s", "mod-abcdefghijkl"), ("s", "mod-nothing"), ("s", "mod-here"), ("s", "other"), ("t", "plan-here")], "src string, target string")
    nodes = spark.createDataFrame([("mod-abcdefghijklxyz",), ("mod-here",), ("plan-abcdefghijkl",), ("plan-hero",)], "anchor string")
    got = {r.target: r.suggestion for r in answers.stale_refs(refs, nodes, ["mod-", "plan-"]).collect()}
    assert got == {"mod-abcdefghijkl": "mod-abcdefghijklxyz", "mod-nothing": None, "plan-here": "plan-hero"}


@pytest.mark.parametrize("line, code", [
    ("x = 'a#b'", "x = ''"), ("x = 'http://x' # c", "x = ''"), ('y = "it\'s" // "c"', 'y = ""'), ("it's // done", "it's"), ("it's // don't", "it''t"), (r"z = 'a\'#b' + 1", "z = '' + 1"),
    ("# 'all'", ""), ("", ""), (None, None), ("a / b  ", "a / b"), ('"" \'\' x', '"" \'\' x'), ("'open # c", "'open"),
])
def test_code_without_strings_and_comments(spark, line, code):
    assert spark.createDataFrame([(line,)], "line string").select(answers.code_only(F.col("line"))).first()[0] == code


def test_every_document_is_looked_at(spark):
    rows = [("s", f"a{i}", i, 1900 if i < 300 else 100, "t") for i in range(301)]
    got = assembly.assemble(spark.createDataFrame(rows, "request string, anchor string, position int, tokens int, text string"), 2000, skip=True)
    assert [r.anchor for r in got.orderBy("position").collect()] == ["a0", "a300"]
