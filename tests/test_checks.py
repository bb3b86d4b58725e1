"""Checks of a user's own as table functions; selection by marginal relevance against plain greedy."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import assembly, checks, rules


class Long(checks.Check):
    needs = ("anchor", "text")

    def row(self, row):
        if len(row.text or "") > 5:
            yield "error", row.anchor


class Rising(checks.Check):
    """A number below the one before it, and how many rows a group had."""

    needs, partition_by, order_by = ("v",), ("k",), ("at",)

    def __init__(self):
        self.last, self.n = None, 0

    def row(self, row):
        self.n += 1
        if self.last is not None and row.v < self.last:
            yield "warning", f"{row.k}@{row.at}"
        self.last = row.v

    def end(self):
        yield "info", f"{self.n} rows"


def test_a_check_in_sql_and_in_diagnosis(spark):
    checks.register_check(spark, "long", Long)
    table = spark.createDataFrame([("a", "short"), ("b", "longer text"), ("c", None)], "anchor string, text string")
    table.createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("SELECT * FROM check_long(TABLE(texts))").collect()] == [("long", "error", "b")]
    nodes, edges = table.select("anchor", F.lit("Type").alias("node_type")), spark.createDataFrame([("a", "b", "Calls")], "src string, dst string, edge_type string")
    issues = rules.diagnose(nodes, edges, spark.createDataFrame([], "src string, target string"), custom={"long": table})
    assert {tuple(r) for r in issues.collect()} == {("orphan", "warning", "c"), ("long", "error", "b")}


def test_a_check_sees_partitions_in_order(spark):
    checks.register_check(spark, "rising", Rising)
    rows = [(k, at, -at if k == "x" and at == 7 else at) for k in "xyz" for at in range(20)]
    random.Random(1).shuffle(rows)
    got = checks.run_check("rising", spark.createDataFrame(rows, "k string, at int, v int").repartition(5))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("info", "20 rows")] * 3 + [("warning", "x@7")]
    empty = spark.createDataFrame([], "k string, at int, v int")
    assert checks.run_check("rising", empty).count() == 0


def test_a_check_refuses_other_tables_and_the_later_one_wins(spark):
    checks.register_check(spark, "mine", Rising)
    with pytest.raises(Exception, match="needs the columns at, k, v"):
        checks.run_check("mine", spark.range(3)).collect()
    checks.register_check(spark, "mine", Long)
    assert checks.run_check("mine", spark.createDataFrame([("a", "longer text")], "anchor string, text string")).first().category == "mine"


def plain_greedy(rows, budget, trade):
    taken, used, left = [], 0, [r for r in rows if r[0] is not None]
    words = lambda t: {w for w in (t or "").lower().split() if len(w) > 1}
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 0.0
    while True:
        fits = [r for r in left if used + r[2] <= budget]
        if not fits:
            return [t[0] for t in taken]
        score = lambda r: trade * (r[1] or 0.0) - (1 - trade) * max((like(words(r[3]), words(t[3])) for t in taken), default=0.0)
        best = min(fits, key=lambda r: (-score(r), r[0]))
        taken.append(best)
        used += best[2]
        left.remove(best)


@pytest.mark.parametrize("trade, budget", [(0.7, 60), (0.3, 40), (1.0, 25), (0.5, 100_000)])
def test_selection_equals_plain_greedy(spark, trade, budget):
    rng, rows = random.Random(budget), []
    for request in ("p", "q", None):
        for i in range(60):
            text = None if i % 17 == 0 else " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=rng.randint(0, 4)))
            rows.append((request, None if i == 3 else f"n{i:02d}", None if i % 13 == 0 else round(rng.random(), 1), rng.randint(1, 12), text))
    table = spark.createDataFrame(rows, "request string, anchor string, relevance double, tokens int, text string")
    got = {}
    for r in assembly.select_relevant(table, budget, trade).orderBy("request", "place").collect():
        got.setdefault(r.request, []).append(r.anchor)
        assert r.running <= budget
    assert got == {k: plain_greedy([r[1:] for r in rows if r[0] == k], budget, trade) for k in ("p", "q", None)}


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([], "request string, anchor string, relevance double, tokens int, text string")
    assert assembly.select_relevant(empty, 10).count() == 0
