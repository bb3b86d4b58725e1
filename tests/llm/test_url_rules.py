"""Mined URL rules against a plain miner, and the tables that they must stand."""

import random
from collections import Counter
from itertools import combinations, product

import pytest

from loomgraph.llm import urlrules


def plain_rules(baskets, p):
    """Every set of up to ``max_tokens`` tokens with support and confidence, without those that a part does as well as."""
    every, bad = Counter(), Counter()
    for tokens, is_bad in baskets:
        for k in range(1, p.max_tokens + 1):
            for some in combinations(sorted(tokens), k):
                every[some] += 1
                bad[some] += is_bad
    least = max(p.min_support * len(baskets), p.min_rows)
    good = {s: bad[s] / every[s] for s in every if bad[s] >= least and bad[s] / every[s] >= p.min_confidence}
    parts = lambda s: (x for k in range(1, len(s)) for x in combinations(s, k))
    return {s: (bad[s] / len(baskets), conf) for s, conf in good.items() if not any(good.get(x, 0) >= conf for x in parts(s))}


@pytest.mark.parametrize("seed, p", [(1, urlrules.Mining(0.02, 3, 0.6)), (2, urlrules.Mining(0.05, 1, 0.75, 3)), (3, urlrules.Mining(0.0, 4, 0.5, 2)), (4, urlrules.Mining(0.9, 1, 0.5))])
def test_rules_equal_a_plain_miner(spark, seed, p):
    rng, baskets = random.Random(seed), []
    for _ in range(120):
        tokens = {t for t in "abcdefg" if rng.random() < 0.4}
        if "a" in tokens:  # always seen together
            tokens |= {"a2", "a3"}
        if "b" in tokens and rng.random() < 0.95:  # nearly always
            tokens.add("b2")
        baskets.append((sorted(tokens), rng.random() < (0.9 if {"c", "d"} <= tokens or "a" in tokens else 0.2)))
    table = spark.createDataFrame([*baskets, (["a"], None)], "tokens array<string>, bad boolean")
    got = {}
    for r in urlrules.mine_rules(table, p).collect():
        for tokens in product(*r.needs):
            assert tuple(sorted(tokens)) not in got
            got[tuple(sorted(tokens))] = (r.support, r.confidence)
    want = plain_rules(baskets, p)
    assert set(got) == set(want) and (want or seed == 4)
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_words_that_a_site_shares_are_one_item(spark):
    deep = "/".join(f"word{chr(97 + i)}" for i in range(24))
    rows = [(i, f"http://{'deep' if i % 5 else 'flat'}.site.biz/{deep if i % 5 else 'x'}/{i}", i % 5 > 0 and i % 7 > 0) for i in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, labels).collect()}
    assert got == {i: "block" if i % 5 else "allow" for i, _, _ in rows}


def test_a_rule_takes_any_of_its_like_tokens(spark):
    rules = spark.createDataFrame([(1, [["a", "a2"], ["b"]]), (2, [["c"]])], "rule_id long, needs array<array<string>>")
    pages = spark.createDataFrame([(1, ["a2", "b"]), (2, ["a", "a2"]), (3, ["b", "a", "c"]), (4, []), (None, ["c"]), (1, ["a2", "b"])], "page_id long, tokens array<string>")
    assert sorted(map(str, urlrules.match_rules(pages, rules).collect())) == sorted(["Row(page_id=1, tokens=['a2', 'b'])", "Row(page_id=3, tokens=['b', 'a', 'c'])", "Row(page_id=None, tokens=['c'])"])


def test_null_ids_other_columns_long_urls_and_repeats(spark):
    rows = [(i, f"http://h{i % 2}.biz/{'spam' if i % 2 else 'fine'}") for i in range(60)]
    odd = [(None, "http://h1.biz/spam"), (None, None), (7, "http://h0.biz/fine"), (99, "http://h1.biz/" + "x" * 200_000), rows[1]]
    pages = spark.createDataFrame([(*r, "h", ["t"], True) for r in rows + odd], "page_id long, url string, host string, tokens array<string>, bad boolean")
    labels = spark.createDataFrame([(i, i % 2 == 1, "x") for i in range(60)] + [(None, True, "x"), (3, None, "x"), (3, True, "x")], "page_id long, bad boolean, url string")
    got = [tuple(r) for r in urlrules.judge(pages, labels).collect()]
    assert len(got) == len(rows + odd)
    want = Counter((i, "block" if u and "h1" in u else "allow") for i, u in rows + odd)
    assert Counter((r[0], r[4]) for r in got) == want
    assert urlrules.judge(pages.limit(0), labels.limit(0)).count() == 0
