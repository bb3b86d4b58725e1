"""Operator semantics on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import analytics, assembly, linking, predicates, retrieval, rules, spans, traverse
from loomgraph.plans.queries import QUERIES
from loomgraph.sources import files


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", "Function"), ("b", "Function"), ("c", "Type"), ("m#d", "Note"), ("lone", "Function")], "anchor string, node_type string")
    edges = spark.createDataFrame([("a", "b", "Calls"), ("a", "b", "Uses"), ("b", "c", "Uses"), ("c", "a", "Requires"), ("b", "m#d", "Contains")], "src string, dst string, edge_type string")
    return nodes, edges


def start(spark, a):
    return spark.createDataFrame([(a,)], "anchor string")


def test_walks(spark, graph):
    _, e = graph
    got = {r.anchor: (r.depth, r.parent, r.via) for r in traverse.from_anchor(e, start(spark, "a"), 3).collect()}
    assert got["a"][0] == 0 and got["b"] == (1, "a", ["Calls", "Uses"]) and got["c"][:2] == (2, "b")
    back = {r.anchor for r in traverse.backlinks(e, start(spark, "m#d"), 3).collect()}
    assert back == {"m#d"}  # containment alone is not walked
    assert {r.anchor for r in traverse.dependents(e, start(spark, "c")).collect()} == {"a", "b"}
    assert traverse.impact(e, start(spark, "a"), 3, ["Requires"]).count() == 1


def test_predicates(spark, graph):
    n, e = graph
    ask = lambda q: sorted(r[0] for r in predicates.execute(q, n, e).collect())
    assert ask("incoming(b)") == ["a", "a"]
    assert ask("node(d)") == ["m#d"]
    assert ask("where callers=0 and type=function") == ["a", "lone"]
    assert ask("where nonsense=1") == [] and len(ask("where not nonsense=1")) == 5
    assert ask("where callers=x or calls>=1") == ["a"]
    with pytest.raises(predicates.QueryError):
        ask("node(nobody)")
    with pytest.raises(predicates.QueryError):
        ask("drop everything")


def test_rules_on_graph(spark, graph):
    n, e = graph
    assert [r.anchor for r in rules.orphans(n, e).collect()] == ["lone"]
    assert {r.anchor for r in rules.dead_code(n, e).collect()} == {"lone"}
    got = rules.diagnosis_score(rules.diagnose(n, e, spark.createDataFrame([("a", "gone")], "src string, target string"))).first()
    assert (got.errors, got.warnings, got.score) == (1, 1, 94.0)


def test_cycles_and_paths(spark, graph):
    _, e = graph
    ring = e.withColumn("edge_type", F.lit("Requires"))
    assert {r.anchor for r in analytics.cycles(ring).collect()} == {"a", "b", "c"}
    assert [r.path for r in analytics.cycle_paths(ring).collect()] == [["a", "b", "c"]]
    assert analytics.cycles(e).count() == 0
    two = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "c"), ("c", "d"), ("d", "c"), ("x", "x"), ("d", "z"), ("y", "a")]
    got = analytics.cycles(spark.createDataFrame([(*p, "Requires") for p in two], "src string, dst string, edge_type string"))
    assert {r.anchor for r in got.collect()} == {"a", "b", "c", "d", "x"}  # not m and n, which stand between cycles
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}", "Requires") for i in range(30)], "src string, dst string, edge_type string")
    assert analytics.cycles(chain).count() == 0


def test_pagerank_mass_and_seeds(spark, graph):
    n, e = graph
    r = {x.anchor: x.rank for x in analytics.pagerank(n, e).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9
    s = {x.anchor: x.rank for x in analytics.pagerank(n, e, spark.createDataFrame([("c", 2.0)], "anchor string, weight double")).collect()}
    assert abs(sum(s.values()) - 1) < 1e-9 and s["lone"] < 1e-9 < s["c"]
    zero = analytics.pagerank(n, e, spark.createDataFrame([("c", 0.0)], "anchor string, weight double"), iterations=2)
    assert abs(sum(x.rank for x in zero.collect()) - 1) < 1e-9


def test_louvain_two_cliques(spark):
    clique = lambda names: [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1:]]
    pairs = spark.createDataFrame(clique("abcd") + clique("wxyz") + [("d", "w", 1.0)], "a string, b string, w double")
    for standard in (True, False):
        got = {r.anchor: r.community for r in analytics.louvain(pairs, standard=standard).collect()}
        assert got == {**dict.fromkeys("abcd", 0), **dict.fromkeys("wxyz", 1)}
    assert len({r.community for r in analytics.label_propagation(pairs).collect()}) <= 2


def test_retrieval_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.score for r in retrieval.dense(v, spark.createDataFrame([([1.0, 0.0],)], "q array<float>")).collect()}
    assert got[1] == 1 and got[2] == 0 and got[3] == 0 and abs(got[4] - 0.5 ** 0.5) < 1e-7
    m = retrieval.eval_metrics(spark.createDataFrame([("q", 1, False), ("q", 2, True), ("p", 1, False)], "query string, rank int, relevant boolean")).first()
    assert m.recall_1 == 0 and m.recall_5 == 0.5 and m.mrr == 0.25


def test_spans(spark):
    s = spark.createDataFrame([("f", "outer", 1, 40), ("f", "inner", 10, 20), ("f", "one", 12, 12)], "doc_id string, anchor string, start_line int, end_line int")
    at = spark.createDataFrame([("f", 12), ("f", 11), ("f", 2), ("f", 99)], "doc_id string, line int")
    assert {r.line: r.anchor for r in spans.enclosing(at, s).collect()} == {12: "one", 11: "inner", 2: "outer", 99: None}
    assert {r.anchor: (r.depth, r.parent) for r in spans.nesting(s).collect()} == {"outer": (0, None), "inner": (1, "outer"), "one": (2, "inner")}
    diff = "--- a/x\n+++ b/x.rs\n@@ -1,2 +3,2 @@ fn\n+a\n+b\n@@ -9 +10,0 @@\n-c\n+++ b/y.rs\n@@ -0,0 +1 @@\n+z"
    got = spans.changed_lines(spark.createDataFrame([(1, diff)], "id int, text string"))
    assert sorted((r.file, r.line) for r in got.collect()) == [("x.rs", 3), ("x.rs", 4), ("x.rs", 10), ("y.rs", 1)]


def test_linking(spark):
    names = spark.createDataFrame([("run", "m/a#run", "a", "m"), ("run", "m/b#run", "b", "m"), ("go", "n/c#go", "c", "n")], "name string, anchor string, file string, module string")
    calls = spark.createDataFrame([("m/a#x", "a", "m", "run"), ("m/z#x", "z", "m", "run"), ("m/a#x", "a", "m", "go")], "caller string, file string, module string, name string")
    got = {(r.caller, r.name): r.anchor for r in linking.resolve_local(calls, names).collect()}
    assert got == {("m/a#x", "run"): "m/a#run", ("m/a#x", "go"): "n/c#go"}
    base = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "c"), ("t4", "d")], "tag string, content string")
    fresh = spark.createDataFrame([("t1", "a"), ("t2", "B"), ("t3", "C"), ("t5", "e")], "tag string, content string")
    work = spark.createDataFrame([("t3", "human")], "tag string, region string")
    assert {r.tag: r.action for r in linking.merge_proposal(base, work, fresh).collect()} == {"t2": "update", "t3": "conflict", "t4": "delete", "t5": "insert"}
    n = linking.name_index(spark.createDataFrame([("x/f.rs#A::b",)], "anchor string"))
    assert {r.name for r in n.collect()} == {"A::b", "b"}


def test_assembly_budget(spark):
    items = spark.createDataFrame([("q", "a", 1, 50, "xx yy zz"), ("q", "b", 2, 80, "other words here"), ("q", "c", 3, 30, "xx yy zz"), ("q", "d", 4, 20, "new text now")], "request string, anchor string, position int, tokens int, text string")
    pick = lambda **k: [r.anchor for r in assembly.assemble(items, 100, **k).orderBy("position").collect()]
    assert pick() == ["a"] and pick(skip=True) == ["a", "c", "d"] and pick(skip=True, similar=0.9) == ["a", "d"]
    q = spark.createDataFrame([("why does it crash",), ("what breaks downstream if I change x",), ("listen, whichever",)], "q string")
    assert [r[0] for r in q.select(assembly.classify_intent(F.col("q"))).collect()] == ["debug", "impact", "general"]


def test_stems():
    pairs = {"running": "run", "mapping": "map", "statuses": "status", "analyses": "analysi", "analysis": "analysi", "generously": "generous", "happiness": "happi", "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "hoping": "hope", "x1s": "x1s", "nationality": "nation", "skies": "sky"}
    assert {w: T.stem(w) for w in pairs} == pairs
    assert T.tokenize("The parse_File, running!") == ["parse_file", "pars", "file", "run"]
    assert T.subtokens("parseFile_name2Go") == ["parse", "File", "name2", "Go"]
    assert T.fnv1a64("") == 0xCBF29CE484222325


def test_text_columns(spark):
    df = spark.createDataFrame([("see <<a,the A>> and <<b>>", "at 5:30pm", "Café au lait\n\nsecond")], "x string, t string, p string")
    r = df.select(T.replace_xrefs(F.col("x")).alias("x"), T.clock(F.col("t")).alias("t"), T.estimate_tokens(F.col("p")).alias("n"), T.snippet(F.col("p"), ["second"]).alias("s")).first()
    assert (r.x, r.t, r.n, r.s) == ("see the A and b", "17:30", 6, "second")
    assert T.glob_to_regex("src/**/*.rs") == r"^src/(.*/)?[^/]*\.rs$"


def test_secrets_and_lines(spark):
    paths = spark.createDataFrame([("a/.ssh/x", "t"), ("b/c.rs", "AKIA" + "A" * 16), ("d/e.rs", "ok"), ("f.bin", "ok"), ("k/x.PEM", "")], "path string, text string")
    got = [r[0] for r in paths.select(rules.disposition(F.col("path"), F.col("text"))).collect()]
    assert got == ["secret", "secret", "indexed", "unsupported", "secret"]
    lines = spark.createDataFrame([("py", "subprocess.run(cmd, shell=True)"), ("py", "x = pickle.loads(b)"), ("ts", "eval (x)"), ("py", "eval (x)"), ("rs", "fine")], "lang string, text string")
    found = {(r.lang, r.rule) for r in rules.line_findings(lines, F.col("lang")).collect()}
    assert found == {("py", "cwe-78-shell"), ("py", "cwe-502-foreign-objects"), ("ts", "cwe-95-evaluated-text"), ("py", "cwe-95-evaluated-text")}


def test_policy_and_dependencies(spark):
    d = spark.createDataFrame([("write", 2, "allow"), ("write", 1, "forbid")], "kind string, precedence int, effect string")
    r = spark.createDataFrame([(1, "write"), (2, "read")], "request_id int, kind string")
    assert {x.request_id: x.effect for x in rules.policy_decision(r, d).collect()} == {1: "forbid", 2: "allow"}
    deps = spark.createDataFrame([("pypi", "Lib", "1.2.9"), ("pypi", "lib", "2.0"), ("cargo", "lib", "0.1"), ("pypi", "lib", "odd")], "ecosystem string, name string, version string")
    bad = spark.createDataFrame([("pypi", "lib", 1, 9)], "ecosystem string, name string, major int, minor int")
    assert [x.version for x in rules.vulnerable(deps, bad).collect()] == ["1.2.9"]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Title\n\nsee <<b>>\nedge::calls[x#y]\n")
    (tmp_path / "sub" / "skip.md").write_text("no")
    found = files.scan(spark, str(tmp_path), "*.md", ["skip.md"])
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.md"]
    m = {(r.kind, r.value) for r in files.markup(found).collect()}
    assert {("heading", "Title"), ("ref", "b"), ("edge", "edge::calls[x#y]")} <= m
    edge = files.edge_macros(files.markup(found).where("kind = 'edge'"), ["Calls", "Uses"]).first()
    assert (edge.dst, edge.edge_type) == ("x#y", "Calls")
    p = files.paragraphs(spark.createDataFrame([(1, "a\nb\n\n \nc"), (2, ""), (3, None)], "doc_id int, text string")).collect()
    assert [(r.doc_id, r.para, r.start_line, r.end_line, r.text) for r in p] == [(1, 1, 1, 2, "a\nb"), (1, 2, 5, 5, "c")]
    t = files.merge_triples(spark.createDataFrame([("a", "r", "b", "y"), ("a", "r", "b", "x")], "s string, p string, o string, source string")).first()
    assert t.sources == ["x", "y"]
    (tmp_path / "t.csv").write_text("h,i\n1,2\n")
    assert files.csv_table(spark, str(tmp_path / "t.csv")).columns == ["h", "i"]


def test_boosts_and_votes(spark):
    df = spark.createDataFrame([("Run", "x", "a b"), ("x", "run", "run"), ("x", "y", "How to run"), ("x", "y", "running")], "n string, s string, t string")
    got = [r[0] for r in df.select(retrieval.boost(F.col("n"), F.col("s"), F.col("t"), ["run"])).collect()]
    assert got == [30.0, 20.0, 10.0, 1.0]
    hits = spark.createDataFrame([(i, i <= 8) for i in range(1, 11)], "rank int, prose boolean")
    assert retrieval.vote(hits, F.col("prose")).first().verdict and not retrieval.vote(hits, ~F.col("prose")).first().verdict
    names = spark.createDataFrame([("walk",), ("wall",), ("run",)], "name string")
    assert {r.name: r.score for r in retrieval.fuzzy(names, "walk").collect()} == {"walk": 0.9, "wall": 0.45}


def test_documents_that_hold_nearly_all_words_of_a_question(spark):
    rng = random.Random(2)
    words = [chr(97 + i) for i in range(12)]
    docs = [(i, 9, rng.sample(words, rng.randint(0, 12))) for i in range(60)] + [(60, 9, None), (None, 9, ["a"])]
    asked = {i: rng.sample(words, rng.randint(1, 6)) for i in range(12)} | {12: ["none", "such"], 13: ["a", "none"]}
    q = spark.createDataFrame([(i, len(w), t) for i, w in asked.items() for t in w], "item_id int, n int, token string")
    for share in (0.5, 0.9, 1.0):
        want = {(i, d, len(set(w) & set(has or []))) for i, w in asked.items() for d, _, has in docs if d is not None and len(set(w) & set(has or [])) >= share * len(w)}
        got = retrieval.near_whole(spark.createDataFrame(docs, "doc_id int, len int, words array<string>"), q, share).collect()
        assert {(r.item_id, r.doc_id, r.m) for r in got if r.relevant} == want
        assert sorted(r.item_id for r in got if not r.relevant) == [i for i in asked if i != 12]


def test_nodes_of_the_highest_degree_with_the_edges_among_them(spark, graph):
    n, e = graph
    cap = lambda edges, most: sorted(tuple(r) for r in analytics.degree_cap(n, edges, most).collect())
    e = e.unionByName(spark.createDataFrame([("a", "a", "Calls"), ("c", "a", "Requires")], e.schema))
    rows = [("a", 6, "a", "Calls"), ("a", 6, "b", "Calls"), ("a", 6, "b", "Uses"), ("b", 4, "c", "Uses"), ("c", 3, "a", "Requires")]
    assert cap(e, 2) == [r for r in rows if r[2] != "c" and r[0] != "c"] + [("b", 4, None, None)]
    assert cap(e, 3) == rows
    assert ("lone", 0, None, None) in cap(e, 5) and ("b", 4, "m#d", "Contains") in cap(e, 5)


def test_capped_graph_has_its_edges(spark, sf):
    got = QUERIES["degree_cap"](spark, sf).toPandas()
    assert got.anchor.nunique() == 800 and got.dst.notna().any() and set(got.dst.dropna()) <= set(got.anchor)
