"""Evidence for questions of several parts, many questions in one plan: facets as rows, sources of distinct roles, and
packets that hold a line for every role or nothing.

What a choice can still need is kept, by exact bounds, and no more: a facet that meets files taken for two others needs
three files of each of three roles; a role that meets lines taken for the others needs as many lines as there are roles.
So the last step of a question is an expression over a short array, whatever the number of candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import answers
from loomgraph.operators.retrieval import B, K1
from loomgraph.plans.io import written
from loomgraph.plans.tables import plain_tokens

c = F.col
#: A question has this many facets at most, and as many sources.
FACETS = 3
#: Words that start a question.
INTERROGATIVES = ["how", "what", "which", "where", "who", "when", "why"]
#: What shows that a line of code takes part in guarding a boundary, the most telling first.
BOUNDARY_ROLES = [
    ("validation", ["confine", "validat", "permission", "authoriz", "workspace", "reject"]),
    ("environment", ["env_clear", "allowlist", "allowed_env", "environment", "inherit"]),
    ("cleanup", ["kill_on_drop", "timeout", "deadline", "terminate", "cancel", "cleanup"]),
    ("error handling", ["redact", "backtrace", "sanitiz", "sensitive", "disclosure", "leak"]),
]


def facets(question: Column, stop: list[str] = T.STOP_WORDS) -> Column:
    """The parts of a question, each an array of its distinct words in order of the alphabet: cut at commas and at
    " and ", if it has a comma or a question word after an "and". Words have three signs or more and are no stop words,
    parts with fewer than three words are left out; with fewer than two or more than ``FACETS`` left there are none
    (also for null)."""
    q = F.lower(F.coalesce(question, F.lit("")))
    several = q.contains(",") | q.rlike(f" and ({'|'.join(INTERROGATIVES)}) ")
    words = lambda part: F.filter(F.array_sort(F.array_distinct(plain_tokens(part))), lambda w: (F.length(w) >= 3) & ~w.isin(stop))
    parts = F.filter(F.transform(F.split(q, ",| and "), words), lambda x: F.size(x) >= 3)
    return F.when(several & F.size(parts).between(2, FACETS), parts).otherwise(F.array().cast("array<array<string>>"))


def facet_rows(questions: DataFrame, stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """(question, facet, token): one row a word of each facet, numbered from 0, of questions (question, text)."""
    each = questions.select("question", F.posexplode(facets(c("text"), stop)).alias("facet", "words"))
    return each.select("question", "facet", F.explode("words").alias("token"))


def facet_scores(words: DataFrame, postings: DataFrame, n: DataFrame, avg_len: DataFrame) -> DataFrame:
    """(question, facet, doc_id, score): the BM25 rankings of all facets at once. ``words`` as of ``facet_rows``;
    ``postings`` (token, doc_id, tf, len) of at least their words; ``n`` and ``avg_len`` of one row each, as in
    ``retrieval.bm25``."""
    hits = postings.join(words.select("token").distinct(), "token", "left_semi")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(0.0), F.log((c("n") - c("df") + 0.5) / (c("df") + 0.5) + 1.0))
    weighted = words.join(df, "token").crossJoin(n).select("question", "facet", "token", idf.alias("idf"))  # n: one row
    tf = c("tf").cast("double")
    norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * c("len") / c("avg_len")))
    parts = hits.crossJoin(F.broadcast(avg_len)).select("token", "doc_id", norm.alias("norm"))  # avg_len: one row
    return parts.join(weighted, "token").groupBy("question", "facet", "doc_id").agg(F.round(F.sum(c("idf") * c("norm")), 9).alias("score"))


def facet_sources(ranked: DataFrame, role_of: Callable[[Column], Column] = answers.role) -> DataFrame:
    """(question, place, facet, anchor, file, score): up to ``FACETS`` sources a question, one a facet, of distinct files.

    ``ranked``: (question, facet 0 to 2, anchor, file, score), any number of rows. In order of the facets each takes its
    best row (greatest score, then smallest anchor) whose file and whose file's role are not taken yet, or else whose
    file is not. Where two were taken a third is the best row of an unused file and role, of the last facet that has one.
    Rows with a null in any of these columns are never taken; repeated rows count once.
    """
    rows = ranked.select("question", "facet", "anchor", "file", "score").dropna().withColumn("role", F.coalesce(role_of(c("file")), F.lit("")))
    order = [c("score").desc(), c("anchor")]
    best = rows.groupBy("question", "facet", "role", "file").agg(F.min_by(F.struct("anchor", "score"), F.struct((-c("score")).alias("s"), "anchor")).alias("b"))
    best = best.select("question", "facet", "role", "file", "b.anchor", "b.score")
    # Two files and two roles can be taken already: three of each are enough.
    near = best.withColumn("k", F.row_number().over(W.partitionBy("question", "facet", "role").orderBy(*order, "file"))).where(c("k") <= FACETS)
    roles = near.where("k = 1").withColumn("r", F.row_number().over(W.partitionBy("question", "facet").orderBy(*order, "file"))).where(c("r") <= FACETS)
    kept = near.join(roles.select("question", "facet", "role"), ["question", "facet", "role"], "left_semi")
    row = F.struct("facet", (-c("score")).alias("s"), "anchor", "file", "role", "score")
    short = kept.groupBy("question").agg(F.array_sort(F.collect_list(row)).alias("all"))

    def free(taken: Column, x: Column, *of: str) -> Column:
        return ~F.exists(taken, lambda t: reduce(or_, (t[f] == x[f] for f in of)))

    def take(taken: Column, facet: Column) -> Column:
        mine = F.filter("all", lambda x: (x["facet"] == facet) & free(taken, x, "file"))
        return F.concat(taken, F.slice(F.concat(F.filter(mine, lambda x: free(taken, x, "role")), mine), 1, 1))
    out = short.withColumn("taken", F.aggregate(F.sequence(F.lit(0), F.lit(FACETS - 1)), F.slice("all", 1, 0), take))
    left = F.filter("all", lambda x: (F.size("taken") == FACETS - 1) & free(c("taken"), x, "file", "role"))
    last = F.array_sort(F.transform(left, lambda x: F.struct((-x["facet"]).alias("o"), x.alias("x"))))
    out = out.withColumn("taken", F.concat("taken", F.transform(F.slice(last, 1, 1), lambda x: x["x"])))
    each = out.select("question", F.posexplode("taken").alias("place", "t"))
    return each.select("question", "place", "t.facet", "t.anchor", "t.file", "t.score")


def call_neighbours(calls: DataFrame, requests: DataFrame, depth: int = 2, most: int = 64) -> DataFrame:
    """(request, anchor, distance): for each request (request, anchor) the nodes around its anchor, calls (src, dst)
    walked both ways, by distance and then anchor up to ``most`` nodes, the anchor itself included. That bound is what
    a neighbourhood is here. Calls of a node to itself lead nowhere; nulls are not walked.

    A request has ``most`` nodes already at most, so twice as many of a node's neighbours, the first by anchor, hold
    all that it can add: a hub's other neighbours are never joined to anything.
    """
    both = calls.select(c("src").alias("at"), c("dst").alias("to")).unionByName(calls.select(c("dst").alias("at"), c("src").alias("to")))
    first = both.where("at <> to").withColumn("k", F.dense_rank().over(W.partitionBy("at").orderBy("to"))).where(c("k") <= 2 * most)
    near = written(first.groupBy("at").agg(F.collect_set("to").alias("to")), "call-neighbours")
    asked = written(requests.dropna().select("request", "anchor").distinct(), "call-seen")
    out = asked.withColumn("distance", F.lit(0))
    # Only requests with room left go on: their nodes are an array of fewer than ``most``.
    own = asked.withColumn("k", F.row_number().over(W.partitionBy("request").orderBy("anchor"))).where(c("k") <= most)
    state = own.groupBy("request").agg(F.collect_list("anchor").alias("seen")).withColumn("front", c("seen"))
    for d in range(1, depth + 1):
        state = written(state.where((F.size("seen") < most) & (F.size("front") > 0)), "call-state")
        met = state.select("request", F.explode("front").alias("at")).join(near, "at").groupBy("request").agg(F.collect_list("to").alias("met"))
        new = F.array_sort(F.array_except(F.flatten("met"), c("seen")))
        state = state.join(met, "request").select("request", "seen", F.slice(new, F.lit(1), F.lit(most) - F.size("seen")).alias("front"))
        state = written(state.select("request", F.concat("seen", "front").alias("seen"), "front"), "call-state")
        out = out.unionByName(state.select("request", F.explode("front").alias("anchor"), F.lit(d).alias("distance")))
    return out


def role_lines(lines: DataFrame, roles: list[tuple[str, list[str]]] = BOUNDARY_ROLES, longest: int | None = 180) -> DataFrame:
    """(file, line, role, specificity, text) of lines (file, line, text) that hold a term of a role, one row a role,
    numbered from 0. The earlier a role's first term found stands in its list the more specific is the line (16 each),
    and 1 more a term found. Comments (// or #), blank and null lines and those over ``longest`` characters have none."""
    text = F.trim(c("text"))
    low = F.lower(text)
    ok = (text != "") & ~text.startswith("//") & ~text.startswith("#")
    if longest is not None:
        ok = ok & (F.length(text) <= longest)
    found = []
    for i, (_, terms) in enumerate(roles):
        places = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(k)) for k, t in enumerate(terms))))
        found.append(F.struct(F.lit(i).alias("role"), places.alias("places"), F.lit(len(terms)).alias("of")))
    each = lines.where(ok).select("file", "line", text.alias("text"), F.explode(F.filter(F.array(*found), lambda x: F.size(x["places"]) > 0)).alias("r"))
    specific = (c("r.of") - F.get("r.places", F.lit(0))) * 16 + F.size("r.places")
    return each.select("file", "line", "r.role", specific.alias("specificity"), "text")


def node_lines(spans: DataFrame, found: DataFrame, roles: int = len(BOUNDARY_ROLES)) -> DataFrame:
    """(anchor, role, specificity, file, line, size): of each node (``spans``, ``found`` as of ``evidence_packets``) its
    first lines of each role, as many as there are roles: the others can have taken as many but one."""
    met = found.join(spans, "file").where((c("line") >= c("first")) & (c("line") <= c("last"))).select("anchor", "role", "specificity", "file", "line", F.octet_length("text").alias("size"))
    own = W.partitionBy("anchor", "role").orderBy(c("specificity").desc(), "file", "line")
    return met.distinct().withColumn("k", F.row_number().over(own)).where(c("k") <= roles).drop("k")


def with_core(near: DataFrame, few: DataFrame, core: int = 2) -> DataFrame:
    """(request) whose own nodes (distance 0) have lines of at least ``core`` roles; ``few`` as of ``node_lines``."""
    own = near.where("distance = 0").select("request", "anchor").join(few.select("anchor", "role").distinct(), "anchor")
    return own.groupBy("request").agg(F.count_distinct("role").alias("n")).where(c("n") >= core).select("request")


def evidence_packets(near: DataFrame, spans: DataFrame, found: DataFrame, roles: int = len(BOUNDARY_ROLES), budget: int = 400, core: int = 2) -> DataFrame:
    """(request, role, anchor, file, line, specificity, distance, tokens): for each request a line of every role, each
    another line, or no row at all.

    ``near``: (request, anchor, distance); ``spans``: (anchor, file, first, last); ``found``: as of ``role_lines``. In
    order of the roles each takes its most specific line that is not taken yet, ties to the nearest, then by anchor,
    file and line. A request is left out if a role has no line, if its own node (distance 0) has lines of fewer than
    ``core`` roles, or if the lines together take over ``budget`` tokens (of four bytes, rounded up). A null in a key
    meets nothing; repeated rows count once.
    """
    return packets(near, node_lines(spans, found, roles), roles, budget, core)


def packets(near: DataFrame, few: DataFrame, roles: int = len(BOUNDARY_ROLES), budget: int = 400, core: int = 2) -> DataFrame:
    """``evidence_packets`` from the lines of nodes, as of ``node_lines``."""
    near = near.dropna()
    if core > 0:
        near = near.join(with_core(near, few, core), "request", "left_semi")
    key = F.struct((-c("specificity")).alias("s"), "distance", "anchor", "file", "line")
    # One shuffle: a line once a request and role, then the first lines of each.
    rows = near.join(few, "anchor").select("request", "role", "file", "line", key.alias("key"), "size").repartition("request", "role")
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("request", "role", "file", "line").orderBy("key", c("size").desc()))).where(c("k") == 1)
    short = best.withColumn("k", F.row_number().over(W.partitionBy("request", "role").orderBy("key"))).where(c("k") <= roles)
    short = short.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("role", "key", "size"))).alias("all"))

    def same(x: Column, t: Column) -> Column:
        return (x["key"]["file"] == t["key"]["file"]) & (x["key"]["line"] == t["key"]["line"])

    def take(taken: Column, role: Column) -> Column:
        return F.concat(taken, F.slice(F.filter("all", lambda x: (x["role"] == role) & ~F.exists(taken, lambda t: same(x, t))), 1, 1))
    out = short.withColumn("taken", F.aggregate(F.sequence(F.lit(0), F.lit(roles - 1)), F.slice("all", 1, 0), take))
    tokens = F.ceil(F.aggregate("taken", F.lit(0), lambda n, x: n + x["size"]) / 4).cast("int")
    whole = out.where(F.size("taken") == roles).withColumn("tokens", tokens).where(c("tokens") <= budget)
    each = whole.select("request", "tokens", F.explode("taken").alias("t"))
    return each.select("request", "t.role", "t.key.anchor", "t.key.file", "t.key.line", (-c("t.key.s")).alias("specificity"), "t.key.distance", "tokens")
