"""Registered queries of evidence for many questions at once, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import evidence
from loomgraph.plans import tables as P
from loomgraph.plans.io import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
#: The roles of the invented prose: words of its languages stand for the terms of code.
ROLES = [("opening", ["attion", "onth"]), ("middle", ["thing", "erhe"]), ("ending", ["heit", "ung", "keit"]), ("aside", ["mente", "ado"])]
BUDGET = 500


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


_PLACES = f"""q AS (SELECT item_id || '/' || (pos - 1) AS question, lower(s) AS q FROM (SELECT item_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS s
  FROM (SELECT item_id, string_split_regex(coalesce(text, ''), '[.\\n]') AS l FROM benchmark))),
p AS (SELECT question, unnest(range(len(l))) AS pos, unnest(l) AS part FROM (SELECT question, string_split_regex(q, ',| and ') AS l FROM q
  WHERE contains(q, ',') OR regexp_matches(q, ' and ({'|'.join(evidence.INTERROGATIVES)}) '))),
w AS (SELECT DISTINCT question, pos, token FROM (SELECT question, pos, unnest(regexp_extract_all(part, '[a-z0-9]+')) AS token FROM p) WHERE length(token) >= 3 AND token NOT IN ({_STOP})),
f AS (SELECT question, pos, row_number() OVER (PARTITION BY question ORDER BY pos) - 1 AS facet, count(*) OVER (PARTITION BY question) AS n FROM w GROUP BY question, pos HAVING count(*) >= 3),
fw AS (SELECT question, facet, token FROM f JOIN w USING (question, pos) WHERE n BETWEEN 2 AND 3)"""

FACETS_SQL = f"""WITH {P.POSTINGS_SQL}, {_PLACES},
stats AS (SELECT sum(len(list_distinct(a))) AS n, avg(len(a)) AS avg_len FROM toks),
idf AS (SELECT token, greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) AS idf FROM (SELECT token, count(*) AS df FROM postings GROUP BY token), stats),
ranked AS (SELECT question, facet, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM fw JOIN postings USING (token) JOIN idf USING (token), stats GROUP BY question, facet, doc_id),
r AS (SELECT question, facet, 'doc/' || doc_id AS anchor, coalesce(lang, '') || '/' || coalesce(source, '') AS file, coalesce(lang, '') AS role, score FROM ranked JOIN documents USING (doc_id)),
t0 AS (SELECT r.*, 0 AS step FROM r WHERE facet = 0 QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, anchor) = 1),
t1 AS (SELECT r.*, 1 AS step FROM r LEFT JOIN t0 USING (question) WHERE r.facet = 1 AND r.file IS DISTINCT FROM t0.file
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY (r.role IS NOT DISTINCT FROM t0.role)::INT, r.score DESC, r.anchor) = 1),
u1 AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1),
used1 AS (SELECT question, list(file) AS files, list(role) AS roles FROM u1 GROUP BY question),
t2 AS (SELECT r.*, 2 AS step FROM r LEFT JOIN used1 USING (question) WHERE facet = 2 AND NOT coalesce(list_contains(files, file), false)
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY coalesce(list_contains(roles, role), false)::INT, score DESC, anchor) = 1),
u2 AS (SELECT * FROM u1 UNION ALL SELECT * FROM t2),
used2 AS (SELECT question, list(file) AS files, list(role) AS roles FROM u2 GROUP BY question HAVING count(*) = 2),
t3 AS (SELECT r.*, 3 AS step FROM r JOIN used2 USING (question) WHERE NOT list_contains(files, file) AND NOT list_contains(roles, role)
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY facet DESC, score DESC, anchor) = 1)
SELECT question, (row_number() OVER (PARTITION BY question ORDER BY step) - 1)::INT AS place, facet::INT AS facet, anchor, file, round(score, 6) AS score FROM (SELECT * FROM u2 UNION ALL SELECT * FROM t3)"""


@query(FACETS_SQL)
def facet_sources(spark, d):
    """Every sentence of the benchmark is a question; those of several parts get a document a part, from different
    languages where there are such, of all documents."""
    items = P.read(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.\n]")).alias("pos", "text"))
    questions = items.select(F.concat_ws("/", c("item_id").cast("string"), c("pos").cast("string")).alias("question"), "text")
    words = written(evidence.facet_rows(questions), "facet-words")
    docs = P.read(spark, d, "documents").select("doc_id", "lang", "source", P.plain_tokens(c("text")).alias("a"))
    own = docs.select("doc_id", F.size("a").alias("len"), F.size(F.array_distinct("a")).alias("uniq"))
    stats = written(own.agg(F.sum("uniq").alias("n"), F.avg("len").alias("avg_len")), "facet-stats")
    each = docs.select("doc_id", F.size("a").alias("len"), F.explode("a").alias("token")).join(words.select("token").distinct(), "token", "left_semi")
    postings = written(each.groupBy("token", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf")), "facet-postings")
    scores = evidence.facet_scores(words, postings, stats.select("n"), stats.select("avg_len"))
    file = F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    ranked = scores.join(P.read(spark, d, "documents").select("doc_id", file.alias("file")), "doc_id").withColumn("anchor", P.anchor("doc", c("doc_id")))
    out = evidence.facet_sources(ranked, lambda f: F.regexp_extract(f, "^[^/]*", 0))
    return out.withColumn("score", F.round("score", 6))


def _found_sql() -> str:
    """Lines with a role, a SELECT a role: its first term's place and how many there are."""
    out = []
    for i, (_, terms) in enumerate(ROLES):
        place = "CASE " + " ".join(f"WHEN contains(low, '{t}') THEN {k}" for k, t in enumerate(terms)) + " END"
        many = " + ".join(f"contains(low, '{t}')::INT" for t in terms)
        out.append(f"SELECT doc_id, line, {i} AS role, ({len(terms)} - {place}) * 16 + {many} AS specificity, text FROM ok WHERE {many} > 0")
    return " UNION ALL ".join(out)


def _chosen_sql() -> str:
    """A line a role, in order, none twice."""
    out = []
    for i in range(len(ROLES)):
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM p{j} WHERE p{j}.request = cand.request AND p{j}.file = cand.file AND p{j}.line = cand.line)" for j in range(i))
        out.append(f"p{i} AS (SELECT * FROM cand WHERE role = {i}{free} QUALIFY row_number() OVER (PARTITION BY request ORDER BY specificity DESC, distance, anchor, file, line) = 1)")
    return ", ".join(out)


PACKETS_SQL = f"""WITH {P.LINES_SQL}, calls AS (SELECT DISTINCT 'order/' || l_orderkey AS a, 'part/' || l_partkey AS b FROM lineitem),
adj AS (SELECT a AS node, b AS dst FROM calls UNION SELECT b, a FROM calls),
l0 AS (SELECT 'part/' || p_partkey AS request FROM part),
l1 AS (SELECT request, dst AS anchor, row_number() OVER (PARTITION BY request ORDER BY dst) AS k FROM l0 JOIN adj ON node = request QUALIFY k <= 63),
n1 AS (SELECT request, count(*) AS n FROM l1 GROUP BY request),
m2 AS (SELECT DISTINCT l1.request, dst AS anchor FROM l1 JOIN adj ON node = l1.anchor WHERE dst <> l1.request),
l2 AS (SELECT m2.request, m2.anchor, row_number() OVER (PARTITION BY m2.request ORDER BY m2.anchor) AS k, n FROM m2 JOIN n1 USING (request) WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.request = m2.request AND l1.anchor = m2.anchor) QUALIFY k + n <= 63),
near AS (SELECT request, request AS anchor, 0 AS distance FROM l0 UNION ALL SELECT request, anchor, 1 FROM l1 UNION ALL SELECT request, anchor, 2 FROM l2),
ok AS (SELECT doc_id, line, trim(text) AS text, lower(trim(text)) AS low FROM lines WHERE trim(text) <> '' AND NOT starts_with(trim(text), '//') AND NOT starts_with(trim(text), '#')),
found AS ({_found_sql()}),
owned AS (SELECT 'part/' || doc_id AS anchor, 'doc/' || doc_id AS file, line, role, specificity, text FROM found UNION ALL SELECT 'order/' || doc_id, 'doc/' || doc_id, line, role, specificity, text FROM found),
cand AS (SELECT request, distance, owned.* FROM near JOIN owned USING (anchor)), {_chosen_sql()},
chosen AS ({' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(len(ROLES)))}),
good AS (SELECT request, ceil(sum(octet_length(encode(text))) / 4)::INT AS tokens FROM chosen GROUP BY request HAVING count(*) = {len(ROLES)} AND tokens <= {BUDGET}),
core AS (SELECT request FROM cand WHERE distance = 0 GROUP BY request HAVING count(DISTINCT role) >= 2)
SELECT request, role, anchor, file, line, specificity, distance, tokens FROM chosen JOIN good USING (request) WHERE request IN (SELECT request FROM core)"""


@query(PACKETS_SQL)
def evidence_packets(spark, d):
    """For each part a line of every role from the texts of the orders and parts around it, or nothing. An order or a
    part has the text of the document with its number."""
    requests = P.read(spark, d, "part").select(P.anchor("part", c("p_partkey")).alias("request"))
    calls = P.edges(spark, d).where("edge_type = 'Calls'")
    docs = P.read(spark, d, "documents").select("doc_id", P.anchor("doc", c("doc_id")).alias("file"), F.lit(1).alias("first"), F.size(F.split("text", "\n")).alias("last")).where("doc_id is not null")
    spans = docs.select(F.explode(F.array(P.anchor("part", c("doc_id")), P.anchor("order", c("doc_id")))).alias("anchor"), "file", "first", "last")
    lines = P.lines(spark, d).select(P.anchor("doc", c("doc_id")).alias("file"), "line", "text")
    few = written(evidence.node_lines(spans, evidence.role_lines(lines, ROLES, None), len(ROLES)), "node-lines")
    # Requests that lack a core get no packet: nothing is sought around them.
    requests = requests.withColumn("anchor", c("request"))
    cored = evidence.with_core(requests.withColumn("distance", F.lit(0)), few)
    near = evidence.call_neighbours(calls, requests.join(cored, "request", "left_semi"))
    return evidence.packets(near, few, len(ROLES), BUDGET)
