"""Registered queries over what the engine stores for itself: the text index and the links kept up, with their SQL.

Each builds its store from the given tables in the shared folder, changes it, and answers from the stored form.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import assembly, checks, rules, spans
from loomgraph.operators.index import TextIndex
from loomgraph.operators.nearest import nearest
from loomgraph.operators.upkeep import Links, changed_files, decision
from loomgraph.plans import tables as P
from loomgraph.plans.io import shared_dir, written
from loomgraph.sources import documents, includes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
WORDS = ["thing", "erhe", "onth", "attion", "of"]
IN_WORDS = ", ".join(f"'{w}'" for w in WORDS)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


def fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"


def searched_sql(documents: str) -> str:
    """BM25 of ``WORDS`` over the documents of a SELECT (doc_id, text), as (doc_id, score, matched) in ``scored``."""
    return f"""docs AS ({documents}), toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS a FROM docs),
postings AS (SELECT token, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(a) AS len, unnest(a) AS token FROM toks) WHERE token IN ({IN_WORDS}) GROUP BY token, doc_id, len),
stats AS (SELECT sum(len(list_distinct(a))) AS n, avg(len(a)) AS avg_len FROM toks),
idf AS (SELECT token, greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) AS idf FROM (SELECT token, count(*) AS df FROM postings GROUP BY token), stats),
scored AS (SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score, count(*) AS matched FROM postings JOIN idf USING (token), stats GROUP BY doc_id)"""


def _scores(index: TextIndex) -> DataFrame:
    return index.bm25(WORDS).select("doc_id", F.round("score", 6).alias("score"), "matched")


@query(f"WITH {searched_sql('SELECT doc_id, text FROM documents')} SELECT doc_id, score, matched FROM scored")
def index_search(spark, d):
    """Every match of the words, from an index of all documents."""
    index = TextIndex(spark, fresh(spark, "index"))
    index.append(P.read(spark, d, "documents").select("doc_id", "text"))
    return _scores(index)


#: Documents of the second append come later, those of the source are deleted, those in the language are rewritten.
_FINAL = "SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' thing of onth' ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src1'"
_AFTER = f"{searched_sql(_FINAL)}, n AS (SELECT count(*) AS docs, sum(len(a))::BIGINT AS tokens, sum(len(list_distinct(a)))::BIGINT AS postings FROM toks)"


@query(f"WITH {_AFTER} SELECT state, doc_id, score, matched, docs, tokens, postings FROM scored, n, (SELECT unnest(['changed', 'compacted']) AS state)")
def index_changes(spark, d):
    """The same words after an append, a rewriting append and a deletion, before and after the index is compacted."""
    docs = P.read(spark, d, "documents")
    index = TextIndex(spark, fresh(spark, "index"))
    early = F.coalesce(c("lang"), F.lit("")) == "en"
    index.append(docs.where(early).select("doc_id", "text"))
    index.append(docs.where(~early).select("doc_id", "text"))
    index.append(docs.where("lang = 'fr'").select("doc_id", F.concat("text", F.lit(" thing of onth")).alias("text")))
    index.delete(docs.where("source = 'src1'").select("doc_id"))
    out = None
    for state in ("changed", "compacted"):
        if state == "compacted":
            index.compact()
        totals = [F.lit(index.totals[k]).cast("long").alias(k) for k in ("docs", "tokens", "postings")]
        rows = written(_scores(index).select(F.lit(state).alias("state"), "doc_id", "score", "matched", *totals), "searched")
        out = rows if out is None else out.unionByName(rows)
    return out


def _titles(pages: DataFrame) -> DataFrame:
    """(file, name, anchor): a page defines the words of its title."""
    words = P.plain_tokens(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return pages.select(P.anchor("page", c("page_id")).alias("file"), F.explode(F.array_distinct(words)).alias("name")).withColumn("anchor", c("file"))


def _hrefs(pages: DataFrame) -> DataFrame:
    """(file, name, src): a page refers to the words of its links."""
    said = F.array_distinct(P.plain_tokens(F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), " ")))
    return pages.select(P.anchor("page", c("page_id")).alias("file"), F.explode(said).alias("name")).withColumn("src", c("file"))


_PAGE_WORDS = """defs AS (SELECT 'page/' || page_id AS anchor, unnest(list_distinct(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z0-9]+'))) AS name FROM pages),
refs AS (SELECT 'page/' || page_id AS src, unnest(list_distinct(regexp_extract_all(lower(array_to_string(regexp_extract_all(html, 'href="([^"]+)"', 1), ' ')), '[a-z0-9]+'))) AS name FROM pages),
one AS (SELECT name, min(anchor) AS dst FROM defs GROUP BY name HAVING count(DISTINCT anchor) = 1)"""


@query(f"WITH {_PAGE_WORDS} SELECT DISTINCT src, dst FROM refs JOIN one USING (name) WHERE src <> dst")
def links_kept_up(spark, d):
    """Links of pages by the words of their titles, built of an earlier state and brought up to date: before, pages of
    one site had their titles from their addresses, and a page that is gone defined a word of each benchmark item."""
    pages = P.read(spark, d, "pages").select("page_id", "url", "html")
    edited = c("url").contains("/en/")
    before = _titles(pages.where(~F.coalesce(edited, F.lit(False)))).unionByName(
        pages.where(edited).select(P.anchor("page", c("page_id")).alias("file"), F.explode(F.array_distinct(P.plain_tokens("url"))).alias("name")).withColumn("anchor", c("file")))
    gone = P.read(spark, d, "benchmark").select(F.lit("page/gone").alias("file"), F.get(P.plain_tokens(c("text")), F.lit(3)).alias("name"), F.lit("page/gone").alias("anchor"))
    links = Links(spark, fresh(spark, "links"), buckets=16)
    every = pages.select(P.anchor("page", c("page_id")).alias("file")).unionByName(gone.select("file").distinct())
    links.update(every, before.unionByName(gone), _hrefs(pages))
    now = pages.where(edited)
    changed = now.select(P.anchor("page", c("page_id")).alias("file")).unionByName(gone.select("file").distinct())
    links.update(changed, _titles(now), _hrefs(now))
    return links.links()


@query("""WITH s AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS h FROM documents WHERE lang IS DISTINCT FROM 'de'), n AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE coalesce(text, '') END) AS h FROM documents WHERE lang IS DISTINCT FROM 'es'),
j AS (SELECT CASE WHEN s.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN s.h IS DISTINCT FROM n.h THEN 'changed' END AS change FROM s FULL JOIN n USING (doc_id))
SELECT CASE WHEN k = 0 THEN 'fresh' WHEN k > 0.3 * f THEN 'rebuild' ELSE 'update' END AS decision, k AS changed FROM (SELECT count(change) AS k FROM j), (SELECT count(*) AS f FROM n)""")
def freshness_decision(spark, d):
    """What to do about a stored state of the documents: German ones have come since, Spanish ones gone, French ones changed."""
    docs = P.read(spark, d, "documents").select(P.anchor("doc", c("doc_id")).alias("file"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    lang = F.coalesce("lang", F.lit(""))
    stored = docs.where(lang != "de").select("file", F.sha2("text", 256).alias("hash"))
    now = docs.where(lang != "es").select("file", F.sha2(F.when(lang == "fr", F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("hash"))
    return decision(changed_files(stored, now), now.count())




@query("""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS anchor FROM documents), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
t AS (SELECT DISTINCT left(w, 2) || substr(w, 4) || left(w, 1) AS target FROM w WHERE length(w) >= 5)
SELECT target, arg_min(anchor, (dist, anchor)) AS anchor, min(dist)::INT AS distance FROM (SELECT target, anchor, levenshtein(target, anchor) AS dist FROM t, v WHERE abs(length(target) - length(anchor)) * 3 <= length(target)) WHERE dist * 3 <= length(target) GROUP BY target""")
def nearest_words(spark, d):
    """For words of the benchmark with a letter dropped and one added, the nearest word of all documents."""
    known = P.read(spark, d, "documents").select(F.explode(F.array_distinct(P.plain_tokens(c("text")))).alias("anchor"))
    w = P.read(spark, d, "benchmark").select(F.explode(P.plain_tokens(c("text"))).alias("w")).where(F.length("w") >= 5)
    return nearest(w.select(F.concat(F.left("w", F.lit(2)), F.substring("w", 4, 1 << 20), F.left("w", F.lit(1))).alias("target")), known)


@query("""SELECT 'doc/' || doc_id AS anchor, 'Note' AS node_type, lang, source, text IS NULL AS absent, length(text) AS chars, sha256(text) AS digest FROM documents""")
def documents_emitted(spark, d):
    """All documents written as markup files by the document sink and read back by the source."""
    documents.register(spark)
    docs = P.read(spark, d, "documents")
    attributes = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source"))
    path = fresh(spark, "emitted")
    docs.select(P.anchor("doc", c("doc_id")).alias("anchor"), F.lit("Note").alias("node_type"), "text", attributes.alias("attributes")).write.format("loom_documents").mode("overwrite").save(path)
    back = spark.read.format("loom_documents").schema("anchor string, node_type string, text string, attributes map<string,string>").load(path)
    return back.select("anchor", "node_type", c("attributes")["lang"].alias("lang"), c("attributes")["source"].alias("source"), c("text").isNull().alias("absent"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


@query("""WITH s AS (SELECT s_nationkey AS k, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS i FROM supplier),
l AS (SELECT r_regionkey AS r, 0 AS n, 0 AS i, 'heading' AS kind, '= ' || r_name AS text, 'docs/r' || r_regionkey || '.adoc' AS path FROM region
UNION ALL SELECT n_regionkey, 1 + n_nationkey, 0, 'heading', '== ' || n_name, 'docs/n/n' || n_nationkey || '.adoc' FROM nation
UNION ALL SELECT n_regionkey, 1 + n_nationkey, 1, 'line', 'full text of loom', 'docs/n/n' || n_nationkey || '.adoc' FROM nation
UNION ALL SELECT n_regionkey, 1 + n_nationkey, 2 + i, 'line', s_name, 'docs/n/s' || n_nationkey || '.adoc' FROM nation JOIN s ON k = n_nationkey WHERE i BETWEEN 2 AND 4
UNION ALL SELECT n_regionkey, 1 + n_nationkey, 9, 'missing', 'docs/n/s' || n_nationkey || '.adoc', 'docs/n/n' || n_nationkey || '.adoc' FROM nation WHERE n_nationkey NOT IN (SELECT k FROM s)
UNION ALL SELECT n_regionkey, 1 + n_nationkey, 10, 'cycle', 'docs/r' || n_regionkey || '.adoc', 'docs/n/n' || n_nationkey || '.adoc' FROM nation)
SELECT 'docs/r' || r || '.adoc' AS root, row_number() OVER (PARTITION BY r ORDER BY n, i) AS position, kind, text, path FROM l""")
def includes_spliced(spark, d):
    """A file a region that includes one a nation, each with some of its suppliers' file and, by mistake, its region's."""
    region, nation, supplier = (P.read(spark, d, t) for t in ("region", "nation", "supplier"))
    name = lambda kind, k: F.concat(F.lit(f"docs/{kind}"), c(k).cast("string"), F.lit(".adoc"))
    listed = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    of_region = F.array_join(F.transform("k", lambda k: F.concat(F.lit("include::n/n"), k.cast("string"), F.lit(".adoc[leveloffset=1]"))), "\n")
    files = region.join(listed, c("r_regionkey") == c("n_regionkey"), "left").select(name("r", "r_regionkey").alias("path"), F.concat(F.lit("= "), "r_name", F.lit("\n"), F.coalesce(of_region, F.lit("endif::[]"))).alias("text"))
    own = F.concat(F.lit("= "), c("n_name"), F.lit("\nifdef::absent[]\ninclude::nowhere.adoc[]\nendif::[]\nifeval::[{depth} > 1]\n{size} text of {engine}\nendif::[]\ninclude::s"), c("n_nationkey").cast("string"),
                   F.lit(".adoc[lines=2..4]\ninclude::../r"), c("n_regionkey").cast("string"), F.lit(".adoc[]"))
    suppliers = supplier.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "\n").alias("text"))
    files = files.unionByName(nation.select(name("n/n", "n_nationkey").alias("path"), own.alias("text"))).unionByName(suppliers.select(name("n/s", "s_nationkey").alias("path"), "text"))
    return includes.spliced(files, region.select(name("r", "r_regionkey").alias("path")), {"depth": "2", "size": "full", "engine": "loom"})


@query(f"""WITH {P.LINES_SQL}, hit AS (SELECT doc_id, line, text FROM lines WHERE contains(text, 'thing'))
SELECT doc_id, line, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY doc_id, line LIMIT 500""")
def grep_with_total(spark, d):
    """The first lines that hold a word, with the exact number of all that do, from one scan."""
    top, total = spans.counted_top(spans.matches(P.lines(spark, d), "thing").select("doc_id", "line"), [c("doc_id"), c("line")], 500)
    return top.withColumn("total", F.lit(total).cast("long"))


class RepeatedLine(checks.Check):
    """A text in which a line that isn't blank follows itself."""

    needs, partition_by, order_by = ("text",), ("doc_id",), ("line",)

    def __init__(self):
        self.last, self.found = None, None

    def row(self, row):
        if row.text.strip() and row.text == self.last:
            self.found = row.doc_id
        self.last = row.text

    def end(self):
        return [] if self.found is None else [("warning", f"doc/{self.found}")]


@query(f"""WITH {P.EDGES_SQL}, {P.NODES_SQL}, {P.LINES_SQL}, i AS (SELECT 'orphan' AS category, 'warning' AS severity, anchor FROM nodes WHERE anchor NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)
UNION ALL SELECT DISTINCT 'repeated_line', 'warning', 'doc/' || doc_id FROM (SELECT doc_id, text, lag(text) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM lines) WHERE text = before AND trim(text) <> '')
SELECT category, severity, anchor FROM i""")
def diagnose_custom(spark, d):
    """The graph's scans and a check of one's own over the lines of all documents."""
    checks.register_check(spark, "repeated_line", RepeatedLine)
    none = spark.createDataFrame([], "src string, target string")
    return rules.diagnose(P.nodes(spark, d), P.edges(spark, d), none, custom={"repeated_line": P.lines(spark, d)})


@query()
def relevant_selection(spark, d):
    """For each source its documents that match the words, chosen by marginal relevance; tested against plain greedy."""
    index = TextIndex(spark, fresh(spark, "index"))
    docs = P.read(spark, d, "documents").select("doc_id", "source", "text")
    index.append(docs)
    scored = index.bm25(WORDS).select("doc_id", F.round("score", 6).alias("score"))
    items = docs.join(scored, "doc_id").select(c("source").alias("request"), P.anchor("doc", c("doc_id")).alias("anchor"), c("score").alias("relevance"), T.estimate_tokens(c("text")).alias("tokens"), "text")
    return assembly.select_relevant(items, 4000).withColumn("score", F.round("score", 6))
