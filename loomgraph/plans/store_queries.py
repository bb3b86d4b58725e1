"""Registered queries of the stored graph's updates and reads, of edge builders and of scalar forms, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import forms
from loomgraph.operators import rules, store
from loomgraph.plans import tables as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
E, N = P.EDGES_SQL, P.NODES_SQL


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


def one(spark: SparkSession, *anchors: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a in anchors], "anchor string")


# ---- updates and reads ---------------------------------------------------------------------------


@query(f"WITH {E} SELECT edge_type, count(*) AS n FROM edges WHERE NOT (edge_type = 'Contains' AND src = 'region/1') GROUP BY edge_type")
def store_delete_edge(spark, d):
    e = P.edges(spark, d)
    gone = e.where("edge_type = 'Contains' and src = 'region/1'")
    return store.delete_edges(e, gone).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E} SELECT edge_type, count(*) AS n FROM edges WHERE NOT (edge_type = 'Calls' AND src IN ('order/1', 'order/2', 'order/3')) GROUP BY edge_type")
def clear_generated_calls(spark, d):
    return store.clear_calls(P.edges(spark, d), one(spark, "order/1", "order/2", "order/3")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'doc/' || doc_id AS anchor, 1 AS first, len(string_split(text, chr(10)))::INT AS last FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def keyed_span_lookup(spark, d):
    spans = P.read(spark, d, "documents").select(P.anchor("doc", c("doc_id")).alias("anchor"), F.lit(1).alias("first"), F.size(F.split("text", "\n")).alias("last"))
    keys = P.read(spark, d, "labels").where("toxic = 1").select(P.anchor("doc", c("doc_id")).alias("anchor"))
    return store.spans_of(spans, keys)


@query("SELECT doc_id AS id, 'label' AS origin FROM labels WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def first_wins_dedupe(spark, d):
    label = P.read(spark, d, "labels").select(c("doc_id").alias("id"), F.lit("label").alias("origin"))
    return store.first_wins([label, P.read(spark, d, "documents").select(c("doc_id").alias("id"), F.lit("document").alias("origin"))], "id")


@query(f"WITH {P.LINES_SQL}, r AS (SELECT doc_id, line, text, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS bytes FROM lines WHERE line BETWEEN 1 AND 4) SELECT doc_id, line::INT AS line, text, bytes::BIGINT AS bytes FROM r WHERE bytes <= 400")
def direct_read(spark, d):
    return store.lines_between(P.lines(spark, d), 1, 4, 400)


@query("SELECT DISTINCT sha256('1' || text) AS key FROM documents WHERE sha256('1' || text) NOT IN (SELECT sha256('1' || text) FROM documents WHERE lang = 'en')")
def embed_missing(spark, d):
    key = F.sha2(F.concat(F.lit("1"), "text"), 256)
    docs = P.read(spark, d, "documents")
    return store.missing_embeddings(docs.select(key.alias("key")), docs.where("lang = 'en'").select(key.alias("key")))


@query("""WITH a AS (SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 0)
SELECT 'doc/' || coalesce(a.doc_id, b.doc_id) AS anchor, CASE WHEN b.doc_id IS NULL THEN 'drop' ELSE 'embed' END AS action FROM a FULL JOIN b USING (doc_id) WHERE a.lang IS DISTINCT FROM b.lang""")
def embed_incremental(spark, d):
    docs = P.read(spark, d, "documents").select("doc_id", P.anchor("doc", c("doc_id")).alias("anchor"), "lang")
    new = F.when(c("doc_id") % 3 == 0, "x").otherwise(c("lang"))
    return store.incremental_embeddings(docs.where("doc_id % 5 <> 0").select("anchor", c("lang").alias("key")), docs.where("doc_id % 7 <> 0").select("anchor", new.alias("key")))


@query(f"WITH {N}, p AS (SELECT anchor FROM nodes WHERE node_type = 'Module' ORDER BY anchor LIMIT 10 OFFSET 5) SELECT (SELECT count(*) FROM nodes WHERE node_type = 'Module') AS total, count(*) AS returned, 5::BIGINT AS \"offset\", (SELECT count(*) FROM nodes WHERE node_type = 'Module') > 5 + count(*) AS truncated, string_agg(anchor, ',' ORDER BY anchor) AS anchors FROM p")
def json_envelope(spark, d):
    page = store.page_of(P.nodes(spark, d).where("node_type = 'Module'").select("anchor"), ["anchor"], 5, 10)
    return page.select("total", "returned", "offset", "truncated", F.array_join(F.transform("rows", lambda r: r["anchor"]), ",").alias("anchors"))


@query(f"""WITH {E} SELECT dst AS anchor, '{{"anchor":"' || dst || '","depth":1,"node_type":"Function","via":["Calls"]}}' AS json FROM edges WHERE src = 'order/1' AND edge_type = 'Calls'""")
def node_json(spark, d):
    near = P.edges(spark, d).where("src = 'order/1' and edge_type = 'Calls'").select(c("dst").alias("anchor"), F.lit(1).alias("depth"), F.lit("Function").alias("node_type"), F.array("edge_type").alias("via"))
    return store.node_json(near)


@query("SELECT source, doc_id, of FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS of FROM documents) WHERE r <= 3")
def outline_cap(spark, d):
    docs = P.read(spark, d, "documents").select("source", "doc_id", "n_chars")
    return store.capped(docs, "source", [c("n_chars").desc(), "doc_id"], 3).select("source", "doc_id", "of")


@query(f"WITH {E} SELECT src, dst, edge_type FROM edges WHERE regexp_matches(src, '^(region|nation|supplier)/') AND regexp_matches(dst, '^(region|nation|supplier)/')")
def scope_subgraph(spark, d):
    inside = P.nodes(spark, d).where(c("anchor").rlike("^(region|nation|supplier)/"))
    return store.induced(P.edges(spark, d), inside)


@query("SELECT lang, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS scope FROM documents GROUP BY lang")
def scope_hash(spark, d):
    return P.read(spark, d, "documents").groupBy("lang").agg(forms.scope_hash(F.collect_set(c("doc_id").cast("string"))).alias("scope"))


# ---- edge builders -------------------------------------------------------------------------------

#: Documents play files: references name another document, anchors of decision records begin with adr-.
FILE_SQL = "CASE WHEN doc_id % 9 = 0 THEN 'adr-' ELSE 'doc-' END || doc_id"


def _file(n) -> F.Column:
    return F.concat(F.when(n % 9 == 0, "adr-").otherwise("doc-"), n.cast("string"))


def _refs(spark, d) -> DataFrame:
    docs = P.read(spark, d, "documents").select("doc_id")
    return docs.select("doc_id", _file(c("doc_id")).alias("src"), _file(c("doc_id") * 7 % 1000).alias("target"))


REFS_SQL = "refs AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'adr-' ELSE 'doc-' END || doc_id AS src, CASE WHEN (doc_id * 7 % 1000) % 9 = 0 THEN 'adr-' ELSE 'doc-' END || (doc_id * 7 % 1000) AS target FROM documents)"


def _files(spark, d) -> DataFrame:
    return P.read(spark, d, "documents").select(_file(c("doc_id")).alias("anchor"))


@query(f"""WITH {REFS_SQL}, k AS (SELECT src, target, src LIKE 'adr-%' OR target LIKE 'adr-%' AS rec FROM refs WHERE src <> target)
SELECT src, target AS dst, CASE WHEN rec THEN 'RelatesTo' ELSE 'Uses' END AS edge_type FROM k UNION SELECT target, src, CASE WHEN rec THEN 'RelatesTo' ELSE 'UsedBy' END FROM k""")
def build_from_refs(spark, d):
    return store.ref_edges(_refs(spark, d))


@query(f"WITH {REFS_SQL} SELECT DISTINCT src, target AS dst, 'DefinesTerm' AS edge_type FROM refs WHERE src <> target AND target IN (SELECT src FROM refs)")
def link_terms(spark, d):
    return store.exact_edges(_refs(spark, d), _files(spark, d), "DefinesTerm")


@query(f"WITH {REFS_SQL} SELECT DISTINCT target AS src, src AS dst, 'Documents' AS edge_type FROM refs WHERE src <> target AND target IN (SELECT src FROM refs)")
def link_doc_code(spark, d):
    return store.exact_edges(_refs(spark, d), _files(spark, d), "Documents", swap=True)


@query(f"WITH {REFS_SQL} SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN target ELSE src END AS src, CASE WHEN doc_id % 2 = 0 THEN src ELSE target END AS dst, 'Supersedes' AS edge_type FROM refs WHERE src <> target")
def link_supersedes(spark, d):
    return store.supersedes(_refs(spark, d).withColumn("direction", F.when(c("doc_id") % 2 == 0, "by").otherwise("of")))


@query("""WITH f AS (SELECT 'page/' || page_id AS anchor, regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM pages), u AS (SELECT stem, min(anchor) AS dst FROM f GROUP BY stem HAVING count(DISTINCT anchor) = 1)
SELECT DISTINCT 'doc/' || doc_id AS src, dst, 'Requires' AS edge_type FROM documents JOIN u ON stem = (doc_id % 300)::VARCHAR""".replace("\\\\", "\\"))
def link_includes(spark, d):
    files = P.read(spark, d, "pages").select(P.anchor("page", c("page_id")).alias("anchor"), F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    includes = P.read(spark, d, "documents").select(P.anchor("doc", c("doc_id")).alias("src"), F.concat(F.lit("lib/"), (c("doc_id") % 300).cast("string"), F.lit(".inc")).alias("path"))
    return store.include_edges(includes, files)


@query("""WITH p AS (SELECT 'part/' || p_partkey AS anchor, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] || (p_partkey % 1500) AS b FROM part), nm AS (SELECT a || '::' || b AS name, anchor FROM p UNION SELECT a, anchor FROM p UNION SELECT b, anchor FROM p),
u AS (SELECT name, min(anchor) AS anchor FROM nm GROUP BY name HAVING count(DISTINCT anchor) = 1), t AS (SELECT anchor AS src, unnest([a || '::' || b, a, b]) AS name, unnest([0, 1, 2]) AS tier FROM (SELECT 'claim/' || p_partkey AS anchor, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] || (p_partkey % 1500) AS b FROM part))
SELECT src, arg_min(u.anchor, tier) AS dst FROM t JOIN u USING (name) GROUP BY src""")
def link_implements(spark, d):
    words = F.split("p_name", " ")
    p = P.read(spark, d, "part").select("p_partkey", words[0].alias("a"), F.concat(F.element_at(words, -1), (c("p_partkey") % 1500).cast("string")).alias("b")).withColumn("full", F.concat_ws("::", "a", "b"))
    names = p.select(P.anchor("part", c("p_partkey")).alias("anchor"), F.explode(F.array("full", "a", "b")).alias("name")).distinct()
    return store.implements(p.select(P.anchor("claim", c("p_partkey")).alias("src"), c("full").alias("target")), names)


@query("""WITH h AS (SELECT source AS file, 'doc/' || doc_id AS anchor, (doc_id % 4)::INT AS level, doc_id AS line FROM documents), r AS (SELECT file, first(anchor ORDER BY level, line) AS rep FROM h GROUP BY file)
SELECT DISTINCT rep AS src, anchor AS dst, 'Contains' AS edge_type FROM h JOIN r USING (file) WHERE rep <> anchor""")
def doc_heading_containment(spark, d):
    h = P.read(spark, d, "documents").select(c("source").alias("file"), P.anchor("doc", c("doc_id")).alias("anchor"), (c("doc_id") % 4).cast("int").alias("level"), c("doc_id").alias("line"))
    return store.heading_containment(h)


@query(f"""WITH {REFS_SQL}, e AS (SELECT src, target FROM refs WHERE src <> target), b AS (SELECT src AS near, target AS towards FROM e UNION ALL SELECT target, src FROM e)
SELECT towards AS anchor, max((doc_id % 100)::DOUBLE) AS score FROM b JOIN refs r ON r.src = near WHERE r.doc_id % 4 = 1 AND towards LIKE 'adr-%' AND towards IN (SELECT src FROM refs) GROUP BY 1""")
def prose_to_code_bridge(spark, d):
    refs = _refs(spark, d)
    e = refs.where("src <> target").select("src", c("target").alias("dst"), F.lit("Documents").alias("edge_type"))
    hits = refs.where("doc_id % 4 = 1").select(c("src").alias("anchor"), (c("doc_id") % 100).cast("double").alias("score"))
    return store.bridge(hits, e, _files(spark, d).where("anchor like 'adr-%'"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), s AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part), pairs AS (SELECT a AS word, b AS synonym FROM s UNION SELECT b, a FROM s)
SELECT word, synonym FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY synonym) AS r FROM pairs WHERE word <> synonym AND synonym IN (SELECT word FROM w WHERE length(word) >= 4) AND word IN ('cold', 'widget', 'red', 'blue')) WHERE r <= 8""")
def lexicon_expand(spark, d):
    """Words of one part's name play synonyms; the corpus has those of four letters or more."""
    words = F.split("p_name", " ")
    part = P.read(spark, d, "part")
    pairs = part.select(words[0].alias("a"), F.get(words, F.lit(1)).alias("b")).where("b is not null").distinct()
    vocabulary = part.select(F.explode(words).alias("token")).where("length(token) >= 4")
    asked = spark.createDataFrame([("cold",), ("widget",), ("red",), ("blue",)], "word string")
    return store.expand(asked, pairs, vocabulary)


@query("SELECT 'm/' || p_partkey || '#' || replace(p_name, ' ', '::') AS anchor, 0 AS tier FROM part WHERE lower(string_split(p_name, ' ')[-1]) = 'widget'")
def exact_symbol_match(spark, d):
    names = P.read(spark, d, "part").select(F.concat(F.lit("m/"), c("p_partkey").cast("string"), F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("::"))).alias("anchor"))
    return store.symbol_matches(names, "Widget")


@query("SELECT 'm#' || replace(p_name, ' ', '_') || p_partkey AS anchor, 1 AS tier FROM part WHERE p_name LIKE 'cold %'")
def exact_or_extension(spark, d):
    names = P.read(spark, d, "part").select(F.concat(F.lit("m#"), F.replace("p_name", F.lit(" "), F.lit("_")), c("p_partkey").cast("string")).alias("anchor"))
    return store.symbol_matches(names, "cold")


@query("""SELECT 'user/' || user_id AS anchor, least(1.0, round(sum(CASE event_type WHEN 'error' THEN 0.3 WHEN 'view' THEN 0.05 WHEN 'click' THEN 0.1 ELSE 0 END), 6))::DOUBLE AS weight,
CASE WHEN round(sum(CASE event_type WHEN 'error' THEN 0.3 WHEN 'view' THEN 0.05 WHEN 'click' THEN 0.1 ELSE 0 END), 6) >= 0.5 THEN 'major' WHEN sum(CASE event_type WHEN 'error' THEN 0.3 WHEN 'view' THEN 0.05 WHEN 'click' THEN 0.1 ELSE 0 END) > 0 THEN 'minor' ELSE 'clean' END AS bucket FROM events GROUP BY user_id""")
def drift_buckets(spark, d):
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in {"error": "critical", "view": "low", "click": "medium"}.items() for x in kv)), c("event_type"))
    e = P.read(spark, d, "events").select(P.anchor("user", c("user_id")).alias("anchor"), F.coalesce(F.when(c("event_type").isin("error", "view", "click"), kind), F.lit("none")).alias("severity"))
    return store.drift_weight(e, rules.DRIFT_WEIGHT)


@query("SELECT CASE WHEN p_size % 7 = 0 THEN 'unknown' ELSE p_brand END AS licence, CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'allowed' ELSE 'denied' END AS verdict, count(DISTINCT p_name) AS packages FROM part GROUP BY 1, 2")
def licence_report(spark, d):
    p = P.read(spark, d, "part").select(c("p_name").alias("name"), F.when(c("p_size") % 7 == 0, " ").otherwise(c("p_brand")).alias("licence"))
    return store.licences(p, ["Brand#11", "Brand#12", "Brand#13"])


# ---- scalar forms --------------------------------------------------------------------------------


@query("""SELECT p_partkey, lower(string_split(p_name, ' ')[-1]) AS leaf, len(list_distinct([replace(p_name, ' ', '::'), string_split(p_name, ' ')[-1]] || [lower(replace(p_name, ' ', '::')), lower(string_split(p_name, ' ')[-1])] || list_transform(range(1, len(string_split(p_name, ' ')) + 1), lambda n: array_to_string(string_split(p_name, ' ')[1:n], '::'))))::INT AS forms FROM part""")
def natural_anchor_forms(spark, d):
    a = F.concat(F.lit("m/x#"), F.replace("p_name", F.lit(" "), F.lit("::")))
    return P.read(spark, d, "part").select("p_partkey", F.lower(forms.leaf(a)).alias("leaf"), F.size(forms.anchor_forms(a)).alias("forms"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS form FROM part")
def natural_symbol_form(spark, d):
    return P.read(spark, d, "part").select("p_partkey", forms.natural_form(F.concat("p_name", F.lit("<T, Vec<U, V<W>>>"))).alias("form"))


@query("SELECT p_partkey, round(1 - levenshtein(p_name, 'cold widget') / greatest(length(p_name), 11), 6) AS ratio FROM part")
def fuzzy_ratio(spark, d):
    return P.read(spark, d, "part").select("p_partkey", F.round(forms.fuzzy_ratio(c("p_name"), F.lit("cold widget")), 6).alias("ratio"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'cold')")
def token_boundary_match(spark, d):
    return P.read(spark, d, "part").where(forms.token_boundary(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), "cold")).select("p_partkey")


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 80), '[ \\t\\n\\r]+[^ \\t\\n\\r]*$', '') || ' …' END AS text FROM documents".replace("\\\\", "\\"))
def truncate_to_tokens(spark, d):
    return P.read(spark, d, "documents").select("doc_id", forms.truncate_to_tokens(c("text"), 20).alias("text"))


@query("SELECT doc_id, substr(text, greatest(1, strpos(lower(text), 'the') - 254), 512) AS preview FROM documents WHERE contains(lower(text), 'the')")
def match_preview(spark, d):
    return P.read(spark, d, "documents").select("doc_id", forms.preview(c("text"), "The", 512).alias("preview")).where("preview is not null")


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS hash FROM documents")
def hash_source(spark, d):
    return P.read(spark, d, "documents").select("doc_id", forms.source_hash(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("hash"))


@query("SELECT doc_id, 'v1:' || sha256('doc/' || doc_id || chr(10) || text) AS key FROM documents")
def embed_key(spark, d):
    text = F.concat(F.lit(":span: 1-2\n"), c("text"), F.lit("\n:confidence: 0.4"))
    return P.read(spark, d, "documents").select("doc_id", forms.embed_key(P.anchor("doc", c("doc_id")), text).alias("key"))


@query(f"WITH {E} SELECT edge_type, edge_type = 'PartOf' AS semantic, false AS inferred, count(*) AS n FROM edges GROUP BY 1")
def edge_flags(spark, d):
    e = P.edges(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select("edge_type", forms.is_semantic(c("edge_type")).alias("semantic"), forms.is_inferred(c("edge_type")).alias("inferred"), "n")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*/(en|fr)/') THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN contains(url, '?') THEN '[redacted]' ELSE '' END AS query FROM pages")
def sanitized_attributes(spark, d):
    url = c("url")
    path = F.regexp_extract(url, "^https?://[^/]*(/[^/]*/)", 1)
    shown = forms.redact(F.create_map(F.lit("query"), F.regexp_extract(url, r"\?.*$", 0)), ["query"])
    return P.read(spark, d, "pages").select("page_id", forms.self_reference(path, ["/en/", "/fr/"], F.lit(0.9)).alias("confidence"), F.when(F.contains(url, F.lit("?")), shown["query"]).otherwise("").alias("query"))


@query("SELECT event_id, strftime(make_timestamp(epoch(ts)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def rfc3339(spark, d):
    return P.read(spark, d, "events").select("event_id", forms.timestamp_text(F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000)).alias("at"))


@query("SELECT event_id, month(ts) <= 12 AND day(ts) <= 28 AS dated FROM events")
def date_stem(spark, d):
    """Names that are dates; from the 29th on the day is written as 3 and a digit beyond 1."""
    day = F.when(F.dayofmonth("ts") <= 28, F.date_format("ts", "dd")).otherwise(F.lit("39"))
    return P.read(spark, d, "events").select("event_id", forms.is_dated(F.concat(F.lit("log/"), F.date_format("ts", "yyyy-MM-"), day, F.lit(".md"))).alias("dated"))


@query(f"WITH {E}, g AS (SELECT count(*) / count(DISTINCT src)::DOUBLE AS k, edge_type FROM edges GROUP BY edge_type) SELECT edge_type, least(32000, round(8000 * (1 + greatest(0, least(3, k * 2)))))::BIGINT AS budget FROM g")
def auto_budget(spark, d):
    g = P.edges(spark, d).groupBy("edge_type").agg((F.count(F.lit(1)) / F.countDistinct("src")).alias("k"))
    return g.select("edge_type", forms.auto_budget(F.lit(8000), c("k")).alias("budget"))


@query(f"WITH {N}, a AS (SELECT CASE node_type WHEN 'Module' THEN 'mod-' WHEN 'Type' THEN 'adr-' WHEN 'Spec' THEN 'plan-' ELSE '' END || anchor AS anchor, node_type FROM nodes) SELECT anchor, CASE node_type WHEN 'Module' THEN 'module' WHEN 'Type' THEN 'adr' WHEN 'Spec' THEN 'plan' ELSE 'other' END AS doc_type, CASE node_type WHEN 'Module' THEN 'Module' WHEN 'Type' THEN 'Adr' WHEN 'Spec' THEN 'Plan' ELSE CASE WHEN anchor LIKE '%7' THEN 'Test' ELSE 'Note' END END AS node_type, anchor LIKE '%/5%' AS private FROM a")
def anchor_types(spark, d):
    """Anchors that end in 7 have a test's path; leaves that begin with 5 are private."""
    prefix = F.when(c("node_type") == "Module", "mod-").when(c("node_type") == "Type", "adr-").when(c("node_type") == "Spec", "plan-").otherwise("")
    a = P.nodes(spark, d).select(F.concat(prefix, "anchor").alias("anchor"))
    path = F.when(c("anchor").endswith("7"), F.concat(F.lit("tests/"), "anchor")).otherwise(c("anchor"))
    hidden = F.when(c("anchor").contains("/5"), F.concat(F.lit("x#_"), "anchor")).otherwise(c("anchor"))
    private = F.when(c("anchor").contains("/5"), forms.is_private(F.regexp_replace(hidden, "/", "-"))).otherwise(forms.is_private(c("anchor")))
    return a.select("anchor", forms.doc_type(c("anchor")).alias("doc_type"), store.node_type(c("anchor"), path).alias("node_type"), private.alias("private"))


@query("""SELECT p_partkey, array_to_string(string_split(p_name, ' ') || [CASE WHEN p_size % 2 = 0 THEN 'twelve' ELSE 'March' END] || [CASE WHEN p_size % 2 = 0 THEN '12' ELSE '03' END], ' ') AS forms FROM part""")
def semantic_normalize(spark, d):
    words = F.array_append(F.split("p_name", " "), F.when(c("p_size") % 2 == 0, "twelve").otherwise("March"))
    return P.read(spark, d, "part").select("p_partkey", F.array_join(forms.with_values(words), " ").alias("forms"))


@query("SELECT p_partkey, p_size % 3 = 0 AS code, p_size % 5 = 0 AS overview FROM part")
def question_kinds(spark, d):
    q = F.concat(F.lit("show "), "p_name", F.when(c("p_size") % 3 == 0, " loadPart").otherwise(""), F.when(c("p_size") % 5 == 0, " big picture").otherwise(""))
    return P.read(spark, d, "part").select("p_partkey", forms.looks_like_code(q).alias("code"), forms.is_overview(q).alias("overview"))
