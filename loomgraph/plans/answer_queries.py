"""Registered queries of ``operators.answers`` with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import answers as A
from loomgraph.plans import tables as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
E, N, L = P.EDGES_SQL, P.NODES_SQL, P.LINES_SQL


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


def one(spark: SparkSession, *anchors: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a in anchors], "anchor string")


def key(kind: str, column: str):
    return P.anchor(kind, c(column))


@query("SELECT DISTINCT 'order/' || o_orderkey AS src, 'customer/' || o_custkey AS dst, 'Uses' AS edge_type FROM orders")
def link_uses(spark, d):
    """An order's signature names its customer's type; the type Shared has many anchors and gives no edge."""
    orders = P.read(spark, d, "orders").select(key("order", "o_orderkey").alias("anchor"), F.format_string("fn f(a: Customer_%d, b: Shared)", "o_custkey").alias("signature"))
    kinds = P.read(spark, d, "customer").select(key("customer", "c_custkey").alias("anchor"), F.explode(F.array(F.format_string("Customer_%d", "c_custkey"), F.lit("Shared"))).alias("name"))
    return A.uses(orders, kinds)


@query("SELECT DISTINCT 'order/' || l_orderkey || '::set' || l_linenumber AS src, 'order/' || l_orderkey AS dst, 'Mutates' AS edge_type FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def link_mutates(spark, d):
    """Methods of returned lines take their order mutably."""
    own = F.when(c("l_returnflag") == "R", "&mut self").otherwise("&self")
    methods = P.read(spark, d, "lineitem").select(F.format_string("order/%d::set%d", "l_orderkey", "l_linenumber").alias("anchor"), F.concat(F.lit("fn set("), own, F.lit(", n: i64)")).alias("signature"))
    return A.mutates(methods, P.nodes(spark, d))


@query("WITH n AS (SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY 1 HAVING count(*) = 1), s AS (SELECT s_suppkey AS k, s_name AS name FROM supplier) SELECT DISTINCT 'item/' || s.k AS src, 'supplier/' || s.k AS dst, 'Demonstrates' AS edge_type FROM s UNION SELECT 'item/' || (k % 10), 'part/' || k, 'Demonstrates' FROM n")
def link_demonstrates(spark, d):
    """Listings name suppliers, each one anchor's, and parts, of whose names many have several."""
    s, p = P.read(spark, d, "supplier"), P.read(spark, d, "part")
    names = s.select(c("s_name").alias("name"), key("supplier", "s_suppkey").alias("anchor")).unionByName(p.select(c("p_name").alias("name"), key("part", "p_partkey").alias("anchor")))
    said = s.select(key("item", "s_suppkey").alias("src"), c("s_name").alias("token")).unionByName(p.select(F.concat(F.lit("item/"), c("p_partkey") % 10).alias("src"), c("p_name").alias("token")))
    return A.demonstrates(said, names)


@query("""WITH r AS (SELECT 'order/' || o_orderkey AS src, CASE WHEN o_orderkey % 2 = 0 THEN 'supplier/' || (o_orderkey % 150) ELSE 'supplier-' || lpad((o_orderkey % 150)::VARCHAR, 9, '0') END AS t FROM orders),
m AS (SELECT DISTINCT src, 'supplier/' || s_suppkey AS dst FROM r JOIN supplier ON t = 'supplier/' || s_suppkey OR t = lower(replace(s_name, '#', '-')))
SELECT src, dst, 'RelatesTo' AS edge_type FROM m UNION SELECT dst, src, 'RelatesTo' FROM m""")
def link_doc_refs(spark, d):
    n = c("o_orderkey") % 150
    target = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("supplier/"), n)).otherwise(F.concat(F.lit("supplier-"), F.lpad(n.cast("string"), 9, "0")))
    refs = P.read(spark, d, "orders").select(key("order", "o_orderkey").alias("src"), target.alias("target"))
    return A.doc_refs(refs, P.read(spark, d, "supplier").select(key("supplier", "s_suppkey").alias("anchor"), c("s_name").alias("title")))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('en', 'de') AND doc_id % 3 <> 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 1 GROUP BY source")
def block_filter(spark, d):
    """Blocks of a source: kinds are languages, every second has the tag shown, every third one hidden, and of
    those that hang on an attribute one's is not set."""
    tags = F.array_compact(F.array(F.when(c("doc_id") % 2 == 0, "shown"), F.when(c("doc_id") % 3 == 0, "hidden")))
    flag = F.when(c("doc_id") % 5 == 0, "draft").when(c("doc_id") % 5 == 1, "lost")
    docs = P.read(spark, d, "documents").select("source", "n_chars", F.array(F.struct(c("lang").alias("kind"), tags.alias("tags"), flag.alias("ifdef"))).alias("b"))
    kept = docs.where(F.size(A.blocks_shown(c("b"), ["en", "de"], ["shown"], ["hidden"], ["draft"])) > 0)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH s AS (SELECT 'customer' AS file, 'customer/' || c_custkey AS anchor FROM customer WHERE c_custkey = 1 UNION SELECT 'orders', 'order/' || o_orderkey FROM orders WHERE o_custkey = 1
UNION SELECT 'nation', 'nation/' || c_nationkey FROM customer WHERE c_custkey = 1 UNION SELECT 'customer', 'customer/' || c_custkey FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 1))
SELECT file, count(*) AS anchors FROM s GROUP BY file""")
def scope_assemble(spark, d):
    """Seed customer/1; its community are the customers of its nation, what depends on it its orders."""
    e = P.edges(spark, d).where("edge_type in ('Uses', 'PartOf') and (src like 'order/%' or src like 'customer/%')")
    people = P.read(spark, d, "customer")
    files = people.select(key("customer", "c_custkey").alias("anchor"), F.lit("customer").alias("file")).unionByName(P.read(spark, d, "orders").select(key("order", "o_orderkey").alias("anchor"), F.lit("orders").alias("file"))).unionByName(P.read(spark, d, "nation").select(key("nation", "n_nationkey").alias("anchor"), F.lit("nation").alias("file")))
    return A.scope(e, one(spark, "customer/1"), people.select(key("customer", "c_custkey").alias("anchor"), c("c_nationkey").alias("community")), files)


@query(f"""WITH {E}, l AS (SELECT 'part/' || p_partkey AS anchor, p_brand AS community FROM part), s AS (SELECT community, count(*) AS size FROM l GROUP BY 1 HAVING count(*) >= 3 ORDER BY size DESC, community LIMIT 12),
g AS (SELECT a AS anchor, count(*) AS n FROM (SELECT src AS a FROM edges WHERE edge_type = 'Calls' UNION ALL SELECT dst FROM edges WHERE edge_type = 'Calls') GROUP BY 1)
SELECT community, size, anchor, row_number() OVER (PARTITION BY community ORDER BY coalesce(n, 0) DESC, anchor)::INT AS rank FROM l JOIN s USING (community) LEFT JOIN g USING (anchor) QUALIFY rank <= 12""")
def communities_slice(spark, d):
    labels = P.read(spark, d, "part").select(key("part", "p_partkey").alias("anchor"), c("p_brand").alias("community"))
    return A.communities_slice(labels, P.edges(spark, d).where("edge_type = 'Calls'"))


@query("""WITH l AS (SELECT 'part/' || p_partkey AS anchor, p_brand, p_retailprice FROM part) SELECT a.anchor, b.anchor AS seed, row_number() OVER (PARTITION BY a.anchor ORDER BY b.p_retailprice DESC, b.anchor)::INT AS rank
FROM l a JOIN l b ON a.p_brand = b.p_brand AND a.anchor <> b.anchor WHERE a.anchor IN ('part/1', 'part/2', 'part/3') QUALIFY rank <= 3""")
def community_seeds(spark, d):
    part = P.read(spark, d, "part").select(key("part", "p_partkey").alias("anchor"), c("p_brand").alias("community"), c("p_retailprice").alias("score"))
    return A.community_seeds(part.select("anchor", "community"), one(spark, "part/1", "part/2", "part/3"), part.select("anchor", "score"))


@query("""WITH r AS (SELECT 'part/' || p_partkey AS anchor, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, p_size::DOUBLE AS rel FROM part), h AS (SELECT *, round(1.0 / rank + 2 * rel / (SELECT max(rel) FROM r WHERE rank <= 50), 9) AS s FROM r WHERE rank <= 50)
SELECT anchor, row_number() OVER (ORDER BY s DESC, rank)::INT AS rank FROM h UNION ALL SELECT anchor, rank::INT FROM r WHERE rank BETWEEN 51 AND 120""")
def ppmi_rerank_window(spark, d):
    from pyspark.sql import Window as W
    top = P.read(spark, d, "part").orderBy(c("p_retailprice").desc(), "p_partkey").limit(120)
    ranked = top.select(key("part", "p_partkey").alias("anchor"), F.row_number().over(W.orderBy(c("p_retailprice").desc(), "p_partkey")).alias("rank"), c("p_size").cast("double").alias("rel"))
    return A.rerank_window(ranked, 50)


@query(f"WITH {N} SELECT anchor, true AS truncated FROM nodes WHERE node_type = 'Type' ORDER BY anchor LIMIT 40")
def max_results_truncate(spark, d):
    return A.truncated(P.nodes(spark, d).where("node_type = 'Type'").select("anchor"), ["anchor"], 40)


@query("SELECT p_brand AS file, p_name AS content, min(p_partkey) AS place FROM part GROUP BY 1, 2")
def import_table_dedupe(spark, d):
    return A.tables_once(P.read(spark, d, "part").select(c("p_brand").alias("file"), c("p_name").alias("content"), c("p_partkey").alias("place")), "place")


@query(f"""WITH {L}, h AS (SELECT doc_id, line::INT AS line, text FROM lines WHERE text LIKE '%the%' ORDER BY doc_id, line LIMIT 512) SELECT doc_id, line, sum(strlen(text)) OVER (ORDER BY doc_id, line)::BIGINT AS bytes FROM h QUALIFY bytes <= 65536""")
def grep_limits(spark, d):
    return A.within_bytes(P.lines(spark, d).where(c("text").contains("the")), "text", ["doc_id", "line"]).select("doc_id", "line", "bytes")


@query("SELECT p_partkey, p_size % 3 <> 0 AS regex FROM part")
def requires_regex(spark, d):
    text = F.concat("p_name", F.when(c("p_size") % 3 == 0, "").when(c("p_size") % 3 == 1, r"\d").otherwise("|x"))
    return P.read(spark, d, "part").select("p_partkey", A.needs_regex(text).alias("regex"))


@query("""WITH r AS (SELECT s_suppkey AS src, CASE WHEN s_suppkey % 4 = 0 THEN 'adr-nothing-like-it-at-all' WHEN s_suppkey % 4 = 1 THEN 'adr-supplierx' || s_suppkey WHEN s_suppkey % 4 = 2 THEN 'adr-the-supplier' || s_suppkey ELSE 'adr-supplier' || s_suppkey END AS target FROM supplier), n AS (SELECT 'adr-supplier' || s_suppkey AS anchor FROM supplier),
m AS (SELECT DISTINCT target, anchor, levenshtein(target, anchor) AS dist FROM r, n WHERE target NOT IN (SELECT anchor FROM n) AND levenshtein(target, anchor) * 3 <= length(target))
SELECT src, target, suggestion FROM r LEFT JOIN (SELECT target, arg_min(anchor, (dist, anchor)) AS suggestion FROM m GROUP BY 1) USING (target) WHERE target NOT IN (SELECT anchor FROM n)""")
def scan_stale_refs(spark, d):
    """References to suppliers: misspelled by one letter, by four, like none, and right ones, by turns."""
    s = P.read(spark, d, "supplier")
    own = F.concat(F.lit("adr-supplier"), "s_suppkey")
    target = F.when(c("s_suppkey") % 4 == 0, "adr-nothing-like-it-at-all").when(c("s_suppkey") % 4 == 1, F.concat(F.lit("adr-supplierx"), "s_suppkey")).when(c("s_suppkey") % 4 == 2, F.concat(F.lit("adr-the-supplier"), "s_suppkey")).otherwise(own)
    return A.stale_refs(s.select(c("s_suppkey").alias("src"), target.alias("target")), s.select(own.alias("anchor")), ["adr-", "plan-"])


@query("SELECT 'doc/' || doc_id AS anchor, doc_id::VARCHAR AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def scan_missing_source(spark, d):
    docs = P.read(spark, d, "documents").select(key("doc", "doc_id").alias("anchor"), c("doc_id").cast("string").alias("file"), F.lit("h").alias("hash"))
    return A.missing_sources(docs, P.read(spark, d, "labels").select(c("doc_id").cast("string").alias("file")))


@query("SELECT 'part/' || p_partkey AS anchor, 'fn ' || p_name AS old, 'fn ' || p_name || ' x' AS new FROM part WHERE p_size % 7 = 0")
def drift_signature(spark, d):
    """Every seventh size has a new parameter; blanks alone are no change."""
    part = P.read(spark, d, "part")
    was = part.select(key("part", "p_partkey").alias("anchor"), F.concat(F.lit("fn "), "p_name").alias("signature"))
    now = part.select(key("part", "p_partkey").alias("anchor"), F.concat(F.lit("fn  "), "p_name", F.when(c("p_size") % 7 == 0, " x").otherwise(" ")).alias("signature"))
    return A.signature_drift(was, now)


@query("""WITH n AS (SELECT p_name AS name, min(p_size % 4) AS arity FROM part GROUP BY 1 HAVING count(*) = 1 UNION ALL SELECT s_name, s_suppkey % 4 FROM supplier), r AS (SELECT s_suppkey AS src, s_name AS name, s_suppkey % 3 AS said FROM supplier UNION ALL SELECT p_partkey, p_name, 2 FROM part)
SELECT DISTINCT src, name, said::INT AS said, arity::INT AS arity FROM r JOIN n USING (name) WHERE said <> arity""")
def documentation_arity(spark, d):
    s, p = P.read(spark, d, "supplier"), P.read(spark, d, "part")
    real = s.select(c("s_name").alias("name"), key("supplier", "s_suppkey").alias("anchor"), (c("s_suppkey") % 4).cast("int").alias("arity")).unionByName(p.select(c("p_name").alias("name"), key("part", "p_partkey").alias("anchor"), (c("p_size") % 4).alias("arity")))
    said = s.select(c("s_suppkey").alias("src"), c("s_name").alias("name"), (c("s_suppkey") % 3).cast("int").alias("said")).unionByName(p.select(c("p_partkey").alias("src"), c("p_name").alias("name"), F.lit(2).alias("said")))
    return A.arity_divergence(said, real)


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS a, (p_partkey // 4) % 4 AS b, p_partkey % 5 = 0 AS founder FROM part) SELECT p_partkey, CASE WHEN a < b THEN 'a' WHEN b < a THEN 'b' WHEN founder THEN 'a' ELSE 'b' END AS winner FROM p""")
def policy_resolve_conflict(spark, d):
    pick = lambda n: F.element_at(F.array(*map(F.lit, A.STRICTNESS)), (n + 1).cast("int"))
    author = F.when(c("p_partkey") % 5 == 0, "constitution").otherwise("someone")
    return P.read(spark, d, "part").select("p_partkey", A.stricter(pick(c("p_partkey") % 4), pick(F.floor(c("p_partkey") / 4) % 4), author).alias("winner"))


@query("SELECT 'part/' || p_partkey AS anchor FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def contract_constraints(spark, d):
    part = P.read(spark, d, "part").select(key("part", "p_partkey").alias("anchor"), F.when(c("p_size") % 2 == 0, " ").otherwise("x > 0").alias("pre"), F.when(c("p_partkey") % 3 == 0, "y").alias("post"), F.when(c("p_partkey") % 5 == 0, "z").otherwise("").alias("invariant"))
    return A.empty_contracts(part)


@query("""WITH o AS (SELECT 'nation/' || s_nationkey AS anchor, list(s_name ORDER BY s_suppkey) AS added FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT 'nation/' || n_nationkey AS anchor, array_to_string([n_name] || coalesce(added, []), ',') AS blocks FROM nation LEFT JOIN o ON o.anchor = 'nation/' || n_nationkey""")
def overlay_fold(spark, d):
    own = P.read(spark, d, "nation").select(key("nation", "n_nationkey").alias("anchor"), F.array("n_name").alias("blocks"))
    added = P.read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(key("nation", "s_nationkey").alias("anchor"), c("s_suppkey").alias("position"), c("s_name").alias("block"))
    return A.with_overlay(own, added).select("anchor", F.array_join("blocks", ",").alias("blocks"))


@query(f"""WITH {E}, g AS (SELECT dst AS anchor, count(*) AS n FROM edges WHERE edge_type = 'Calls' GROUP BY 1), b AS (SELECT p_brand, arg_min('part/' || p_partkey, (-n, 'part/' || p_partkey)) AS canonical FROM part JOIN g ON g.anchor = 'part/' || p_partkey GROUP BY 1) SELECT 'part/' || p_partkey AS anchor, canonical FROM part JOIN b USING (p_brand)""")
def canonical_anchor(spark, d):
    degree = P.edges(spark, d).where("edge_type = 'Calls'").groupBy(c("dst").alias("anchor")).agg(F.count(F.lit(1)).alias("n"))
    part = P.read(spark, d, "part").select(c("p_brand").alias("file"), key("part", "p_partkey").alias("anchor")).join(degree, "anchor", "left")
    return A.canonical(part.select("file", "anchor", F.coalesce("n", F.lit(0)).alias("indegree")))


@query("SELECT p_partkey, 'load' || p_size || ',' || 'Store::get_' || p_size AS symbols, 'part' AS area, 4 * CASE WHEN p_name LIKE '% %' THEN 1 ELSE 0 END + CASE p_size % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS score FROM part")
def question_symbols(spark, d):
    """What a question names, and how a heading of the last word of a part's name answers one."""
    q = F.concat(F.lit("does load"), "p_size", F.lit("() use Store::get_"), "p_size", F.lit(" or load"), "p_size", F.lit("()?"))
    last = F.array(F.element_at(F.split("p_name", " "), -1))
    words = F.when(c("p_name").contains(" "), F.split("p_name", " ")).otherwise(F.array(F.lit("-")))
    return P.read(spark, d, "part").select("p_partkey", F.array_join(A.explicit_symbols(q), ",").alias("symbols"), A.group_of(key("part", "p_partkey")).alias("area"), A.facet_score(last, words, c("p_size") % 5).cast("int").alias("score"))


@query("WITH w AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(url), '[a-z]+'), lambda x: length(x) >= 3 AND x NOT IN ('https', 'www', 'com'))) AS w FROM pages), k AS (SELECT page_id, unnest(w) AS x FROM w) SELECT page_id, string_agg(x, ',' ORDER BY -length(x), x) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY -length(x), x) AS r FROM k) WHERE r <= 12 GROUP BY 1")
def navigation_terms(spark, d):
    words = F.regexp_extract_all(F.lower("url"), F.lit("[a-z]+"), F.lit(0))
    terms = A.navigation_terms(words, ["https", "www", "com"])
    return P.read(spark, d, "pages").select("page_id", F.array_join(terms, ",").alias("terms")).where("terms <> ''")


@query(r"SELECT page_id, array_to_string(list_slice(string_split(url, '/'), 1, 5), '/') AS role FROM pages WHERE url IS NOT NULL")
def search_result_role(spark, d):
    return P.read(spark, d, "pages").where("url is not null").select("page_id", A.role(c("url")).alias("role"))


@query(f"WITH {L} SELECT doc_id, ceil(coalesce(sum(strlen(text)) FILTER (NOT regexp_full_match(text, '\\s*(=+ .*|#+ .*|[-=*_.]{{3,}}|[-*])?\\s*')), 0) / 4)::INT AS tokens FROM lines GROUP BY doc_id")
def substantive_tokens(spark, d):
    return P.read(spark, d, "documents").where("text is not null").select("doc_id", A.substance(c("text")).alias("tokens"))


@query(f"WITH {L} SELECT 'doc/' || doc_id AS anchor, substring(string_agg(text, chr(10) ORDER BY line), 1, 380) AS snippet FROM lines WHERE line BETWEEN 2 AND 10 GROUP BY doc_id")
def collect_snippets(spark, d):
    spans = P.read(spark, d, "documents").select(key("doc", "doc_id").alias("anchor"), "doc_id", F.lit(2).alias("first"))
    return A.snippets(P.lines(spark, d), spans)


@query("SELECT p_partkey AS src, 'src/part/f' || (p_size + 1) || '.rs' AS path FROM part WHERE p_size + 1 NOT IN (SELECT p_size FROM part)")
def doc_path_references(spark, d):
    part = P.read(spark, d, "part")
    texts = part.select(c("p_partkey").alias("src"), F.format_string("see src/part/f%d.rs, src/part/f%d.rs", "p_size", c("p_size") + 1).alias("text"))
    return A.named_paths(texts, part.select(F.format_string("src/part/f%d.rs", "p_size").alias("path")))


@query("SELECT CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS class, count(*) AS n FROM events GROUP BY 1")
def message_classes(spark, d):
    text = F.concat(F.when(c("event_type") == "click", "ERROR: ").when(c("event_type") == "view", "WARNING: ").otherwise("note ERROR: "), "event_type")
    return P.read(spark, d, "events").groupBy(A.message_class(text).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'let x = "";' WHEN 1 THEN 'let x = ' || p_size || ';' WHEN 2 THEN 'let x = ''''; y = "";' WHEN 3 THEN 'x = it''s ' || p_name ELSE '' END AS code FROM part""")
def code_only(spark, d):
    kind = c("p_size") % 5
    line = (F.when(kind == 0, F.concat(F.lit('let x = "a // \\" b '), "p_name", F.lit('"; // note')))
            .when(kind == 1, F.concat(F.lit("let x = "), "p_size", F.lit("; # note")))
            .when(kind == 2, F.concat(F.lit("let x = 'http://"), "p_name", F.lit("#1'; y = \"it's\"; # it's a \"note\"")))
            .when(kind == 3, F.concat(F.lit("x = it's "), "p_name", F.lit(" // no string was opened"))).otherwise(F.lit("// note")))
    return P.read(spark, d, "part").select("p_partkey", A.code_only(line).alias("code"))


@query("SELECT 'supplier/' || s_suppkey AS anchor, s_suppkey AS first, s_suppkey + 3 AS last, 'symbol' AS how FROM supplier WHERE s_name = 'Supplier#000000003' UNION ALL SELECT 'supplier/' || s_suppkey, s_suppkey, s_suppkey + 3, 'text' FROM supplier WHERE s_nationkey = 7")
def locate(spark, d):
    """A symbol that there is, and a word that only texts have."""
    s = P.read(spark, d, "supplier").select(key("supplier", "s_suppkey").alias("anchor"), c("s_name").alias("name"), c("s_suppkey").alias("first"), (c("s_suppkey") + 3).alias("last"), F.concat(F.lit("in nation n"), "s_nationkey").alias("text"))
    names, spans, texts = s.select("name", "anchor"), s.select("anchor", "first", "last"), s.select("anchor", "text")
    return A.locate(names, spans, texts, "Supplier#000000003").unionByName(A.locate(names, spans, texts, "n7"))


@query("WITH l AS (SELECT l_orderkey, max(l_shipdate) AS day, list_sort(list_distinct(list(l_partkey))) AS f FROM lineitem GROUP BY 1 ORDER BY day DESC, 1 LIMIT 50) SELECT l_orderkey AS commit_id, strftime(day, '%Y-%m-%d') AS day, array_to_string(f, ',') AS files FROM l")
def commit_activity(spark, d):
    lines = P.read(spark, d, "lineitem").select(c("l_orderkey").alias("commit_id"), c("l_shipdate").alias("at"), c("l_partkey").alias("file"))
    return A.activity(lines, 50).select("commit_id", F.date_format("at", "yyyy-MM-dd").alias("day"), F.array_join(c("files").cast("array<string>"), ",").alias("files"))


@query(f"WITH {N} SELECT round(avg(CASE WHEN node_type IN ('Module', 'Type', 'Function') THEN 1.0 ELSE 0 END), 9) AS fraction FROM nodes")
def code_anchor_fraction(spark, d):
    return P.nodes(spark, d).agg(F.round(F.avg(c("node_type").isin("Module", "Type", "Function").cast("double")), 9).alias("fraction"))
