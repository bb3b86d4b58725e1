"""The logical tables of the engine over the supplied Parquet tables: nodes, edges, tokens, lines, spans.

Every function is lazy, but for the count of rows that edges are dealt by, and prunes columns; nothing is cached. ``*_SQL`` are the same tables as common
table expressions for the SQL of the driver's comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.io import written

#: Edge types that carry a change from one node to another.
IMPACT_TYPES = ["Uses", "Calls", "Implements", "Mutates"]
#: Containment, which is structure and no dependency.
STRUCTURE_TYPES = ["Contains", "PartOf"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchor(kind: str, *keys: Column) -> Column:
    return F.concat_ws("/", F.lit(kind), *(k.cast("string") for k in keys))


#: Rows that a task makes distinct.
TASK_ROWS = 500_000


def distinct_pairs(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys, dealt to as many tasks as the counted rows need: tasks made by bytes would hold the more rows
    the better these shrink."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.select(*keys).repartition(n, *keys).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_type), unique: keys as containment both ways, orders use customers and call parts,
    parts are implemented by suppliers, a turn requires the next one (in every seventh conversation the last
    one the first: cycles)."""
    t = lambda name: read(spark, sf_dir, name)

    def edge(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))

    c = F.col
    held = [("nation", c("n_nationkey"), "region", c("n_regionkey")), ("customer", c("c_custkey"), "nation", c("c_nationkey")), ("supplier", c("s_suppkey"), "nation", c("s_nationkey"))]
    parts = []
    for kind, key, whole, owner in held:
        part, of = anchor(kind, key), anchor(whole, owner)
        parts += [edge(t(kind), part, of, "PartOf"), edge(t(kind), of, part, "Contains")]
    line = t("lineitem")
    parts += [
        edge(t("orders"), anchor("order", c("o_orderkey")), anchor("customer", c("o_custkey")), "Uses"),
        edge(distinct_pairs(line, "l_orderkey", "l_partkey"), anchor("order", c("l_orderkey")), anchor("part", c("l_partkey")), "Calls"),
        edge(distinct_pairs(line, "l_partkey", "l_suppkey"), anchor("part", c("l_partkey")), anchor("supplier", c("l_suppkey")), "Implements"),
    ]
    turns = t("conversations").select("conv_id", "turn")
    after = turns.select("conv_id", (c("turn") - 1).alias("turn"))
    parts.append(edge(turns.join(after, ["conv_id", "turn"], "left_semi"), anchor("turn", c("conv_id"), c("turn")), anchor("turn", c("conv_id"), c("turn") + 1), "Requires"))
    # Every seventh conversation goes round: its last turn requires its first.
    ends = turns.where("conv_id % 7 = 0").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi")).where("lo < hi")
    parts.append(edge(ends, anchor("turn", c("conv_id"), c("hi")), anchor("turn", c("conv_id"), c("lo")), "Requires"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES_SQL = """
edges AS (
  SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst, 'PartOf' AS edge_type FROM nation
  UNION ALL SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey, 'Contains' FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'PartOf' FROM customer
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'Contains' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'PartOf' FROM supplier
  UNION ALL SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey, 'Contains' FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'Uses' FROM orders
  UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey, 'Calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'Implements' FROM lineitem
  UNION ALL SELECT 'turn/' || a.conv_id || '/' || a.turn, 'turn/' || a.conv_id || '/' || (a.turn + 1), 'Requires'
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  UNION ALL SELECT 'turn/' || conv_id || '/' || max(turn), 'turn/' || conv_id || '/' || min(turn), 'Requires'
    FROM conversations WHERE conv_id % 7 = 0 GROUP BY conv_id HAVING min(turn) < max(turn)
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor, node_type): one row an entity, documents, pages and benchmark items included."""
    kinds = [("region", "r_regionkey", "Module"), ("nation", "n_nationkey", "Module"), ("customer", "c_custkey", "Type"), ("supplier", "s_suppkey", "Type"), ("part", "p_partkey", "Function"), ("orders", "o_orderkey", "Function"), ("documents", "doc_id", "Note"), ("pages", "page_id", "Note"), ("benchmark", "item_id", "Spec")]
    short = {"orders": "order", "documents": "doc", "pages": "page", "benchmark": "item"}
    out = None
    for table, key, kind in kinds:
        part = read(spark, sf_dir, table).select(anchor(short.get(table, table), F.col(key)).alias("anchor"), F.lit(kind).alias("node_type"))
        out = part if out is None else out.unionByName(part)
    turn = read(spark, sf_dir, "conversations").select(anchor("turn", F.col("conv_id"), F.col("turn")).alias("anchor"), F.lit("Note").alias("node_type"))
    return out.unionByName(turn)


NODES_SQL = """
nodes AS (
  SELECT 'region/' || r_regionkey AS anchor, 'Module' AS node_type FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'Module' FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'Type' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'Type' FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, 'Function' FROM part
  UNION ALL SELECT 'order/' || o_orderkey, 'Function' FROM orders
  UNION ALL SELECT 'doc/' || doc_id, 'Note' FROM documents
  UNION ALL SELECT 'page/' || page_id, 'Note' FROM pages
  UNION ALL SELECT 'item/' || item_id, 'Spec' FROM benchmark
  UNION ALL SELECT 'turn/' || conv_id || '/' || turn, 'Note' FROM conversations
)"""


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of [a-z0-9]: the tokenizer of the ranking queries (stemming is in functions.text)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(spark: SparkSession, sf_dir: str, words: list[str] | None = None) -> DataFrame:
    """(token, doc_id, tf, len): one row a distinct token of a document. With ``words`` only theirs: filtered
    before the tokens are exploded, so nothing else is shuffled."""
    docs = read(spark, sf_dir, "documents").select("doc_id", plain_tokens(F.col("text")).alias("all"))
    docs = docs.select("doc_id", "all", F.size("all").alias("len"))
    if words is not None:
        wanted = F.array(*(F.lit(w) for w in words))
        docs = docs.select("doc_id", "len", F.filter("all", lambda x: F.array_contains(wanted, x)).alias("all"))
    return docs.select("doc_id", "len", F.explode("all").alias("token")).groupBy("token", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))


def term_hits(spark: SparkSession, sf_dir: str, words: list[str]) -> DataFrame:
    """(doc_id, len, uniq, tfs): of every document its token count, its distinct tokens and how often it has each
    of the words. One scan of the texts, written: statistics and postings of a query are read from it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", plain_tokens(F.col("text")).alias("a"))

    def times(word: str) -> Column:
        return F.size(F.filter("a", lambda x: x == word))
    tfs = F.array(*map(times, words))
    return written(docs.select("doc_id", F.size("a").alias("len"), F.size(F.array_distinct("a")).alias("uniq"), tfs.alias("tfs")), "term-hits")


def hit_postings(hits: DataFrame, words: list[str]) -> DataFrame:
    """(token, doc_id, tf, len) from ``term_hits``."""
    tf = F.arrays_zip(F.array(*map(F.lit, words)).alias("token"), F.col("tfs").alias("tf"))
    return hits.select("doc_id", "len", F.explode(tf).alias("p")).where("p.tf > 0").select("p.token", "doc_id", F.col("p.tf").cast("long").alias("tf"), "len")


POSTINGS_SQL = """
toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS a FROM documents),
postings AS (
  SELECT token, doc_id, len, count(*) AS tf
  FROM (SELECT doc_id, len(a) AS len, unnest(a) AS token FROM toks) GROUP BY token, doc_id, len
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, text): lines of documents, numbered from 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return docs.select("doc_id", (F.col("line") + 1).alias("line"), "text")


LINES_SQL = """
lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
)"""
