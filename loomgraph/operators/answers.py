"""What answers are made of: edges out of signatures and references, blocks of documents, scopes, communities,
re-ranking, limits, and the checks of sources, contracts and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import nearest, traverse

c = F.col


def only(names: DataFrame) -> DataFrame:
    """(name, dst) of (name, anchor): names that one anchor alone has."""
    return names.groupBy("name").agg(F.min("anchor").alias("dst"), F.countDistinct("anchor").alias("k")).where("k = 1").select("name", "dst")


def uses(signatures: DataFrame, types: DataFrame) -> DataFrame:
    """Uses edges of (anchor, signature): to the types (name, anchor) that it names, words that begin with a
    capital; a name of several anchors gives none, nor does a type's own signature."""
    named = signatures.select(c("anchor").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("signature", F.lit(r"\b[A-Z]\w*"), F.lit(0)))).alias("name"))
    return named.join(only(types), "name").where("src <> dst").select("src", "dst", F.lit("Uses").alias("edge_type")).distinct()


def mutates(signatures: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mutates edges of (anchor, signature): a method that takes itself mutably changes its parent type, the anchor
    without its last :: part, if that is a node."""
    own = signatures.where(c("signature").rlike(r"&\s*mut\s+self\b") & c("anchor").contains("::"))
    up = own.select(c("anchor").alias("src"), F.regexp_replace("anchor", r"::[^:]*$", "").alias("dst"))
    return up.join(nodes.select(c("anchor").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.lit("Mutates").alias("edge_type")).distinct()


def demonstrates(listings: DataFrame, names: DataFrame) -> DataFrame:
    """Demonstrates edges of listings (src, token): to what a token alone names."""
    met = listings.select("src", c("token").alias("name")).distinct().join(only(names), "name")
    return met.where("src <> dst").select("src", "dst", F.lit("Demonstrates").alias("edge_type")).distinct()


def slug(title: Column) -> Column:
    """Lower-cased, what is no letter or digit a single dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def doc_refs(refs: DataFrame, headings: DataFrame) -> DataFrame:
    """RelatesTo edges both ways of references (src, target): to the heading (anchor, title) of that anchor, else to
    the only one whose title's slug it is."""
    exact = headings.select(c("anchor").alias("target"), c("anchor").alias("exact")).distinct()
    by = only(headings.select(slug(c("title")).alias("name"), "anchor")).select(c("name").alias("target"), c("dst").alias("slugged"))
    met = refs.join(exact, "target", "left").join(by, "target", "left").select("src", F.coalesce("exact", "slugged").alias("dst")).where("dst is not null and src <> dst")
    return met.unionByName(met.select(c("dst").alias("src"), c("src").alias("dst"))).select("src", "dst", F.lit("RelatesTo").alias("edge_type")).distinct()


def blocks_shown(blocks: Column, kinds: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, attributes: list[str] | None = None) -> Column:
    """Of an array of blocks (kind, tags, ifdef, ...) those of the kinds, with one of the tags asked for and none of
    those excluded, and whose ifdef attribute, if they have one, is set."""
    words = lambda w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")

    def shown(b: Column) -> Column:
        ok = F.lit(True)
        tags = F.coalesce(b["tags"], F.array().cast("array<string>"))
        if kinds is not None:
            ok &= b["kind"].isin(kinds)
        if include:
            ok &= F.arrays_overlap(tags, words(include))
        if exclude:
            ok &= ~F.arrays_overlap(tags, words(exclude))
        return ok & (b["ifdef"].isNull() | F.array_contains(words(attributes), b["ifdef"]))
    return F.filter(blocks, shown)


def scope(edges: DataFrame, seeds: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """(file, anchors): files of the seeds (anchor), of all that depends on them, of what they lead to, and of their
    communities (labels: anchor, community); files: anchor, file. Each with how many anchors it is there for."""
    from_seeds = edges.join(seeds.select(c("anchor").alias("src")).distinct(), "src", "left_semi").select(c("dst").alias("anchor"))
    mine = labels.join(seeds.select("anchor").distinct(), "anchor", "left_semi").select("community").distinct()
    near = labels.join(mine, "community", "left_semi").select("anchor")
    all_ = seeds.select("anchor").unionByName(traverse.dependents(edges, seeds).select("anchor")).unionByName(from_seeds).unionByName(near).distinct()
    return files.join(all_, "anchor", "left_semi").groupBy("file").agg(F.countDistinct("anchor").alias("anchors"))


def communities_slice(labels: DataFrame, edges: DataFrame, least: int = 3, most: int = 12, members: int = 12) -> DataFrame:
    """(community, size, anchor, rank) of the ``most`` largest communities of at least ``least`` nodes: the first
    ``members`` of each by degree, then by name."""
    size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(c("size") >= least).orderBy(c("size").desc(), "community").limit(most)
    degree = edges.select(F.explode(F.array("src", "dst")).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("degree"))
    named = labels.join(F.broadcast(size), "community").join(degree, "anchor", "left")
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.coalesce("degree", F.lit(0)).desc(), "anchor"))
    return named.select("community", "size", "anchor", rank.alias("rank")).where(c("rank") <= members)


def community_seeds(labels: DataFrame, anchors: DataFrame, scores: DataFrame, most: int = 3) -> DataFrame:
    """(anchor, seed, rank): other members of an anchor's community, the best ``most`` by score (anchor, score)."""
    at = anchors.select("anchor").distinct().join(labels, "anchor")
    met = at.join(labels.select(c("anchor").alias("seed"), "community"), "community").where("anchor <> seed")
    scored = met.join(scores.select(c("anchor").alias("seed"), "score"), "seed", "left")
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.coalesce("score", F.lit(0)).desc(), "seed"))
    return scored.select("anchor", "seed", rank.alias("rank")).where(c("rank") <= most)


def rerank_window(ranked: DataFrame, k: int, weight: float = 2.0) -> DataFrame:
    """(anchor, rank) of (anchor, rank, rel): the first ``k`` by 1 / rank + weight * rel / the greatest rel of them;
    the others keep their place."""
    head = ranked.where(c("rank") <= k)
    top = F.max("rel").over(W.partitionBy())
    score = F.round(1 / c("rank") + F.when(top > 0, weight * c("rel") / top).otherwise(0), 9)
    again = head.select("anchor", "rank", score.alias("score")).select("anchor", F.row_number().over(W.orderBy(c("score").desc(), "rank")).alias("rank"))
    return again.unionByName(ranked.where(c("rank") > k).select("anchor", c("rank").cast("int").alias("rank")))


def truncated(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows, each marked with whether there were more; one row more is read and no count made."""
    more = rows.orderBy(*order).limit(most + 1)
    place = F.row_number().over(W.orderBy(*order))
    return more.withColumn("_r", place).withColumn("truncated", F.max("_r").over(W.partitionBy()) > most).where(c("_r") <= most).drop("_r")


def tables_once(tables: DataFrame, order: str) -> DataFrame:
    """Of (file, content, ...) each content once a file, the first by ``order``. Contents meet by their hash."""
    rank = F.row_number().over(W.partitionBy("file", F.sha2("content", 256)).orderBy(order))
    return tables.withColumn("_r", rank).where("_r = 1").drop("_r")


def within_bytes(hits: DataFrame, text: str, order: list, most_bytes: int = 65_536, most: int = 512) -> DataFrame:
    """The first hits that fit an answer: at most ``most`` and, together, so many bytes of ``text``. Only ``most``
    rows are ever ordered in one place."""
    kept = hits.orderBy(*order).limit(most)
    return kept.withColumn("bytes", F.sum(F.octet_length(text)).over(W.orderBy(*order))).where(c("bytes") <= most_bytes)


def needs_regex(pattern: Column) -> Column:
    """Whether a literal pattern holds what only a regular expression means: an alternative or an escaped class."""
    return pattern.contains("|") | pattern.rlike(r"\\[bBdDsSwW]|\.\*|\.\+")


def stale_refs(refs: DataFrame, nodes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(src, target, suggestion): references (src, target) with a known prefix to no node, and the node of that prefix
    that is nearest in edits, if within a third of the reference's length and 16 edits; ties by name."""
    kind = lambda a: F.regexp_extract(a, "^(" + "|".join(prefixes) + ")", 1)
    known = nodes.select("anchor").distinct()
    gone = refs.select("src", "target", kind("target").alias("p")).where("p <> ''").join(known.withColumnRenamed("anchor", "target"), "target", "left_anti")
    best = None
    for p in prefixes:
        found = nearest.nearest(gone.where(c("p") == p).select("target"), known.where(kind("anchor") == p)).select("target", c("anchor").alias("suggestion"))
        best = found if best is None else best.unionByName(found)
    return gone.join(best, "target", "left").select("src", "target", "suggestion")


def missing_sources(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(anchor, file) of nodes (anchor, file, hash) that were read from a file that is no longer there (file)."""
    return nodes.where("file is not null and hash is not null").join(files.select("file").distinct(), "file", "left_anti").select("anchor", "file")


def signature_drift(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(anchor, old, new) of symbols (anchor, signature) whose signature is another; runs of blanks count as one."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    both = stored.select("anchor", flat("signature").alias("old")).join(now.select("anchor", flat("signature").alias("new")), "anchor")
    return both.where("old <> new")


def arity_divergence(documented: DataFrame, real: DataFrame) -> DataFrame:
    """(src, name, said, arity) of declarations in documents (src, name, said) whose number of parameters is not that
    of the symbol (name, anchor, arity); only names that one symbol has."""
    one = real.groupBy("name").agg(F.min("arity").alias("arity"), F.countDistinct("anchor").alias("k")).where("k = 1").drop("k")
    return documented.join(one, "name").where("said <> arity").select("src", "name", "said", "arity").distinct()


#: Severities of directives, the strictest first.
STRICTNESS = ["forbid", "require", "warn", "allow"]


def stricter(a: Column, b: Column, author_a: Column, founder: str = "constitution") -> Column:
    """``a`` or ``b``, whichever directive is the stricter; of equal ones a's if the founding author wrote it, else b's."""
    order = F.array(*map(F.lit, STRICTNESS))
    pa, pb = F.array_position(order, a), F.array_position(order, b)
    return F.when(pa < pb, F.lit("a")).when(pb < pa, F.lit("b")).when(author_a == founder, F.lit("a")).otherwise(F.lit("b"))


def empty_contracts(contracts: DataFrame) -> DataFrame:
    """(anchor) of contracts (anchor, pre, post, invariant) in which none of the three says anything."""
    said = [F.trim(F.coalesce(x, F.lit(""))) != "" for x in ("pre", "post", "invariant")]
    return contracts.where(~(said[0] | said[1] | said[2])).select("anchor")


def with_overlay(nodes: DataFrame, overlays: DataFrame) -> DataFrame:
    """(anchor, blocks): a node's blocks and after them those people added (anchor, position, block), in their order."""
    added = overlays.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda b: b["block"]).alias("added"))
    return nodes.join(added, "anchor", "left").select("anchor", F.concat("blocks", F.coalesce("added", F.array().cast("array<string>"))).alias("blocks"))


def canonical(sections: DataFrame) -> DataFrame:
    """(anchor, canonical) of sections (file, anchor, indegree): the section of its file that is referred to most,
    the first by name of equal ones; a file nothing refers to has none."""
    best = sections.where("indegree > 0").groupBy("file").agg(F.min(F.struct((-c("indegree")).alias("n"), "anchor")).alias("b"))
    return sections.join(best, "file").select("anchor", c("b.anchor").alias("canonical"))


def explicit_symbols(question: Column) -> Column:
    """Of a question the names it calls (``name()``) or qualifies (``A::b``), once each, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(r"\w+(?:::\w+)+(?:\(\))?|\w+\(\)"), F.lit(0)), lambda x: F.regexp_replace(x, r"\(\)$", "")))


def facet_score(facet: Column, words: Column, level: Column) -> Column:
    """4 a word of the facet (both arrays) that a heading has, and 2 for a third or fourth level, 1 for a second."""
    return 4 * F.size(F.array_intersect(facet, words)) + F.when(level.isin(3, 4), 2).when(level == 2, 1).otherwise(0)


def role(path: Column) -> Column:
    """The first five parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 5), "/")


def navigation_terms(words: Column, stop: list[str], most: int = 12) -> Column:
    """Distinct words of three signs and more that are no stop words, the longest first, then by the alphabet."""
    kept = F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 3) & ~w.isin(stop))
    keyed = F.array_sort(F.transform(kept, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(keyed, lambda x: x["w"]), 1, most)


def group_of(anchor: Column) -> Column:
    """The area of an anchor: what stands before its first / or #."""
    return F.regexp_extract(anchor, "^[^/#]*", 0)


def substance(text: Column) -> Column:
    """Tokens (of four bytes, rounded up) of a text's lines that are neither blank, headings, rules nor list marks alone."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(=+ .*|#+ .*|[-=*_.]{3,}|[-*])?\s*$"))
    return F.ceil(F.aggregate(lines, F.lit(0), lambda n, x: n + F.octet_length(x)) / 4).cast("int")


def snippets(lines: DataFrame, spans: DataFrame, most_lines: int = 9, most_chars: int = 380) -> DataFrame:
    """(anchor, snippet) of spans (anchor, doc_id, first): the first lines (doc_id, line, text) of each, cut to size."""
    met = lines.join(spans, "doc_id").where((c("line") >= c("first")) & (c("line") < c("first") + most_lines))
    rows = met.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return rows.select("anchor", F.substring(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 1, most_chars).alias("snippet"))


def named_paths(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(src, path): paths that texts (src, text) name, with a folder and an ending, and that no file (path) has."""
    said = texts.select("src", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:[\w.-]+/)+[\w-]+\.[a-z]{1,5}\b"), F.lit(0)))).alias("path"))
    return said.join(files.select("path").distinct(), "path", "left_anti").select("src", "path")


def message_class(message: Column) -> Column:
    """error, warning or info, by a message's prefix; anything else is info."""
    return F.when(message.startswith("ERROR:"), "error").when(message.startswith("WARNING:"), "warning").otherwise("info")


def code_only(line: Column) -> Column:
    """A line of code without what stands in double or single quotes (the quotes stay) and without a comment, // or #,
    at its end. Quotes and comments are read from the left: a mark inside quotes is no comment, a quote inside a comment
    opens nothing, and a quote that is never closed is an ordinary sign."""
    # Whatever comes first at a place is taken whole: a string, a comment up to the end, or one other sign.
    pieces = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r'''(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|(?://|#).*|.'''), F.lit(0))
    plain = F.transform(pieces, lambda x: F.when(x.startswith("//") | x.startswith("#"), "").when((F.length(x) > 1) & x.startswith('"'), '""').when((F.length(x) > 1) & x.startswith("'"), "''").otherwise(x))
    return F.when(line.isNotNull(), F.rtrim(F.array_join(plain, "")))


def locate(names: DataFrame, spans: DataFrame, texts: DataFrame, wanted: str) -> DataFrame:
    """(anchor, first, last, how): the spans (anchor, first, last) of anchors that have the name (name, anchor); if
    there are none, of the anchors whose text (anchor, text) has the word."""
    found = names.where(c("name") == wanted).select("anchor").distinct().withColumn("how", F.lit("symbol"))
    none = found.groupBy().agg(F.count(F.lit(1)).alias("k")).where("k = 0")
    word = texts.where(F.array_contains(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)), wanted)).select("anchor").withColumn("how", F.lit("text"))
    return spans.join(found.unionByName(word.crossJoin(none).select("anchor", "how")), "anchor").select("anchor", "first", "last", "how")


def activity(commits: DataFrame, most: int) -> DataFrame:
    """(commit_id, at, files) of commits (commit_id, at, file), the ``most`` latest: a series to replay."""
    last = commits.groupBy("commit_id").agg(F.max("at").alias("at")).orderBy(c("at").desc(), "commit_id").limit(most)
    return commits.join(F.broadcast(last.select("commit_id")), "commit_id").groupBy("commit_id").agg(F.max("at").alias("at"), F.array_sort(F.collect_set("file")).alias("files"))
