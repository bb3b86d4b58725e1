"""URL filters by association rules, with DataFrame and SQL functions only.

A page's basket is the set of its URL's tokens: host labels, registered suffixes, path words, query
keys. Baskets of labelled pages get one more item for a bad label. FP-growth mines the frequent
itemsets; rules whose consequent is the bad item are kept if confidence and support are high enough and
no rule with fewer tokens does as well. Before mining, tokens that too few bad pages have are dropped and
tokens of the very same pages (a host's labels and suffixes, the common words of a site's paths) become
one item; a rule gives all of them back, as tokens any of which will do. What is mined grows with the
subsets of the kinds that frequent URLs share, not with their tokens. Rules match by an inverted index:
each is filed under its rarest token, pages meet it there by a join on the token, and the rest is verified.

Hand-written rules (host, path prefix) come before mined ones: a rule fits its host and subdomains if
the path starts with its path; the longest wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, shuffle_partitions, table

#: The item that marks a basket of a page with a bad label; no URL token has a space.
BAD = "label bad"

#: Fixed values of the query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@dataclass(frozen=True)
class Mining:
    """``min_support`` is a share of the labelled pages and ``min_rows`` a number of them; both must hold."""

    min_support: float = 0.002
    min_rows: int = 5
    min_confidence: float = 0.7
    max_tokens: int = 4
    partitions: int | None = None


DEFAULT = Mining()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty if url is null or has no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty if url is null or has no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits (host and path together; ties: the first), or null."""
    best = sorted(enumerate(rules), key=lambda x: (-len(x[1][1] + x[1][2]), x[0]))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for _, (verdict, h, p) in reversed(best):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: host suffixes (h:example.com), host labels (l:www), path words (p:en;
    digits are p:#), query keys (q:page)."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, n), ".")))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(ascii_lower(path), r"[^a-z0-9]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1))
    return F.array_distinct(F.concat(suffixes, F.transform(labels, lambda x: F.concat(F.lit("l:"), x)), words, F.transform(keys, lambda x: F.concat(F.lit("q:"), ascii_lower(x)))))


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table, marked for broadcast if its rows, which are counted, are few."""
    return F.broadcast(df) if df.count() <= most else df


def token_classes(kept: DataFrame, least: int) -> DataFrame:
    """(token, kind): the tokens of at least ``least`` bad baskets (row, tokens, bad); tokens of the very same baskets
    have the same kind, the first of them. Baskets are compared by two 64-bit sums of hashes and their number."""
    hashes = [F.xxhash64(F.array_sort("tokens"), F.lit(seed)).cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)]
    each = kept.select("bad", *hashes, F.explode("tokens").alias("token"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    alike = W.partitionBy("n", "s1", "s2")
    return counted.where(F.col("n_bad") >= least).select("token", F.min("token").over(alike).alias("kind"))


def mine_rules(baskets: DataFrame, p: Mining = DEFAULT) -> DataFrame:
    """Rules (rule_id, needs array<array<string>>, support, confidence, lift) that imply a bad label: a URL fits if it
    has a token of each of the needs. ``baskets``: (tokens array<string>, bad boolean), one row a labelled page.

    A rule's support is the share of bad labelled pages that fit, its confidence that of bad ones of all that fit. The
    tokens of a need are those of the very same labelled pages, any of which makes the same rule; so the rules stand
    for all minimal ones over tokens, of which no rule over some of its tokens has as high a confidence.
    """
    spark = baskets.sparkSession
    empty = spark.createDataFrame([], "rule_id long, needs array<array<string>>, support double, confidence double, lift double")
    kept = durable(baskets.where("bad is not null").select(F.monotonically_increasing_id().alias("row"), F.array_distinct(F.array_compact("tokens")).alias("tokens"), "bad"), "baskets")
    n, n_bad = kept.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(math.ceil(p.min_support * n - 1e-9), p.min_rows, 1)
    if n_bad < least:
        return empty
    # A rule's tokens are all in at least ``least`` bad pages: at most (mean tokens a page) / min_support of them.
    kinds = durable(token_classes(kept, least), "kinds")
    each = kept.select("row", "bad", F.explode("tokens").alias("token")).join(bounded(kinds), "token")
    items = each.groupBy("row", "bad").agg(F.collect_set("kind").alias("kinds"))
    items = durable(items.select(F.when(F.col("bad"), F.array_append("kinds", F.lit(BAD))).otherwise(F.col("kinds")).alias("items")), "items")
    m = items.count()
    if not m:
        return empty
    parts = p.partitions or shuffle_partitions(spark)
    model = FPGrowth(itemsCol="items", minSupport=max(least - 0.5, 0.5) / m, minConfidence=p.min_confidence, numPartitions=parts).fit(items)
    found = model.associationRules.where(F.array_contains("consequent", BAD) & (F.size("antecedent") <= p.max_tokens))
    rules = durable(found.select(F.array_sort("antecedent").alias("kinds"), (F.col("support") * m / n).alias("support"), "confidence"), "rules")
    # Pruned: a rule some of whose kinds make a rule of no less confidence; they are at most 2**max_tokens - 2 subsets.
    subset = F.expr("filter(kinds, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    some = rules.where(F.size("kinds") > 1).select("kinds", "confidence", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("kinds")) - 2).cast("int"))).alias("mask"))
    some = some.select("kinds", "confidence", subset.alias("part"))
    worse = some.join(rules.select(F.col("kinds").alias("part"), F.col("confidence").alias("other")), "part").where("other >= confidence").select("kinds").distinct()
    best = rules.join(worse, "kinds", "left_anti").withColumn("rule_id", F.xxhash64("kinds"))
    same = kinds.groupBy("kind").agg(F.array_sort(F.collect_list("token")).alias("same"))
    needs = best.select("rule_id", F.explode("kinds").alias("kind")).join(same, "kind").groupBy("rule_id").agg(F.array_sort(F.collect_list("same")).alias("needs"))
    return best.join(needs, "rule_id").select("rule_id", "needs", "support", "confidence", (F.col("confidence") * n / n_bad).alias("lift"))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, tokens): the rows of ``pages`` (page_id, tokens array<string>) that a rule fits, once each.

    The index files a rule under the tokens of the need that the fewest pages have, so a common token (a host with a
    third of all pages) brings no candidates unless a rule has nothing rarer.
    """
    words = durable(rules.select("rule_id", F.posexplode("needs").alias("need", "any")).select("rule_id", "need", F.explode("any").alias("token")), "rule-tokens")
    each = pages.select("page_id", "tokens", F.explode("tokens").alias("token"))
    freq = each.join(bounded(words.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    size = words.join(freq, "token", "left").groupBy("rule_id", "need").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    rare = size.groupBy("rule_id").agg(F.min_by("need", F.struct("n", "need")).alias("need"))
    index = durable(words.join(rare, ["rule_id", "need"]).join(rules.select("rule_id", "needs"), "rule_id").select("token", "needs"), "rule-index")
    met = each.join(bounded(index), "token").where(F.forall("needs", lambda any_of: F.arrays_overlap(any_of, F.col("tokens"))))
    return met.select("page_id", "tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, p: Mining = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    ``labels`` (page_id, bad boolean) are what is mined; pages without a label, and null labels, are not
    learned from; a page labelled twice counts as bad if one label is. A null url or one without :// has
    empty host and path, fits no rule and is allowed. Repeated rows are repeated, rows of one page_id with different
    urls are judged each by its own, and a null page_id is judged but not learned from. No rows give no rows; other
    columns of either table are ignored; long urls are read whole.
    """
    spark = pages.sparkSession
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    full = cut.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    known = labels.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    slim = durable(full.select("page_id", "host", "path", "fits", "tokens"), "judged")
    mined = durable(mine_rules(slim.join(known, "page_id").select("tokens", "bad"), p), "mined")
    open_pages = slim.where(F.col("fits").isNull()).select("page_id", "tokens")
    hit = match_rules(open_pages, mined).select(F.col("page_id").alias("hit_page"), F.col("tokens").alias("hit_tokens"), F.lit(True).alias("hit"))
    both = slim.join(hit, F.col("page_id").eqNullSafe(F.col("hit_page")) & (F.col("tokens") == F.col("hit_tokens")), "left")
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page are those of the document with its id: bad if the quality is 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels)
