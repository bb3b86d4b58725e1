"""Context under a token budget: order-dependent folds over candidate lists, one group a request."""

from __future__ import annotations

import heapq
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Traversal priority of edge types, least first; all others 12.
EDGE_PRIORITY = {"Calls": 0, "Invokes": 1, "Implements": 2, "IsA": 3, "PartOf": 4, "Uses": 5, "Requires": 6, "Mutates": 7, "Constrains": 8, "Tests": 9, "Verifies": 10, "Documents": 11, "Contains": 11, "Demonstrates": 11}
#: Activation weight of edge types.
EDGE_WEIGHT = {"IsA": 1.0, "IsEquivalentTo": 0.95, "PartOf": 0.9, "Causes": 0.9, "SynonymOf": 0.8, "Uses": 0.8, "UsedBy": 0.8, "Calls": 0.8, "Implements": 0.8, "Extends": 0.8, "SimilarTo": 0.7, "PrerequisiteFor": 0.7, "Implies": 0.7, "Constrains": 0.7, "Invokes": 0.7, "Imports": 0.6, "Tests": 0.6, "Verifies": 0.6, "DefinesTerm": 0.6, "Requires": 0.6, "Mutates": 0.6, "RelatesTo": 0.5, "AssociatedWith": 0.5, "Explains": 0.5, "Documents": 0.5, "Demonstrates": 0.5, "Contains": 0.5, "Justifies": 0.5, "Supersedes": 0.5, "Amends": 0.5, "AntonymOf": 0.4, "Mentions": 0.3}
#: What a question is after: (intent, depth of its walk, whole words and phrases that show it), in order of priority.
INTENTS = [
    ("debug", 3, ["fails", "failing", "error", "errors", "crash", "crashes", "exception", "stack trace", "broken"]),
    ("impact", 3, ["breaks", "affected", "impact", "downstream", "depends on", "callers", "who uses"]),
    ("refactor", 4, ["refactor", "rename", "move", "split", "merge", "clean up"]),
    ("usage", 2, ["use", "using", "example", "examples", "how do i", "call"]),
    ("compare", 3, ["compare", "versus", "vs", "difference", "differences", "better"]),
    ("locate", 1, ["where", "find", "defined", "location"]),
    ("count", 1, ["count", "how many", "number of"]),
    ("list", 2, ["list", "enumerate", "all of", "which"]),
    ("explain", 2, ["explain", "describe", "why", "what is", "how does", "purpose", "overview"]),
]


def map_of(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def edge_priority(edge_type):
    return F.coalesce(F.try_element_at(map_of(EDGE_PRIORITY), edge_type), F.lit(12))


def edge_weight(edge_type):
    return F.coalesce(F.try_element_at(map_of(EDGE_WEIGHT), edge_type), F.lit(0.5))


def intent_pattern(words: list[str]) -> str:
    """Any of the words or phrases, whole."""
    return r"\b(" + "|".join(words) + r")\b"


def classify_intent(question):
    """The intent with the most different words found whole, ties to the earlier; general without any."""
    q = F.lower(F.coalesce(question, F.lit("")))
    found = [F.struct(F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(intent_pattern(words)), F.lit(1)))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, _, words) in enumerate(INTENTS)]
    best = F.array_max(F.array(*found))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def ordered_neighbors(edges: DataFrame) -> DataFrame:
    """(src, dst, priority, position): each node's neighbours by least priority, then anchor."""
    best = edges.groupBy("src", "dst").agg(F.min(edge_priority(F.col("edge_type"))).alias("priority"))
    return best.withColumn("position", F.row_number().over(W.partitionBy("src").orderBy("priority", "dst")))


def prefix_budget(items: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each group in order as long as their running cost stays within the budget."""
    run = F.sum(cost).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return items.withColumn("running", run).where(F.col("running") <= budget)


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def assemble(items: DataFrame, budget: int, *, skip: bool = False, similar: float | None = None) -> DataFrame:
    """(request, anchor, position, tokens, running) of what fits each request's budget.

    ``items``: request, anchor, position, tokens, text; any number for each request, read in order and never held.
    Taken in order; what does not fit ends the list, or with ``skip`` is passed over. ``similar``: an item
    whose words have at least this Jaccard likeness to one already taken is passed over.
    """
    names = ["request", "anchor", "position", "tokens", "running"]

    def fold(batches):
        request, used, kept, done = None, 0, None, False
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if kept is None or r.request != request:
                    request, used, kept, done = r.request, 0, [], False
                if done:
                    continue
                words = {w for w in (r.text or "").lower().split() if len(w) > 1}
                if used + r.tokens > budget and skip:
                    continue
                if similar is not None and any(_jaccard(words, k) >= similar for k in kept):
                    continue
                if used + r.tokens > budget:
                    done = True
                    continue
                used += r.tokens
                kept.append(words)
                rows.append((r.request, r.anchor, r.position, r.tokens, used))
            yield pd.DataFrame(rows, columns=names)
    items = items.select("request", "anchor", "position", "tokens", "text")
    if skip:  # what is larger than the whole budget is never taken
        items = items.where(F.col("tokens") <= budget)
    dealt = items.repartition("request").sortWithinPartitions("request", "position", "anchor")
    return dealt.mapInPandas(fold, "request string, anchor string, position int, tokens int, running int")


def select_relevant(items: DataFrame, budget: int, trade: float = 0.7) -> DataFrame:
    """(request, anchor, place, tokens, running, score): items chosen one after the other by marginal relevance.

    ``items``: request, anchor, relevance, tokens, text. Each step takes, of those that still fit, the item with the
    greatest ``trade`` * relevance - (1 - ``trade``) * its greatest likeness (Jaccard, of words) to one already taken;
    ties to the first by anchor. A score only falls as more is taken, so an item's last known score bounds it from
    above: items are read by falling relevance, no further than the best known score, and scored again only when they
    lead the heap. What doesn't fit any more is let go, so a request may be larger than memory. Nulls: a null relevance is
    0, a null text has no words; items without an anchor or with more tokens than the budget are never taken.
    """
    names = ["request", "anchor", "place", "tokens", "running", "score"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def greedy(items):
        heap, taken, used = [], [], 0
        ahead = next(items, None)
        while heap or ahead is not None:
            while ahead is not None and (not heap or trade * ahead[2] >= -heap[0][0]):
                _, anchor, relevance, tokens, text = ahead
                if used + tokens <= budget:
                    heapq.heappush(heap, (-trade * relevance, anchor, relevance, tokens, {w for w in (text or "").lower().split() if len(w) > 1}, 0.0, 0))
                ahead = next(items, None)
            if not heap:
                continue
            _, anchor, relevance, tokens, words, like, seen = heapq.heappop(heap)
            if used + tokens > budget:
                continue
            if seen < len(taken):
                like = max(like, max(_jaccard(words, t[1]) for t in taken[seen:]))
                heapq.heappush(heap, (-(trade * relevance - (1 - trade) * like), anchor, relevance, tokens, words, like, len(taken)))
                continue
            used += tokens
            taken.append((anchor, words))
            yield anchor, len(taken), tokens, used, trade * relevance - (1 - trade) * like

    def run(batches):
        for request, items in groupby(rows(batches), key=lambda r: r[0]):
            chosen = [(request, *x) for x in greedy(items)]
            if chosen:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*chosen), kinds)], names)
    given = items.where(F.col("anchor").isNotNull() & (F.col("tokens") <= budget)).select("request", "anchor", F.coalesce(F.col("relevance").cast("double"), F.lit(0.0)).alias("relevance"), F.col("tokens").cast("int").alias("tokens"), "text")
    dealt = given.repartition("request").sortWithinPartitions("request", F.col("relevance").desc(), "anchor")
    return dealt.mapInArrow(run, "request string, anchor string, place int, tokens int, running int, score double")


def passages(paragraphs: DataFrame, terms: list[str], k: int = 4) -> DataFrame:
    """(doc_id, para, score, r): each document's best ``k`` paragraphs (doc_id, para, text) by the summed idf of
    the query terms they hold."""
    each = paragraphs.select("doc_id", "para", F.explode(F.array(*map(F.lit, terms))).alias("term"), F.lower("text").alias("t")).where(F.contains("t", F.col("term")))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = paragraphs.agg(F.count(F.lit(1)).alias("n"))
    idf = df.crossJoin(n).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    scored = each.join(F.broadcast(idf), "term").groupBy("doc_id", "para").agg(F.sum("idf").alias("score"))
    return scored.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("score").desc(), "para"))).where(F.col("r") <= k)
