"""The small query language: node(x), incoming(x), outgoing(x), nodes, edges, where <predicate>.

A script becomes a DataFrame plan; a predicate becomes one Column expression over the node facts.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparisons, in the order in which they are looked for.
COMPARISONS = [">=", "<=", "!=", "~", "=", ">", "<"]
#: Edge types that make a caller, and those that make a reference.
CALLER_TYPES = ["Calls"]
REFERENCE_TYPES = ["Calls", "Uses", "Invokes", "RelatesTo", "Tests", "Verifies", "Implements", "Requires", "Mutates"]

_NUMBERS = ("callers", "refs", "backlinks", "calls")


class QueryError(ValueError):
    """A script that can't be parsed, or an anchor that is unknown or ambiguous."""


def node_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(anchor, node_type, callers, refs, backlinks, calls): in-edges by type, out-calls, 0 where none.
    Both sides are counted before they meet the nodes."""
    into = edges.groupBy(F.col("dst").alias("anchor")).agg(
        F.count_if(F.col("edge_type").isin(CALLER_TYPES)).alias("callers"), F.count_if(F.col("edge_type").isin(REFERENCE_TYPES)).alias("refs"))
    out = edges.where(F.col("edge_type") == "Calls").groupBy(F.col("src").alias("anchor")).agg(F.count(F.lit(1)).alias("calls"))
    all_ = nodes.join(into, "anchor", "left").join(out, "anchor", "left").fillna(0, ["callers", "refs", "calls"])
    return all_.select("anchor", "node_type", "callers", "refs", F.col("refs").alias("backlinks"), "calls")


def _atom(text: str) -> Column:
    text = text.strip()
    negated = text.lower().startswith("not ")
    if negated:
        text = text[4:].strip()
    text = text.strip("()").strip()
    for op in COMPARISONS:
        at = text.find(op)
        if at < 0:
            continue
        field, value = text[:at].strip().lower(), text[at + len(op):].strip().strip("\"'")
        if not field:
            break
        return _compare(field, op, value) != F.lit(negated)
    raise QueryError(f"can't parse {text!r}: field, comparison, value are needed")


def _compare(field: str, op: str, value: str) -> Column:
    if field in _NUMBERS:
        if op == "~" or not re.fullmatch(r"\+?\d+", value):
            return F.lit(False)
        x, y = F.col(field), F.lit(int(value))
        return {"=": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]
    name = {"type": "node_type", "anchor": "anchor", "name": "anchor"}.get(field)
    if name is None:
        return F.lit(False)
    x, y = F.lower(F.col(name)), F.lit(value.lower())
    return {"=": x == y, "!=": x != y, "~": x.contains(y)}.get(op, F.lit(False))


def predicate(text: str) -> Column:
    """An OR of ANDs as a Column. Unknown fields and numbers that don't parse are false (true under not)."""
    groups = []
    for part in re.split(r" or ", text.strip(), flags=re.I):
        atoms = [_atom(a) for a in re.split(r" and ", part, flags=re.I) if a.strip()]
        if atoms:
            groups.append(reduce(and_, atoms))
    if not groups:
        raise QueryError("where needs a predicate")
    return reduce(or_, groups)


def resolve(nodes: DataFrame, name: str) -> str:
    """The exact anchor, or the only one that ends in #name; at most three rows come to the driver."""
    hit = nodes.where((F.col("anchor") == name) | F.col("anchor").endswith(f"#{name}")).select("anchor").distinct()
    found = [r[0] for r in hit.orderBy((F.col("anchor") == name).desc(), "anchor").limit(3).collect()]
    if name in found:
        return name
    if len(found) != 1:
        raise QueryError(f"{name!r} is " + ("unknown" if not found else f"ambiguous: {', '.join(found)}"))
    return found[0]


def execute(script: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(result): one row a hit. Parallel edges give parallel rows."""
    script = script.strip()
    if m := re.fullmatch(r"(node|incoming|outgoing)\s*\((.*)\)", script, re.S):
        name = resolve(nodes, m[2].strip().strip("\"'"))
        if m[1] == "node":
            return nodes.where(F.col("anchor") == name).select(F.col("anchor").alias("result"))
        near, far = ("dst", "src") if m[1] == "incoming" else ("src", "dst")
        return edges.where(F.col(near) == name).select(F.col(far).alias("result"))
    if script.lower() == "nodes":
        return nodes.select(F.col("anchor").alias("result"))
    if script.lower() == "edges":
        return edges.select(F.concat_ws(" -> ", "src", "dst").alias("result"))
    if script[:6].lower() == "where ":
        return node_facts(nodes, edges).where(predicate(script[6:])).select(F.col("anchor").alias("result"))
    raise QueryError(f"unknown query {script!r}")
