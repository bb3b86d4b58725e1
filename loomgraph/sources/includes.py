"""Include closure of light markup with conditionals: files spliced into the files that include them, level by level.

A unit is a file as an include asks for it: its path and the lines or tags it selects. Units are scanned once each,
file by file, with a stack of the conditions that are open; what is left of one are its lines and its own includes.
Splicing is a join a level: an include's place is followed by the places in what it includes, so order keys are arrays
that sort as the text reads, and nothing is numbered anew. Attributes are given; they hold everywhere.

Lines: ``include::path[lines=1..3,5;tags=t;leveloffset=1]``, ``ifdef::a[]``, ``ifndef::a[]``, ``ifeval::[{a} == "x"]``,
``endif::[]``, headings, ``{a}``.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.io import written

c = F.col
INCLUDE = re.compile(r"^include::([^\[\]]+)\[([^\]]*)\]$")
CONDITION = re.compile(r"^(ifdef|ifndef)::([^\[\]]+)\[\]$")
EVALUATED = re.compile(r"^ifeval::\[(.*)\]$")
COMPARED = re.compile(r"(.*?)(<=|>=|==|!=|<|>)(.*)")
UNIT = ["path", "lines", "tags"]


def holds(expression: str, attributes: dict[str, str]) -> bool:
    """``{a} == "x"``, !=, or a comparison of numbers; an unknown attribute is empty, and what is no comparison is false."""
    found = COMPARED.fullmatch(expression.strip())
    if not found:
        return False
    left, sign, right = (x.strip() for x in found.groups())
    if left.startswith("{") and left.endswith("}"):
        left = attributes.get(left[1:-1], "")
    right = right.strip('"')
    if sign in ("==", "!="):
        return (left == right) == (sign == "==")
    try:
        a, b = float(left), float(right)
    except ValueError:
        return False
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]


def selected(rows: list[str], lines: str, tags: str) -> list[str]:
    """The lines of a file that ``lines`` (``2..4,7,9..``) and then ``tags`` ask for; an empty selector asks for all."""
    if lines:
        out: list[str] = []
        for part in lines.split(","):
            a, dots, b = (x.strip() for x in part.partition(".."))
            if not a.isdigit() or (b and not b.isdigit()):
                continue  # what is no range selects nothing
            out += rows[max(0, int(a) - 1):(int(b) if b else len(rows)) if dots else int(a)] if int(a) or dots else []
        rows = out
    if tags:
        out, inside = [], False
        for row in rows:
            mark = row.strip()
            if mark in (f"// tag::{tags}[]", f"// end::{tags}[]"):
                inside = mark.startswith("// tag")
            elif inside:
                out.append(row)
        rows = out
    return rows


def scanned(path: str, text: str, lines: str, tags: str, attributes: dict[str, str]) -> Iterator[tuple]:
    """(kind, text, target, target lines, target tags, offset) of what is left of a unit, in order."""
    closed, base = [], posixpath.dirname(path)
    for row in selected(text.split("\n"), lines, tags):
        mark = row.strip()
        if found := CONDITION.match(mark):
            closed.append((found[2] in attributes) != (found[1] == "ifdef"))
        elif found := EVALUATED.match(mark):
            closed.append(not holds(found[1], attributes))
        elif mark.startswith("endif::"):
            if closed:
                closed.pop()
        elif any(closed):
            continue
        elif found := INCLUDE.match(mark):
            said = dict(x.strip().partition("=")[::2] for x in found[2].split(";"))
            value = {k: v.strip('"') for k, v in said.items()}
            offset = value.get("leveloffset", "0")
            target = posixpath.normpath(posixpath.join(base, found[1].strip()))
            yield ("include", mark, target, value.get("lines", ""), value.get("tags", ""), int(offset) if re.fullmatch(r"[+-]?\d+", offset) else 0)
        elif re.match(r"^=+\s+\S", mark):
            yield ("heading", mark, None, None, None, 0)
        else:
            yield ("line", re.sub(r"\{([\w-]+)\}", lambda m: attributes.get(m[1], m[0]), row), None, None, None, 0)


def _items(units: DataFrame, files: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """What is left of each unit (path, lines, tags) that there is a file (path, text) for; an empty one is kept as such."""
    names = [*UNIT, "at", "kind", "text", "target", "t_lines", "t_tags", "offset"]
    kinds = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def run(batches):
        for batch in batches:
            for path, lines, tags, text in zip(*(batch.column(n).to_pylist() for n in [*UNIT, "text"])):
                rows = [(path, lines, tags, at, *x) for at, x in enumerate(scanned(path, text or "", lines, tags, attributes), 1)]
                rows.append((path, lines, tags, 0, "there", None, None, None, None, 0))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
    schema = "path string, lines string, tags string, at int, kind string, text string, target string, t_lines string, t_tags string, offset int"
    return units.join(files.select("path", "text"), "path").select(*UNIT, "text").mapInArrow(run, schema)


def spliced(files: DataFrame, roots: DataFrame, attributes: dict[str, str] | None = None) -> DataFrame:
    """(root, position, kind, text, path) of the lines of each root (path) with all it includes from ``files`` (path, text).

    Kinds: line and heading (at most level 6, moved by the includes' offsets, never below none), and instead of what
    can't be spliced one row each with the path: ``cycle`` for a file that is being included already, ``missing``,
    and ``outside`` for one that is not under the root's folder. Paths are unique (refused otherwise); a root without a
    file is ``missing``, nulls are left out, and a null text is empty.
    """
    attributes = attributes or {}
    files = files.where("path is not null")
    if files.groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError("paths of files must be unique")
    units = roots.where("path is not null").select("path", F.lit("").alias("lines"), F.lit("").alias("tags")).distinct()
    items = written(_items(units, files, attributes), "items")
    open_rows = units.select(c("path").alias("root"), F.array().cast("array<int>").alias("key"), F.array().cast("array<string>").alias("chain"), F.lit(0).alias("level"), c("path").alias("target"), c("lines").alias("t_lines"), c("tags").alias("t_tags"))
    parts, base = [], F.regexp_replace("root", "[^/]*$", "")
    row = ["root", "key", "kind", "text", "path", "level"]
    while True:
        stop = F.when(F.array_contains("chain", c("target")), "cycle").when(~c("target").startswith(base), "outside")
        asked = written(open_rows.withColumn("stop", stop), "asked")
        whole = asked.where("stop is null")
        new = whole.select(c("target").alias("path"), c("t_lines").alias("lines"), c("t_tags").alias("tags")).distinct().join(items.select(*UNIT).distinct(), UNIT, "left_anti")
        items = items.unionByName(written(_items(new, files, attributes), "items"))
        have = items.select(c("path").alias("target"), c("lines").alias("t_lines"), c("tags").alias("t_tags"), c("at").alias("i_at"), c("kind").alias("i_kind"), c("text").alias("i_text"), c("offset").alias("i_offset"),
                            c("target").alias("i_target"), c("t_lines").alias("i_lines"), c("t_tags").alias("i_tags"))
        met = written(whole.join(have, ["target", "t_lines", "t_tags"], "left"), "met")
        said = F.coalesce("stop", F.lit("missing"))
        lost = asked.where("stop is not null").select("root", "key", said.alias("kind"), c("target").alias("text"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), "chain"), -1).alias("path"), "level")
        lost = lost.unionByName(met.where("i_kind is null").select("root", "key", F.lit("missing").alias("kind"), c("target").alias("text"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), "chain"), -1).alias("path"), "level"))
        key = F.array_append("key", c("i_at"))
        parts += [lost, met.where("i_kind in ('line', 'heading')").select("root", key.alias("key"), c("i_kind").alias("kind"), c("i_text").alias("text"), c("target").alias("path"), "level")]
        open_rows = met.where("i_kind = 'include'").select("root", key.alias("key"), F.array_append("chain", c("target")).alias("chain"), F.greatest(c("level") + c("i_offset"), F.lit(0)).alias("level"), c("i_target").alias("target"), c("i_lines").alias("t_lines"), c("i_tags").alias("t_tags"))
        if not open_rows.limit(1).count():
            break
    out = parts[0].select(*row)
    for p in parts[1:]:
        out = out.unionByName(p.select(*row))
    marks = F.length(F.regexp_extract("text", "^(=+)", 1))
    moved = F.concat(F.repeat(F.lit("="), F.least(marks + c("level"), F.lit(6))), F.lit(" "), F.regexp_extract("text", r"^=+\s+(.*)$", 1))
    place = F.row_number().over(W.partitionBy("root").orderBy("key"))
    return out.select("root", place.cast("long").alias("position"), "kind", F.when(c("kind") == "heading", moved).otherwise(c("text")).alias("text"), "path")
