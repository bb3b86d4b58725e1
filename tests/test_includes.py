"""Included files against a recursive walk; selectors; what can't be spliced; totals beside a first few rows."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import spans
from loomgraph.sources import includes


def walk(files, root, attributes):
    """(kind, text, path) by recursion, one file inside the other."""
    base = root.rsplit("/", 1)[0] + "/" if "/" in root else ""

    def go(path, lines, tags, chain, level):
        for kind, text, target, t_lines, t_tags, offset in includes.scanned(path, files[path] or "", lines, tags, attributes):
            if kind == "heading":
                marks, title = text.split(None, 1)
                yield kind, "=" * min(6, len(marks) + level) + " " + title, path
            elif kind == "line":
                yield kind, text, path
            elif target in [*chain, path]:
                yield "cycle", target, path
            elif not target.startswith(base):
                yield "outside", target, path
            elif target not in files:
                yield "missing", target, path
            else:
                yield from go(target, t_lines, t_tags, [*chain, path], max(0, level + offset))
    return list(go(root, "", "", [], 0)) if root in files else [("missing", root, None)]


def test_included_as_by_recursion(spark):
    rng = random.Random(11)
    names = [f"d/{'s/' if i % 3 == 0 else ''}f{i}.adoc" for i in range(14)]
    files = {}
    for i, n in enumerate(names):
        rows = []
        for k in range(rng.randint(0, 9)):
            other = rng.choice(names[max(0, i - 1):]) if rng.random() < 0.9 else rng.choice(["d/none.adoc", "else/x.adoc"])
            path = posixpath.relpath(other, posixpath.dirname(n))
            rows.append(rng.choice([f"line {k} {{a}} {{z}}", f"== Head {k}", f"include::{path}[]", f"include::{path}[lines=2..4;leveloffset=1]", f"include::{path}[tags=t]",
                                    "ifdef::a[]", "ifndef::a[]", 'ifeval::[{a} == "1"]', "ifeval::[{a} > 3]", "endif::[]", "// tag::t[]", "// end::t[]"]))
        files[n] = "\n".join(rows) if i else f"= Top\ninclude::../f1.adoc[]\ninclude::../f2.adoc[leveloffset=2]"
    files["d/null.adoc"] = None
    roots = [*names, "d/null.adoc", "d/gone.adoc"]
    attributes = {"a": "1"}
    frame = spark.createDataFrame(list(files.items()) + [(None, "x")], "path string, text string")
    got = {}
    for r in includes.spliced(frame, spark.createDataFrame([(r,) for r in roots] + [(roots[0],), (None,)], "path string"), attributes).orderBy("root", "position").collect():
        assert r.position == len(got.setdefault(r.root, [])) + 1
        got[r.root].append((r.kind, r.text, r.path))
    want = {r: rows for r in roots if (rows := walk(files, r, attributes))}
    assert got == want
    assert {k for rows in want.values() for k, _, _ in rows} == {"line", "heading", "cycle", "missing", "outside"}


@pytest.mark.parametrize("lines, tags, want", [
    ("", "", "abcdef"), ("2..3", "", "bc"), ("5..", "", "ef"), ("1,4..4,9", "", "ad"), ("0", "", ""), ("x", "", ""), ("0..2", "", "ab"), ("3..2", "", ""),
])
def test_selected_lines(lines, tags, want):
    assert "".join(includes.selected(list("abcdef"), lines, tags)) == want


def test_conditions():
    a = {"v": "10", "s": "x"}
    assert includes.holds('{s} == "x"', a) and includes.holds("{v} >= 9", a) and includes.holds('{none} != "x"', a)
    assert not includes.holds("{s} > 1", a) and not includes.holds("nothing", a) and not includes.holds("{v} < 9.5", a)


def test_paths_must_be_unique(spark):
    with pytest.raises(ValueError):
        includes.spliced(spark.createDataFrame([("a", "x"), ("a", "y")], "path string, text string"), spark.createDataFrame([("a",)], "path string"))
    none = spark.createDataFrame([], "path string, text string")
    assert includes.spliced(none, none).count() == 0


def test_first_rows_and_all_of_them_from_one_pass(spark, sf, tmp_path):
    rows = spark.range(0, 5000, 1, 7).where("id % 3 = 0")
    top, total = spans.counted_top(rows, [F.col("id").desc()], 4)
    assert total == rows.count() and sorted(r.id for r in top.collect()) == [4989, 4992, 4995, 4998]
    assert spans.counted_top(rows.where("false"), [F.col("id")], 4)[1] == 0


def test_totals_are_exact_when_tasks_fail_and_run_again(tmp_path):
    """In a session of its own: tasks may fail there once, and the rows of the failed attempt are not counted."""
    import subprocess
    import sys
    script = f"""
import os, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from loomgraph.operators import spans
s = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
def once(frames):
    from pyspark import TaskContext
    mark = "{tmp_path}/failed-" + str(TaskContext.get().partitionId())
    for f in frames:
        yield f
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost")
rows = s.range(0, 1000, 1, 4).mapInPandas(once, "id long")
top, total = spans.counted_top(rows, [F.col("id")], 3)
print("TOTAL", total, sorted(r.id for r in top.collect()))
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "TOTAL 1000 [0, 1, 2]" in done.stdout, done.stderr[-2000:]
