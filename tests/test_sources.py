"""The document source and sink: round trips, projections, registration, streams, failed writes."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.sources import documents as D

ROWS = [
    ("a", "Note", "plain\n\n== [not a heading]\n:no attribute\n  indented\ttext \r\n", {"k": "v", "odd": "a\"b: \n c"}),
    ("b", None, None, None), (None, "Note", "", {}), ("d", "x", "\n", {"none": None}), ("é あ", "Note", "word " * 50_000, {"lang": "ü"}), ("a", "Note", "again", {}),
]
SCHEMA = "anchor string, node_type string, text string, attributes map<string,string>"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    D.register(spark)


def _key(r):
    return (r.anchor or "", r.node_type or "", repr(r.text), repr(r.attributes))


def test_documents_come_back_as_they_were(spark, tmp_path):
    out = f"{tmp_path}/out"
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.format("loom_documents").mode("overwrite").save(out)
    back = spark.read.format("loom_documents").schema(SCHEMA).load(out).collect()
    assert sorted(map(_key, back)) == sorted(map(_key, spark.createDataFrame(ROWS, SCHEMA).collect()))
    names = sorted(os.listdir(out))
    assert names[0] == "_manifest.json" and all(n.startswith("part-") for n in names[1:])


def test_writing_again(spark, tmp_path):
    out, table = f"{tmp_path}/out", spark.createDataFrame(ROWS, SCHEMA)
    table.repartition(4).write.format("loom_documents").mode("overwrite").save(out)
    table.limit(1).coalesce(1).write.format("loom_documents").mode("overwrite").save(out)
    assert spark.read.format("loom_documents").load(out).count() == 1 and len(os.listdir(out)) == 2
    with pytest.raises(Exception, match="overwrite"):
        table.write.format("loom_documents").mode("append").save(out)
    table.limit(0).write.format("loom_documents").mode("overwrite").save(out)
    assert spark.read.format("loom_documents").load(out).count() == 0 and os.listdir(out) == ["_manifest.json"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    os.mkdir(out)
    bad = spark.range(100).repartition(4).select(F.col("id").cast("string").alias("anchor"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("Note")).alias("node_type"), F.lit("t").alias("text"))
    with pytest.raises(Exception):
        bad.write.format("loom_documents").mode("overwrite").save(out)
    assert os.listdir(out) == []


def test_a_task_that_outlives_its_job_leaves_nothing(monkeypatch, tmp_path):
    """A killed task may still write when the job's folder is taken away."""
    monkeypatch.setattr(D, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    rows = pa.RecordBatch.from_pydict({"anchor": ["a"], "text": ["t"]})
    for before in ([], [rows]):
        writer = D.DocumentSource({"path": str(tmp_path)}).writer(None, True)

        def late(writer=writer, before=before):
            yield from before
            writer.abort([])
            yield rows
            raise RuntimeError("killed")
        with pytest.raises((RuntimeError, OSError)):
            writer.write(late())
        assert os.listdir(tmp_path) == []


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep" / "_hidden").mkdir(parents=True)
    (root / "a.txt").write_text("one\ntwo\n\n\nthree\n")
    (root / "deep" / "b.md").write_text("before\n# First Part\nbody\nmore\n## Second\n#none\n")
    (root / "deep" / "_hidden" / "c.txt").write_text("no")
    (root / "skipped.bin").write_bytes(b"\xff\x00")
    (root / "empty.txt").write_text("")
    return str(root)


def test_files_become_documents(spark, folder):
    got = {r.anchor: (r.node_type, r.line, r.text) for r in spark.read.format("loom_documents").option("taskBytes", 1).load(folder).collect()}
    assert got == {"a.txt#p1": ("Paragraph", 1, "one\ntwo"), "a.txt#p2": ("Paragraph", 5, "three"), "b.md": ("Module", 1, "before"),
                   "b.md#first-part": ("Section", 2, "body\nmore"), "b.md#second": ("Section", 5, "#none")}


def test_only_named_columns_are_made(spark, folder):
    reader = D.DocumentReader(f"file://{folder}", ["line", "anchor"], D.BUILT_IN, D.TASK_BYTES)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert batches and all(b.schema.names == ["line", "anchor"] for b in batches)
    assert spark.read.format("loom_documents").schema("anchor string").load(folder).columns == ["anchor"]
    with pytest.raises(Exception, match="no such"):
        spark.read.format("loom_documents").schema("`such` string").load(folder).collect()


def test_the_last_registered_extractor_wins(spark, folder):
    class Whole(D.Extractor):
        endings = (".txt",)

        def documents(self, path, lines):
            yield D.Document("whole", "Text", 1, "|".join(lines))
    class Later(Whole):
        def documents(self, path, lines):
            yield D.Document("later", "Text", 1, "|".join(lines))
    try:
        D.register(spark, Whole(), Later())
        rows = spark.read.format("loom_documents").load(folder).where("anchor = 'later'").collect()
    finally:
        D.register(spark)
    assert spark.read.format("loom_documents").load(folder).where("anchor = 'later'").count() == 0
    assert sorted(r.text for r in rows) == ["", "one|two|||three"]


def test_a_stream_takes_each_file_once(spark, folder, tmp_path):
    at, seen = str(tmp_path / "at"), []

    def run():
        stream = spark.readStream.format("loom_documents").load(folder)
        stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.anchor for r in df.collect())).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    run()
    assert len(seen) == 5
    with open(f"{folder}/z.txt.tmp", "w") as f:
        f.write("new\n")
    os.rename(f"{folder}/z.txt.tmp", f"{folder}/z.txt")
    run()
    assert sorted(seen)[-1] == "z.txt#p1" and len(seen) == 6
