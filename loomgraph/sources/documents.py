"""Files as documents and documents as files: a data source of its own, ``loom_documents``, to read, stream and write.

    register(spark)
    spark.read.format("loom_documents").load(folder)
    spark.readStream.format("loom_documents").load(folder)
    documents.write.format("loom_documents").mode("overwrite").save(folder)

Reading: extractors make documents of a file, chosen by its name's ending; of those that take an ending the one
registered last does. Files are dealt to tasks by size. A schema that names fewer columns is a projection: only those
are made. Writing: a task writes one file under a temporary name; the job's commit gives the files their names, by
partition number, and writes a manifest with their counts and digests; an aborted job deletes what its tasks wrote.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, anchor string, node_type string, line int, text string, attributes map<string,string>"
KINDS = {"path": pa.string(), "anchor": pa.string(), "node_type": pa.string(), "line": pa.int32(), "text": pa.string(), "attributes": pa.map_(pa.string(), pa.string())}
#: Bytes of files that a task reads, about; a larger file is one task's.
TASK_BYTES = 32 << 20


@dataclass
class Document:
    anchor: str | None
    node_type: str | None
    line: int
    text: str | None
    attributes: dict[str, str | None] | None = field(default_factory=dict)


class Extractor:
    """One file, many documents. ``endings``: those of the file names it takes."""

    endings: tuple[str, ...] = ()

    def documents(self, path: str, lines: Iterator[str]) -> Iterator[Document]:
        raise NotImplementedError


class Paragraphs(Extractor):
    """Plain text: a document for each run of lines that aren't blank."""

    endings = (".txt", ".text")

    def documents(self, path, lines):
        stem, held, first, n = os.path.basename(path), [], 0, 0
        for at, line in enumerate([*lines, ""], 1):
            if line.strip():
                first = first if held else at
                held.append(line)
            elif held:
                n += 1
                yield Document(f"{stem}#p{n}", "Paragraph", first, "\n".join(held))
                held = []


class Headings(Extractor):
    """Light markup: a document for each heading (= or #), named by its text; what stands before the first is the file's."""

    endings = (".md", ".markdown")

    def documents(self, path, lines):
        stem = os.path.basename(path)
        now = Document(stem, "Module", 1, "")
        for at, line in enumerate(lines, 1):
            mark = line.split(" ", 1)
            if len(mark) == 2 and mark[0] and len(mark[0]) <= 6 and set(mark[0]) in ({"#"}, {"="}):
                yield now
                now = Document(f"{stem}#{'-'.join(mark[1].lower().split())}", "Section", at, "", {"level": str(len(mark[0])), "title": mark[1].strip()})
            else:
                now.text += ("\n" if now.text else "") + line
        yield now


class Emitted(Extractor):
    """What ``DocumentWriter`` writes as markup; gives back the documents as they were."""

    endings = (".loom.adoc",)

    def documents(self, path, lines):
        now, body = None, []
        for at, line in enumerate(lines, 1):
            if line.startswith("=="):
                if now:
                    now.text = "\n".join(body) if now.text is not None else None
                    yield now
                anchor, kind, absent = json.loads(line[3:])
                now, body = Document(anchor, kind, at, None if "text" in absent else "", None if "attributes" in absent else {}), []
            elif line.startswith(":"):
                name, value = json.loads(line[1:])
                now.attributes[name] = value
            elif line.startswith("  "):
                body.append(line[2:])
        if now:
            now.text = "\n".join(body) if now.text is not None else None
            yield now


def emit(d: Document) -> str:
    """A document as markup: a heading with its anchor and kind, its attributes, its text indented by two."""
    absent = [n for n in ("text", "attributes") if getattr(d, n) is None]
    head = [f"== {json.dumps([d.anchor, d.node_type, absent])}"] + [f":{json.dumps([k, v])}" for k, v in (d.attributes or {}).items()]
    return "\n".join(head + ([] if d.text is None else [f"  {x}" for x in d.text.split("\n")])) + "\n"


#: What every session has; ``register`` adds to it.
BUILT_IN: tuple[Extractor, ...] = (Paragraphs(), Headings(), Emitted())


def extractor_of(path: str, registered: tuple[Extractor, ...]) -> Extractor | None:
    return next((e for e in reversed(registered) if path.endswith(e.endings)), None)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _lines(raw) -> Iterator[str]:
    """Lines of a file as they come, cut at newlines only."""
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def _listing(system: fs.FileSystem, base: str, registered: tuple[Extractor, ...]) -> list[fs.FileInfo]:
    """Files that an extractor takes, without those whose name or folder begins with a dot or an underscore."""
    if system.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(base)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(base):].strip("/").split("/"))]
    return sorted((f for f in shown if extractor_of(f.path, registered)), key=lambda f: f.path)


def _dealt(files: list[fs.FileInfo], task_bytes: int) -> list[Files]:
    out, held, size = [], [], 0
    for f in files:
        if held and size + f.size > task_bytes:
            out.append(Files(held))
            held, size = [], 0
        held.append(f.path)
        size += f.size
    return out + ([Files(held)] if held else [])


class _Reading:
    """What batch and stream share: making rows of a task's files."""

    def __init__(self, root: str, names: list[str], registered: tuple[Extractor, ...], task_bytes: int):
        self.root, self.names, self.registered, self.task_bytes = root, names, registered, task_bytes

    def rows(self, files: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        held, size = {n: [] for n in self.names}, 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if n == "attributes" and v is not None else v for v in held[n]], KINDS[n]) for n in self.names], self.names)
        for path in files.paths:
            with system.open_input_stream(path, compression=None) as raw:
                for d in extractor_of(path, self.registered).documents(path, _lines(raw)):
                    for n in self.names:
                        held[n].append(path if n == "path" else getattr(d, n))
                    size += 64 + len(d.text or "")
                    if size >= 4 << 20:
                        yield batch()
                        held, size = {n: [] for n in self.names}, 0
        if size:
            yield batch()


class DocumentReader(DataSourceReader, _Reading):
    def partitions(self):
        system, base = fs.FileSystem.from_uri(self.root)
        return _dealt(_listing(system, base, self.registered), self.task_bytes) or [Files([])]

    def read(self, partition):
        yield from self.rows(partition)


class DocumentStream(DataSourceStreamReader, _Reading):
    """Files in the order of their times, then names. An offset is the last file's: a file belongs to the batch it came
    in, on every attempt. Files must be complete, and no older than those read, when they appear (written, then moved)."""

    def _new(self, after: list | None, upto: list | None) -> list[fs.FileInfo]:
        system, base = fs.FileSystem.from_uri(self.root)
        key = lambda f: [f.mtime_ns, f.path]
        return sorted((f for f in _listing(system, base, self.registered) if (not after or key(f) > after) and (upto is None or key(f) <= upto)), key=key)

    def initialOffset(self):
        return {"last": []}

    def latestOffset(self):
        found = self._new(None, None)
        return {"last": [found[-1].mtime_ns, found[-1].path] if found else []}

    def partitions(self, start, end):
        return _dealt(self._new(start["last"], end["last"]), self.task_bytes) if end["last"] else []

    def read(self, partition):
        yield from self.rows(partition)

    def commit(self, end):
        pass


@dataclass
class Written(WriterCommitMessage):
    partition: int
    temporary: str
    documents: int
    size: int
    sha256: str


class DocumentWriter(DataSourceArrowWriter):
    """Each partition becomes ``part-<number>.loom.adoc`` (no rows: no file); ``_manifest.json`` follows when all are there."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    def begin(self) -> DocumentWriter:
        """Makes the job's folder. Tasks never do: one that still runs when its job is aborted must not bring it back."""
        system, base = self._at()
        system.create_dir(f"{base}/_tmp-{self.job}", recursive=True)
        return self

    def write(self, iterator):
        at = TaskContext.get()
        system, base = self._at()
        temporary = f"{base}/_tmp-{self.job}/{at.partitionId()}-{at.taskAttemptId()}"
        n, size, digest, out = 0, 0, hashlib.sha256(), None
        try:
            for batch in iterator:
                for r in batch.select([c for c in ("anchor", "node_type", "text", "attributes") if c in batch.schema.names]).to_pylist():
                    attributes = r.get("attributes")
                    text = emit(Document(r.get("anchor"), r.get("node_type"), 0, r.get("text"), None if attributes is None else dict(attributes))).encode()
                    if out is None:
                        out = system.open_output_stream(temporary, compression=None)
                    out.write(text)
                    digest.update(text)
                    n, size = n + 1, size + len(text)
        except BaseException:
            if out is not None:
                out.close()
                if system.get_file_info(temporary).type == fs.FileType.File:
                    system.delete_file(temporary)
            raise
        if out is not None:
            out.close()
        return Written(at.partitionId(), temporary if n else "", n, size, digest.hexdigest())

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        for again in (True, True, True, False):
            try:
                if system.get_file_info(f"{base}/_tmp-{self.job}").type != fs.FileType.NotFound:
                    system.delete_dir(f"{base}/_tmp-{self.job}")
                return
            except OSError:  # a task began a file, or took its own away, meanwhile
                if not again:
                    raise
                time.sleep(0.2)

    def commit(self, messages):
        system, base = self._at()
        manifest, made = f"{base}/_manifest.json", []
        old = []
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                old = json.loads(f.read())
            if not self.overwrite:
                raise FileExistsError(f"{self.root} has documents; mode overwrite takes their place")
            system.delete_file(manifest)
        for m in sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.partition):
            name = f"part-{m.partition:05d}.loom.adoc"
            if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                system.delete_file(f"{base}/{name}")
            system.move(m.temporary, f"{base}/{name}")
            made.append({"file": name, "documents": m.documents, "bytes": m.size, "sha256": m.sha256})
        for gone in {f["file"] for f in old} - {f["file"] for f in made}:
            if system.get_file_info(f"{base}/{gone}").type == fs.FileType.File:
                system.delete_file(f"{base}/{gone}")
        self._clear(system, base)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(manifest) as f:
            f.write(json.dumps(made, indent=1).encode())

    def abort(self, messages):
        system, base = self._at()
        self._clear(system, base)


class DocumentSource(DataSource):
    registered: tuple[Extractor, ...] = BUILT_IN

    @classmethod
    def name(cls) -> str:
        return "loom_documents"

    def schema(self) -> str:
        return SCHEMA

    def _how(self, schema: StructType) -> tuple:
        unknown = [n for n in schema.names if n not in KINDS]
        if unknown:
            raise ValueError(f"documents have no {', '.join(unknown)}")
        path = self.options["path"]
        return path if "://" in path or path.startswith("file:") else f"file://{path}", schema.names, self.registered, int(self.options.get("taskBytes", TASK_BYTES))

    def reader(self, schema):
        return DocumentReader(*self._how(schema))

    def streamReader(self, schema):
        return DocumentStream(*self._how(schema))

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options["path"] if "://" in self.options["path"] else f"file://{self.options['path']}", overwrite).begin()


def register(spark: SparkSession, *extractors: Extractor) -> None:
    """Make ``loom_documents`` known to a session, with ``extractors`` after (and so before) the built-in ones. They
    travel with the class to where files are read; registering again takes the place of what was registered."""
    class Registered(DocumentSource):
        registered = (*BUILT_IN, *extractors)
    spark.dataSource.register(Registered)
