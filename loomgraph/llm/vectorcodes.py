"""Vector compression: parts of a vector become the numbers of their nearest codebook entries, in whole numbers.

Codebooks are learned in rounds over all vectors: a round is one pass whose tasks add up the parts of each
entry, and whose result is a bounded table (parts x entries x their width). Distances are exact integers.
Most are never computed: an entry's distance to a part is bounded from below by segment means and residual
norms. For a segment of n components with sums S and residual norms R (what is left of the squares beside the
mean), |x - e|^2 >= (S_x - S_e)^2 / n + (R_x - R_e)^2. Segments are halved from level to level, so bounds grow;
entries whose bound is beyond the best exact distance known go, and the survivors get their exact distance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, table, with_values


@dataclass(frozen=True)
class Codes:
    """``scale``: a component x becomes floor(scale x). ``levels``: how often segments are halved at most."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    levels: int = 2


DEFAULT = Codes()


def limit(width: int) -> int:
    """Components beyond this (as whole numbers) count as this: then no squared distance leaves 64 bits."""
    return int((2**62 / max(1, width)) ** 0.5) // 2


def cuts(width: int, parts: int) -> list[int]:
    """Where parts begin, and the end: equal ones where ``parts`` divides the width."""
    return [i * width // parts for i in range(parts + 1)]


def _segments(width: int, levels: int) -> list[list[tuple[int, int]]]:
    """Segments of each level, from the whole part on, down to two components."""
    out = [[(0, width)]]
    while len(out) <= levels and all(b - a >= 4 for a, b in out[-1]):
        out.append([s for a, b in out[-1] for s in ((a, (a + b) // 2), ((a + b) // 2, b))])
    return out


class _Shape:
    """Segment sums and residual norms of rows, level by level."""

    def __init__(self, rows: np.ndarray, segments: list[list[tuple[int, int]]]):
        x = rows.astype(np.float64)
        self.levels = []
        for level in segments:
            means, norms = [], []
            for a, b in level:
                s = x[:, a:b].sum(axis=1)
                means.append(s / (b - a) ** 0.5)
                norms.append(np.sqrt(np.square(x[:, a:b] - (s / (b - a))[:, None]).sum(axis=1)))
            self.levels.append((np.stack(means, 1), np.stack(norms, 1)))


def nearest(rows: np.ndarray, book: np.ndarray, levels: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, exact squared distance) of each row (whole numbers, within ``limit``), ties to the lower entry, and
    the number of exact distances computed. Bounds are floating and lowered by more than they can be wrong."""
    n, k = len(rows), len(book)
    segments = _segments(rows.shape[1], levels)
    x, e = _Shape(rows, segments), _Shape(book, segments)
    (mx, nx), (me, ne) = x.levels[0], e.levels[0]
    low = np.square(mx - me.T) + np.square(nx - ne.T)
    seed = low.argmin(axis=1)
    best = np.square(rows - book[seed]).sum(axis=1)
    exact = np.full((n, k), np.iinfo(np.int64).max)
    exact[np.arange(n), seed] = best
    # Doubles are off by parts in 10**15 of the squares that go into a bound; it may be too high by no more than this.
    slack = 1.0 + 1e-9 * ((np.square(mx) + np.square(nx)).sum(axis=1) + float((np.square(me) + np.square(ne)).max(initial=0.0)))
    allowed = best * (1 + 1e-9) + slack
    keep = low <= allowed[:, None]
    keep[np.arange(n), seed] = False
    i, j = np.nonzero(keep)
    for (mx, nx), (me, ne) in zip(x.levels[1:], e.levels[1:]):
        bound = np.square(mx[i] - me[j]).sum(axis=1) + np.square(nx[i] - ne[j]).sum(axis=1)
        left = bound <= allowed[i]
        i, j = i[left], j[left]
    exact[i, j] = np.square(rows[i] - book[j]).sum(axis=1)
    entry = exact.argmin(axis=1)
    return entry, exact[np.arange(n), entry], n + len(i)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole_numbers(vectors: DataFrame, p: Codes) -> tuple[DataFrame, int]:
    """(vec_id, label, x array<long>) of the rows that can be coded, written, and their width."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(sound).select("vec_id", "label", x.alias("x"))
    widths = kept.groupBy(F.size("x").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    width = int(widths["w"]) if widths else 0
    top = float(limit(width))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), v * p.scale))))
    return durable(kept.where(F.size("x") == width).select("vec_id", "label", whole.alias("x")), "whole-vectors"), width


def learn(rows: DataFrame, width: int, p: Codes = DEFAULT) -> list[np.ndarray]:
    """The codebooks of the parts. They begin as the parts of the smallest ids (then by content; null ids last)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(p.entries).collect()
    edge = cuts(width, p.parts)
    start = np.array([r.x for r in first], np.int64).reshape(len(first), width)
    books = [start[:, a:b] for a, b in zip(edge, edge[1:])]
    for _ in range(p.rounds if len(first) else 0):
        now = books

        def add(batches):
            sums, counts = [np.zeros(b.shape, np.int64) for b in now], [np.zeros(len(b), np.int64) for b in now]
            for batch in batches:
                x = _matrix(batch.column(0), width)
                for k, book in enumerate(now):
                    part = x[:, edge[k]:edge[k + 1]]
                    entry, _, _ = nearest(part, book, p.levels)
                    np.add.at(sums[k], entry, part)
                    counts[k] += np.bincount(entry, minlength=len(book))
            flat = np.concatenate([np.concatenate([s.ravel(), c]) for s, c in zip(sums, counts)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["slot", "n"])
        size = sum(b.size + len(b) for b in now)
        found = np.zeros(size, object)
        # Added up as decimals: sums of sums could leave 64 bits.
        for r in rows.select("x").mapInArrow(add, "slot long, n long").groupBy("slot").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect():
            found[r[0]] = int(r[1])
        books, at = [], 0
        for old in now:
            sums = found[at:at + old.size].reshape(old.shape)
            counts = found[at + old.size:at + old.size + len(old)]
            at += old.size + len(old)
            books.append(np.array([[int(s) // int(n) for s in row] if n else list(o) for row, n, o in zip(sums, counts, old)], np.int64).reshape(old.shape))
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, width: int, books: list[np.ndarray], p: Codes = DEFAULT) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances of all parts added up."""
    edge = cuts(width, p.parts)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            code, error = np.zeros((len(x), p.parts), np.uint8), np.zeros(len(x), np.int64)
            for k, book in enumerate(books):
                entry, far, _ = nearest(x[:, edge[k]:edge[k + 1]], book, p.levels)
                code[:, k] = entry
                error += far
            text = code.tobytes().hex()
            w = 2 * p.parts
            digits = pa.array([text[i * w:(i + 1) * w] for i in range(len(x))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), digits, pa.array(error)], ["vec_id", "label", "code", "error"])
    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, p: Codes = DEFAULT) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows of ``vectors`` (vec_id, embedding, label).

    Rows are dropped whose vector is null or empty, has a null or a component that is no finite number, or has not
    the width that most vectors have (ties: the smaller). Where ``parts`` doesn't divide the width, parts differ in
    width by one. Components beyond ``limit`` count as the limit. With fewer vectors than entries, codebooks are
    that short. Repeated rows are coded each; null ids come last among the first codebooks' rows; null labels are
    one label; an empty table gives no rows; further columns are ignored.
    """
    if p.entries > 256:
        raise ValueError("two hex digits number 256 entries")
    rows, width = whole_numbers(vectors.select("vec_id", "embedding", "label"), p)
    books = learn(rows, width, p)
    coded = durable(encode(rows, width, books, p), "codes")
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    out = with_values(coded, sums, "label", F.col("vec_id"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def codes_sql(p: Codes = DEFAULT, width: int = 64) -> str:
    """The same rows in SQL, for vectors of one width that ``parts`` divides: every distance is computed."""
    d = width // p.parts
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, [floor({p.scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT rid, k, x[k * {d} + 1:k * {d} + {d}] AS v FROM kept, range({p.parts}) r(k)),
first AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept QUALIFY e < {p.entries}),
book0 AS MATERIALIZED (SELECT k, e, v FROM part JOIN first USING (rid))"""]
    near = "SELECT rid, p.k, arg_min(e, (list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(p.v, b.v)]), e)) AS e{more} FROM part p JOIN book{r} b USING (k) GROUP BY rid, p.k"
    for r in range(p.rounds):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(more='', r=r)})")
        sums = ", ".join(f"((sum(v[{i + 1}]) - ((sum(v[{i + 1}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in range(d))
        steps.append(f"mean{r} AS (SELECT k, e, [{sums}] AS v FROM part JOIN near{r} USING (rid, k) GROUP BY k, e)")
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT k, e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (k, e))")
    last = near.format(more=", min(list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(p.v, b.v)])) AS far", r=p.rounds)
    steps.append(f"last AS MATERIALIZED ({last})")
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM book{p.rounds})")
    steps.append("coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY k) AS code, sum(far)::BIGINT AS error FROM last GROUP BY rid)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books"


OP12_SQL = codes_sql()
