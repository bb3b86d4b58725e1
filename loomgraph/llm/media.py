"""Media columns: cropped or edited copies of images by local descriptors.

Corners are found at several scales (Harris response, the strongest of each cell, so their number grows
with the image). Around each, a patch is turned to its intensity centroid, and 96 binary intensity tests
make a descriptor. Descriptors meet in three Hamming tables, one for each 32-bit block: two that differ
in at most two bits are sure to meet, others may. Whatever meets is compared: a match is at most
``distance`` of the 96 bits away. A block that an image has at several places is filed at the first.

The matches of two images vote for a shift at a scale and a turn, in half-overlapping bins. ``votes``
different table entries in one bin are a geometric consensus, hence a link. Components of the links follow.

Every pair of images that shares an entry can vote, and every pair with a consensus is a link. An entry with
at most ``direct`` images gives all its pairs at once. Where entries have more, pairs are first sought: two images
need ``votes`` common entries, so each leaves out its ``votes`` - 1 most frequent ones, and no pair is lost; each
pair found is then voted on by all entries of both, in tiles. Equal media are one node throughout. What travels is
packed by bucket: a row is a block of entries, about 18 bytes each, not an entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, remove, shuffle_partitions, table
from loomgraph.llm.components import components

TABLES = 3
#: Offset of the packed shifts: they are within 2**25 pixels.
MID = 1 << 25
#: Entries are sent on when so many are held; media bytes that one bucket stands for.
FLUSH, BUCKET_BYTES = 400_000, 16 << 20


@dataclass(frozen=True)
class Descriptors:
    """``cell``: pixels of a cell with at most one corner, a multiple of 4; ``scales``: halvings, at most 4;
    ``patch``: radius of a patch; ``turns``: steps of orientation, at most 16; ``bin``: pixels of a vote;
    ``votes``: entries of a consensus (an unchanged corner has three); ``distance``: bits by which a match
    may differ; ``direct``: images of an entry that are all paired at once (results don't depend on it); ``blur``:
    tests compare 3 x 3 means and not single pixels."""

    cell: int = 32
    scales: int = 2
    patch: int = 12
    turns: int = 12
    bin: int = 16
    votes: int = 9
    distance: int = 12
    direct: int = 16
    blur: bool = True


DEFAULT = Descriptors()
#: For pictures of pages, whose words are four pixels wide; every pixel tells words apart.
PAGES = Descriptors(cell=16, patch=6, bin=8, blur=False)


def encode_pgm(image: np.ndarray) -> bytes:
    """An 8-bit grey image (rows x columns) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decode_pgm(media: bytes | None) -> np.ndarray:
    """Rows x columns; an empty image for null, empty or damaged media."""
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", media or b"")
    if not m or int(m[3]) > 255:
        return np.zeros((0, 0), np.uint8)
    w, h = int(m[1]), int(m[2])
    raw = np.frombuffer(media, np.uint8, offset=m.end())
    return raw[: w * h].reshape(h, w) if len(raw) >= w * h else np.zeros((0, 0), np.uint8)


@lru_cache(maxsize=4)
def _pattern(p: Descriptors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 96 test pairs at each turn (turns x 96 x 2 x 2, rows and columns), and a patch's offsets."""
    rng = np.random.default_rng(11)
    pts = np.clip(rng.normal(0, p.patch / 2.2, (96, 2, 2)), -p.patch * 0.7, p.patch * 0.7)
    a = 2 * np.pi * np.arange(p.turns) / p.turns
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], -1), np.stack([-np.sin(a), np.cos(a)], -1)], -2)
    y, x = np.mgrid[-p.patch: p.patch + 1, -p.patch: p.patch + 1]
    inside = y * y + x * x <= p.patch * p.patch
    return np.rint(np.einsum("tij,ksj->tksi", turn, pts)).astype(np.int64), y[inside], x[inside]


def _sum5(x: np.ndarray) -> np.ndarray:
    """Sums over 5 neighbours along the rows, in three additions."""
    two = x[:-1] + x[1:]
    out = two[:-3] + two[2:-1]
    out += x[4:]
    return out


def _box5(x: np.ndarray) -> np.ndarray:
    """Sums over 5 x 5 squares; two rows and columns less on every side."""
    return _sum5(np.ascontiguousarray(_sum5(x).T)).T


def _corners(smooth: np.ndarray, inside: np.ndarray, p: Descriptors) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where the Harris response is the greatest within half a cell on every side, among the
    rows ``inside``. Nothing hangs on where an image begins, so a crop has the same corners."""
    gy, gx = smooth[2:, 1:-1] - smooth[:-2, 1:-1], smooth[1:-1, 2:] - smooth[1:-1, :-2]
    a, b, c = _box5(gx * gx), _box5(gy * gy), _box5(gx * gy)
    trace = a + b
    r = a * b
    r -= c * c
    r -= 0.05 * trace * trace
    edge = p.patch + 1 - 3  # three rows and columns of the edge without corners are gone already
    r = np.ascontiguousarray(r[:, edge: -edge])
    r[~inside[3:-3]] = -np.inf
    # Only the greatest of a small block can be the greatest of the square, and only if no block beside has a greater.
    (h, w), k = r.shape, p.cell // 4
    pad = np.full((-(-h // k) * k, -(-w // k) * k), -np.inf, np.float32)
    pad[:h, :w] = r
    rows, columns = pad.shape[0] // k, pad.shape[1] // k
    blocks = np.maximum.reduce(pad.reshape(rows, k, columns * k), axis=1).reshape(rows, columns, k).max(axis=2)
    around = np.full((rows + 2, columns + 2), -np.inf, np.float32)
    around[1:-1, 1:-1] = blocks
    near = np.maximum(np.maximum(around[:-2], around[1:-1]), around[2:])
    near = np.maximum(np.maximum(near[:, :-2], near[:, 1:-1]), near[:, 2:])
    i, j = np.nonzero((blocks >= near) & (blocks > 1.6e4))
    if not len(i):
        return i, j
    at = pad.reshape(rows, k, columns, k)[i, :, j, :].reshape(len(i), k * k).argmax(axis=1)
    y, x, step = i * k + at // k, j * k + at % k, np.arange(-(p.cell // 2), p.cell // 2 + 1)
    near_y, near_x = np.clip(y[:, None] + step, 0, h - 1), np.clip(x[:, None] + step, 0, w - 1)
    most = r.ravel()[near_y[:, :, None] * w + near_x[:, None, :]].reshape(len(i), -1).max(axis=1)
    keep = most <= r[y, x]
    return y[keep] + 3, x[keep] + p.patch + 1


def describe(images: list[np.ndarray], p: Descriptors = DEFAULT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one width: (image number, n x 4 row and column in full pixels, scale, turn; n x 3 blocks
    of 32 bits) of every corner. They are worked on as one tall image, which changes nothing but the time.

    A side too short to hold a corner is widened by a white margin, so a small image has corners too.
    """
    none = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros((0, TABLES), np.uint32)
    least, margin, unit = 2 * (p.patch + 1) + p.cell // 2, p.patch + 1, 1 << (p.scales - 1)
    if not images or not images[0].size:
        return none
    side = margin if images[0].shape[1] < least else 0
    top = np.array([margin if len(m) < least else 0 for m in images])
    height = np.array([len(m) for m in images]) + 2 * top
    begin = np.r_[0, np.cumsum(-(-height // unit) * unit)]
    img = np.full((begin[-1], images[0].shape[1] + 2 * side), 255, np.float32)
    for m, b, t in zip(images, begin, top):
        img[b + t: b + t + len(m), side: side + m.shape[1]] = m
    who, where, words = [], [], []
    pairs, py, px = _pattern(p)
    for scale in range(p.scales):
        h, w = img.shape
        start, size = begin[:-1] >> scale, height >> scale
        tall = size >= 2 * p.patch + 5
        if w < 2 * p.patch + 5 or not tall.any():
            break
        row = np.arange(h)
        of = np.searchsorted(start, row, side="right") - 1
        inside = tall[of] & (row - start[of] > p.patch) & (row - start[of] < size[of] - p.patch - 1)
        rows = img[:-2] + img[1:-1]
        rows += img[2:]
        smooth = np.zeros_like(img)
        inner = smooth[1:-1, 1:-1]
        np.add(rows[:, :-2], rows[:, 1:-1], out=inner)
        inner += rows[:, 2:]
        inner /= 9
        ys, xs = _corners(smooth, inside, p)
        for s in range(0, len(ys), 4096):
            y, x = ys[s:s + 4096], xs[s:s + 4096]
            # A corner is more than a patch from every edge, so all its tests are inside.
            flat, base = smooth.ravel(), (y * w + x)[:, None]
            patch = flat[base + (py * w + px)[None, :]]
            angle = np.arctan2(patch @ py, patch @ px)
            turn = np.rint(angle / (2 * np.pi / p.turns)).astype(np.int64) % p.turns
            tests = (pairs[..., 0] * w + pairs[..., 1])[turn]
            seen = flat if p.blur else img.ravel()
            bits = seen[base + tests[..., 0]] < seen[base + tests[..., 1]]
            words.append(np.packbits(bits, axis=1, bitorder="little").view("<u4"))
            who.append(of[y])
            where.append(np.column_stack([((y - start[of[y]]) << scale) - top[of[y]], (x << scale) - side, np.full(len(y), scale), turn]))
        h, w = h // 2 * 2, w // 2 * 2
        halves = img[0:h:2, :w] + img[1:h:2, :w]
        img = (halves[:, 0::2] + halves[:, 1::2]) / 4
    if not who:
        return none
    return np.concatenate(who), np.concatenate(where), np.concatenate(words).astype(np.uint32)


_HIDDEN = re.compile(r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]*>")


def render(html: str | None, columns: int = 16) -> np.ndarray:
    """A grey picture of a page's whole text: a 4 x 4 glyph a word, 16 words a row; empty without words."""
    words = _HIDDEN.sub(" ", html or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros((0, 0), np.uint8)
    raw = b"".join(map(xxhash.xxh3_128_digest, words)) + b"\xff" * (16 * (-len(words) % columns))
    cells = np.frombuffer(raw, np.uint8).reshape(-1, columns, 4, 4)
    return cells.transpose(0, 2, 1, 3).reshape(-1, columns * 4)


#: An entry of the Hamming tables: node, first two blocks and the third, row, column, 16 * scale + turn, table.
ENTRY = np.dtype([("node", "<u4"), ("b0", "<u4"), ("b1", "<u4"), ("b2", "<u4"), ("y", "<i4"), ("x", "<i4"), ("m", "u1"), ("table", "u1")])


def entries(who: np.ndarray, where: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The table entries of described images: one for each image, table and block, at its first place."""
    out = np.zeros(TABLES * len(who), ENTRY)
    for t in range(TABLES):
        x = out[t * len(who):(t + 1) * len(who)]
        x["node"], x["y"], x["x"], x["m"], x["table"] = who, where[:, 0], where[:, 1], where[:, 2] * 16 + where[:, 3], t
        for k in range(TABLES):
            x[f"b{k}"] = words[:, k]
    order = np.lexsort((out["x"], out["y"], out["m"] >> 4, token(out), out["node"]))
    out = out[order]
    at = token(out)
    first = np.r_[True, (at[1:] != at[:-1]) | (out["node"][1:] != out["node"][:-1])] if len(out) else np.zeros(0, bool)
    return out[first]


def token(x: np.ndarray) -> np.ndarray:
    """The table and the block that an entry is filed under."""
    t = x["table"] & 127
    block = np.where(t == 0, x["b0"], np.where(t == 1, x["b1"], x["b2"]))
    return (t.astype(np.int64) << 32) | block.astype(np.int64)


def shifts(a: np.ndarray, b: np.ndarray, p: Descriptors) -> np.ndarray:
    """The shift that turns entries a into b, packed: scale, turn, rows, columns."""
    sa, sb = (a["m"] >> 4).astype(np.int64), (b["m"] >> 4).astype(np.int64)
    ratio = np.exp2(sb - sa)
    dy = np.rint(b["y"] - a["y"] * ratio).astype(np.int64) + MID
    dx = np.rint(b["x"] - a["x"] * ratio).astype(np.int64) + MID
    dt = ((b["m"] & 15).astype(np.int64) - (a["m"] & 15)) % p.turns
    return ((sb - sa + 8) * 16 + dt) << 52 | dy << 26 | dx


def near(a: np.ndarray, b: np.ndarray, p: Descriptors) -> np.ndarray:
    """Whether entries are within the Hamming distance."""
    d = sum(np.bitwise_count(a[k] ^ b[k]).astype(np.int64) for k in ("b0", "b1", "b2"))
    return d <= p.distance


PACKED = "bucket int, digests binary, block binary, kind int, a binary, b binary, shift long, votes int, token long, y int, x int, m int, d0 long, d1 long"
_NAMES = [c.split()[0] for c in PACKED.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(**columns) -> pa.RecordBatch:
    """Rows of the packed schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    kinds = dict(c.split() for c in PACKED.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES[kinds[c]]) if c in columns else pa.nulls(n, _TYPES[kinds[c]]) for c in _NAMES], _NAMES)


def _planes(x: np.ndarray) -> bytes:
    """Entries as byte planes: high bytes, mostly zero, stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), ENTRY.itemsize).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY).ravel()


def _votes(x: np.ndarray, digests: list[bytes], p: Descriptors) -> Iterator[pa.RecordBatch]:
    """All pairs of the entries ``x``, sorted by token and node, of tokens with at most ``direct`` of them."""
    at = token(x)
    left, right = [], []
    for k in range(1, min(p.direct, len(x))):
        i = np.flatnonzero(at[k:] == at[:-k])
        if not len(i):
            break
        left.append(i)
        right.append(i + k)
    if not left:
        return
    a, b = x[np.concatenate(left)], x[np.concatenate(right)]
    ok = near(a, b, p)
    a, b = a[ok], b[ok]
    if not len(a):
        return
    pair = np.empty(len(a), [("a", "u4"), ("b", "u4"), ("s", "i8")])
    pair["a"], pair["b"], pair["s"] = a["node"], b["node"], shifts(a, b, p)
    pair = pair[np.lexsort((pair["s"], pair["b"], pair["a"]))]
    new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    n = np.diff(np.r_[new, len(pair)])
    pair = pair[new]
    for s in range(0, len(pair), 50_000):
        part = pair[s:s + 50_000]
        yield _rows(bucket=np.zeros(len(part), np.int32), kind=np.zeros(len(part), np.int32), a=[digests[i] for i in part["a"]], b=[digests[i] for i in part["b"]], shift=part["s"], votes=n[s:s + 50_000])


def _aside(x: np.ndarray, digests: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """The entries ``x``, of tokens with many nodes, one row each, for any bucket."""
    for s in range(0, len(x), 50_000):
        e = x[s:s + 50_000]
        d0 = (e["b0"].astype(np.uint64) | e["b1"].astype(np.uint64) << np.uint64(32)).view(np.int64)
        yield _rows(bucket=np.arange(len(e)) % buckets, kind=np.ones(len(e), np.int32), a=[digests[i] for i in e["node"]], token=token(e), y=e["y"], x=e["x"], m=e["m"].astype(np.int32), d0=d0, d1=e["b2"].astype(np.int64))


def _run_sizes(x: np.ndarray) -> np.ndarray:
    """Of entries sorted by token, how many have the same."""
    at = token(x)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    size = np.diff(np.r_[start, len(x)])
    return np.repeat(size, size)


def _sorted(x: np.ndarray) -> np.ndarray:
    """By token and node, one entry for each (equal media of several tasks give equal entries)."""
    x = x[np.lexsort((x["node"], token(x)))]
    at = token(x)
    return x[np.r_[True, (at[1:] != at[:-1]) | (x["node"][1:] != x["node"][:-1])]] if len(x) else x


def _names_in_order(digests: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct digests ascending, and the number of each given one among them."""
    known, number = np.unique(np.array(digests, "V16"), return_inverse=True) if digests else (np.zeros(0, "V16"), np.zeros(0, np.int64))
    return [k.tobytes() for k in known], number


def filed(media: DataFrame, buckets: int, p: Descriptors = DEFAULT, html: bool = False) -> DataFrame:
    """Packed blocks of table entries of ``media`` (digest binary of 16 bytes, media), dealt into buckets. Tokens
    with many nodes within a task are voted on there; one entry stands for them from then on (bit 7 of table)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        digests: dict[bytes, int] = {}
        waiting: dict[int, list] = {}
        pixels = 0

        def describe_waiting() -> None:
            nonlocal pixels
            for images in waiting.values():
                who, where, words = describe([m for _, m in images], p)
                held.append(entries(np.array([n for n, _ in images])[who] if len(who) else who, where, words))
            waiting.clear()
            pixels = 0

        def flush() -> Iterator[pa.RecordBatch]:
            describe_waiting()
            names, number = _names_in_order(list(digests))
            x = np.concatenate(held) if held else np.zeros(0, ENTRY)
            x["node"] = number[x["node"]] if len(x) else x["node"]
            x = _sorted(x)
            many = _run_sizes(x) > p.direct if len(x) else np.zeros(0, bool)
            yield from _aside(x[many], names, buckets)
            # The first of many stays for the bucket, marked, so that those of other tasks join it.
            first = np.r_[True, token(x)[1:] != token(x)[:-1]] if len(x) else np.zeros(0, bool)
            x["table"] |= many.astype(np.uint8) << 7
            x = x[~many | first]
            at = token(x)
            where = (((at * 0x9E3779B97F4A7C1) >> 20) % buckets).astype(np.int32)
            order = np.argsort(where, kind="stable")
            x, where = x[order], where[order]
            edge = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(x) else np.zeros(0, np.int64)
            ids, packed, blocks = [], [], []
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(x)]):
                own, idx = np.unique(x["node"][i:j], return_inverse=True)
                part = x[i:j].copy()
                part["node"] = idx
                ids.append(int(where[i]))
                packed.append(b"".join(names[k] for k in own))
                blocks.append(_planes(part))
            if ids:
                yield _rows(bucket=ids, digests=packed, block=blocks)
            held.clear()
            digests.clear()

        for batch in batches:
            for d, m in zip(batch.column("digest").to_pylist(), batch.column("media")):
                if d in digests:
                    continue
                m = m.as_py()
                image = render(m) if html else decode_pgm(m)
                if not image.size:
                    continue
                digests[d] = len(digests)
                waiting.setdefault(image.shape[1], []).append((digests[d], image))
                pixels += image.size
                if pixels > 1 << 18:
                    describe_waiting()
                    if sum(map(len, held)) > FLUSH:
                        yield from flush()
        yield from flush()
    return media.select("digest", "media").mapInArrow(run, PACKED)


def met(dealt: DataFrame, p: Descriptors = DEFAULT) -> DataFrame:
    """Votes (kind 0: a, b, shift, votes) and entries of tokens with many nodes (kind 1) of packed blocks, a bucket
    or several whole ones in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, blocks = [], []
        for batch in batches:
            made = pc.is_valid(batch.column("kind"))
            if made.true_count:
                yield batch.filter(made)
            rest = batch.filter(pc.invert(made))
            for d, block in zip(rest.column("digests").to_pylist(), rest.column("block").to_pylist()):
                x = _unplanes(block)
                x["node"] += len(digests)
                digests += [d[i:i + 16] for i in range(0, len(d), 16)]
                blocks.append(x)
        if not blocks:
            return
        names, number = _names_in_order(digests)
        x = np.concatenate(blocks)
        x["node"] = number[x["node"]]
        known = np.unique(token(x)[x["table"] >> 7 == 1])
        x["table"] &= 127
        x = _sorted(x)
        size = _run_sizes(x)
        many = (size > p.direct) | np.isin(token(x), known)
        yield from _aside(x[many & (size > 1)], names, 1)
        yield from _votes(x[~many & (size > 1)], names, p)
    return dealt.mapInArrow(run, PACKED)


def _by_pair(voted: DataFrame) -> DataFrame:
    """Votes (a, b, shift, votes) by pair: (a, b, s: shifts and votes, all: their sum)."""
    return voted.groupBy("a", "b").agg(F.collect_list(F.struct("shift", "votes")).alias("s"), F.sum("votes").alias("all"))


def _bins(pairs: DataFrame, p: Descriptors) -> DataFrame:
    """Of pairs (a, b, s, all): (a, b) with a consensus. Pairs with too few votes in all go before the bins."""
    each = pairs.where(F.col("all") >= p.votes).select("a", "b", F.explode("s").alias("s")).select("a", "b", "s.*")
    half = F.sequence(F.lit(0), F.lit(1))
    each = each.withColumn("oy", F.explode(half)).withColumn("ox", F.explode(half))
    dy, dx = F.shiftright("shift", 26).bitwiseAND(F.lit(2 * MID - 1)) - MID, F.col("shift").bitwiseAND(F.lit(2 * MID - 1)) - MID
    by, bx = (F.floor((c + F.col(o) * (p.bin // 2)) / p.bin) for c, o in ((dy, "oy"), (dx, "ox")))
    voted = each.groupBy("a", "b", F.shiftright("shift", 52).alias("st"), "oy", "ox", by.alias("by"), bx.alias("bx")).agg(F.sum("votes").alias("votes"))
    return voted.where(F.col("votes") >= p.votes).select("a", "b").distinct()


SPOT = ["y", "x", "m", "d0", "d1"]
#: Images of a block; those of two blocks are compared in one tile.
TILE = 512


def _sought(node: np.ndarray, kind: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """The pairs (a * n + b, a < b) of n nodes that have a token in common, of entries (node, kind: the token's
    number); ``block``: of each node. Where there are two blocks, only pairs across them."""
    order = np.lexsort((node, kind))
    node, kind = node[order], kind[order]
    start = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
    across = len(np.unique(block)) > 1
    found, size = [np.zeros(0, np.int64)], 0
    for i, j in zip(start.tolist(), [*start[1:].tolist(), len(node)]):
        own = node[i:j]
        x, y = np.triu_indices(len(own), 1)
        a, b = own[x], own[y]
        if across:
            other = block[a] != block[b]
            a, b = a[other], b[other]
        found.append(a * n + b)
        size += len(a)
        if size > 2_000_000:
            found, size = [np.unique(np.concatenate(found))], 0
    return np.unique(np.concatenate(found))


def _consensus(pair: np.ndarray, shift: np.ndarray, votes: np.ndarray, p: Descriptors) -> np.ndarray:
    """The pairs (numbers) of which one bin has enough of the votes (pair, shift, votes)."""
    total = np.bincount(pair, weights=votes)
    live = total[pair] >= p.votes
    pair, shift, votes = pair[live], shift[live], votes[live]
    dy, dx = (shift >> 26 & (2 * MID - 1)) - MID, (shift & (2 * MID - 1)) - MID
    found = []
    for oy in (0, p.bin // 2):
        for ox in (0, p.bin // 2):
            at = (shift >> 52) << 52 | ((dy + oy) // p.bin + MID) << 26 | ((dx + ox) // p.bin + MID)
            order = np.lexsort((at, pair))
            at, of = at[order], pair[order]
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])]) if len(at) else np.zeros(0, np.int64)
            if len(first):
                found.append(of[first][np.add.reduceat(votes[order], first) >= p.votes])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the smallest that the links (a, b) reach."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def _tile_links(pairs: pa.Table, packs: pa.Table, p: Descriptors) -> pa.Table:
    """The links of a tile: ``pairs`` (a, b, s: shifts and votes of other tokens) and those that the entries of
    ``packs`` (digest, block, e) bring together, if they have a consensus with the entries that both have: (a, null, n)
    for each image a with n links, and (a, b, 0) that join the same images as the links do, one for an image at most."""
    packs = packs.sort_by("digest")
    named = packs["digest"].combine_chunks()
    e = packs["e"].combine_chunks()
    long = pc.list_value_length(e).to_numpy()
    owner = np.repeat(np.arange(len(e)), long)
    rare = np.arange(len(owner)) - np.repeat(np.cumsum(long) - long, long) >= p.votes - 1
    e = e.flatten()
    x = np.zeros(len(owner), ENTRY)
    d0 = e.field("d0").to_numpy().view(np.uint64)
    x["b0"], x["b1"], x["b2"] = d0 & np.uint64(0xFFFFFFFF), d0 >> np.uint64(32), e.field("d1").to_numpy()
    x["y"], x["x"], x["m"] = (e.field(c).to_numpy() for c in "yxm")
    kinds, kind = np.unique(e.field("token").to_numpy(), return_inverse=True)
    codes = _sought(owner[rare], kind[rare], packs["block"].to_numpy(), len(named))
    key = owner * len(kinds) + kind
    order = np.argsort(key)
    x, key, kind = x[order], key[order], kind[order]
    edge = np.searchsorted(key, np.arange(len(named) + 1) * len(kinds))
    # Votes of the other tokens.
    held_pair = held_shift = held_votes = np.zeros(0, np.int64)
    if pairs.num_rows:
        a, b = (pc.index_in(pairs[c], value_set=named).to_numpy().astype(np.int64) for c in "ab")
        s = pairs["s"].combine_chunks()
        held_pair, s = np.repeat(a * len(named) + b, pc.list_value_length(s).to_numpy()), s.flatten()
        held_shift, held_votes = s.field("shift").to_numpy(), s.field("votes").to_numpy()
        codes = np.union1d(codes, held_pair)
        held_pair = np.searchsorted(codes, held_pair)
    a, b = codes // len(named), codes % len(named)
    order = np.argsort(held_pair, kind="stable")
    held_pair, held_shift, held_votes = held_pair[order], held_shift[order], held_votes[order]
    linked = []
    size = edge[a + 1] - edge[a]
    cut = np.r_[0, np.cumsum(size)]
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + 2_000_000, side="right")) - 1)
        pair = np.repeat(np.arange(i, j), size[i:j])
        left = np.arange(cut[j] - cut[i]) - (cut[pair] - cut[i]) + edge[a[pair]]
        want = b[pair] * len(kinds) + kind[left]
        right = np.minimum(np.searchsorted(key, want), len(key) - 1)
        both = key[right] == want
        pair, left, right = pair[both], x[left[both]], x[right[both]]
        ok = near(left, right, p)
        pair, shift = pair[ok], shifts(left[ok], right[ok], p)
        u, v = np.searchsorted(held_pair, [i, j])
        every = np.r_[pair, held_pair[u:v]] - i
        got = _consensus(every, np.r_[shift, held_shift[u:v]], np.r_[np.ones(len(pair), np.int64), held_votes[u:v]], p)
        linked.append(got + i)
        i = j
    at = np.concatenate(linked) if linked else np.zeros(0, np.int64)
    a, b = a[at], b[at]
    links, root = np.bincount(np.r_[a, b], minlength=len(named)), _roots(a, b, len(named))
    own, far = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(named)))
    left, right = named.take(pa.array(np.r_[own, root[far]])), named.take(pa.array(far))
    return pa.table({"a": left, "b": pa.concat_arrays([pa.nulls(len(own), right.type), right]), "n": np.r_[links[own], np.zeros(len(far), np.int64)]})


def _links(voted: DataFrame, hot: DataFrame, p: Descriptors) -> tuple[DataFrame, DataFrame]:
    """All links: (digest, n), n links of an image, and (a, b) that join the same images as the links do. ``hot``:
    the entries of tokens with many nodes; ``voted``: of the other tokens. A group of copies has links that grow
    with its square, so these are counted where they are found and only what joins the group is sent on.

    A pair of images with such entries is decided in one tile, any other by ``voted`` alone. A pair without votes of
    other tokens needs ``votes`` common ones, so it meets in one that is not among the ``votes`` - 1 most frequent of
    either. These pairs and those with votes of other tokens are looked at in the tile of their two images' blocks,
    where all entries of both are.
    """
    n = hot.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct((-F.col("n")).alias("often"), "token", *SPOT)
    packs = durable(hot.join(n, "token").groupBy("digest").agg(F.sort_array(F.collect_list(entry)).alias("e")), "media-packs")
    rare = packs.where(F.size("e") >= p.votes).select("digest", F.explode(F.slice("e", F.lit(p.votes), F.size("e"))["token"]).alias("token"))
    # Blocks in which a token occurs, and from there those that an image is compared with: no pair is written.
    blocks = max(1, -(-packs.count() // TILE))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    tile = lambda a, b: F.least(a, b) * blocks + F.greatest(a, b)
    each = rare.groupBy("token").agg(F.collect_set(block("digest")).alias("met"), F.count(F.lit(1)).alias("k")).where("k > 1")
    reach = rare.join(each.select("token", "met"), "token").groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_set("met"))).alias("met"))
    size = lambda c: packs.select(F.col("digest").alias(c), F.size("e").alias(f"n{c}"))
    known = _by_pair(voted).join(size("a"), "a", "left").join(size("b"), "b", "left").withColumn("open", F.col("na").isNotNull() & F.col("nb").isNotNull())
    known = durable(known.where(F.col("all") + F.when(F.col("open"), F.least("na", "nb")).otherwise(0) >= p.votes), "media-known")
    asked = durable(known.where("open").select("a", "b", "s", tile(block("a"), block("b")).alias("tile")), "media-asked")
    places = reach.select("digest", F.explode("met").alias("other")).select(tile(block("digest"), F.col("other")).alias("of"), "digest")
    places = places.unionByName(asked.select(F.col("tile").alias("of"), F.explode(F.array("a", "b")).alias("digest"))).distinct()
    needed = places.join(packs, "digest").withColumn("block", block("digest"))
    run = lambda left, right: _tile_links(left, right, p)
    often = durable(asked.groupBy("tile").cogroup(needed.groupBy("of")).applyInArrow(run, "a binary, b binary, n long"), "media-often")
    seldom = durable(_bins(known.where("not open"), p), "media-links")
    remove(packs, asked, known)
    counts = _degrees(seldom).unionByName(often.where("b is null").select(F.col("a").alias("digest"), "n")).groupBy("digest").agg(F.sum("n").alias("n"))
    return counts, seldom.unionByName(often.where("b is not null").select("a", "b"))


def _degrees(links: DataFrame) -> DataFrame:
    """(digest, n) of the ends of distinct links (a, b)."""
    return links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))


def _as_ids(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    name = lambda c: classes.select(F.col("digest").alias(c), F.col("id").alias(f"i{c}"))
    return pairs.join(name("a"), "a").join(name("b"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def copies(media: DataFrame, p: Descriptors = DEFAULT, html: bool = False) -> DataFrame:
    """(id, copies, links, component_id) of every row of ``media`` (id long, media).

    component_id is the smallest id that links reach, the row's own included; copies counts the rows with
    equal media, this one included; links counts the different media linked with this one's, all of them. Null media stand alone;
    empty and damaged media link only with equal ones. A null id is kept, with itself null; rows that
    repeat an id are taken as one image in the result and stay repeated. Extra columns are not read. An empty
    table gives no rows.
    """
    marked = media.select("id", "media", F.unhex(F.md5(F.col("media").cast("binary"))).alias("digest"))
    known = marked.where("id is not null and media is not null")
    classes = durable(known.groupBy("digest").agg(F.min("id").alias("id"), F.max(F.octet_length("media")).alias("bytes"), F.count(F.lit(1)).alias("rows")), "media-classes")
    total = classes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(media.sparkSession), int(total) // BUCKET_BYTES)
    found = durable(met(filed(known, buckets, p, html).repartitionById(buckets, F.col("bucket")), p), "media-votes")
    voted = found.where("kind = 0").select("a", "b", "shift", "votes")
    hot = found.where("kind = 1").select(F.col("a").alias("digest"), "token", *SPOT).dropDuplicates(["token", "digest"])
    hot = durable(hot, "media-common")
    if hot.isEmpty():
        linked = durable(_bins(_by_pair(voted), p), "media-links")
        degree = _degrees(linked)
    else:
        degree, linked = _links(voted, hot, p)
    # Rows that share an id are one image: their media are linked through it.
    same = known.select("id", "digest").join(classes.select("digest", F.col("id").alias("first")), "digest")
    edges = _as_ids(linked, classes).unionByName(same.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    roots = components(edges, "media")
    by_class = classes.select("digest", "rows").join(degree.withColumnRenamed("n", "links"), "digest", "left")
    out = marked.select("id", "digest").join(by_class, "digest", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", F.coalesce(F.when(F.col("id").isNotNull(), F.col("rows")), F.lit(1)).cast("long").alias("copies"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("links")), F.lit(0)).cast("long").alias("links"), F.coalesce("root", "id").alias("component_id"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied tables have no images; the media column is the picture of each page's text."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("media"))
    return copies(pages, PAGES, html=True).withColumnRenamed("id", "page_id")
