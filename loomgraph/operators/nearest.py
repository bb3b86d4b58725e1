"""The nearest of many strings by edit distance, found through shared keys and never by comparing all pairs.

Two strings within ``k`` edits share a string that at most ``k`` deletions from each give; for short strings and one
or two edits these neighbourhoods are the keys. They grow with the length and the edits, so any other string of the
index is cut into ``k + 1`` segments, one of which ``k`` edits must leave whole, and a target asks for its own
substrings of the segment's length at the places it can have moved to. Keys meet by equality, what meets is verified
by its distance. Levels go from one edit up; a target that found something within a level's edits has its nearest
and leaves.

Where very many strings begin alike, segments of that beginning would tell nothing apart. So a string is filed under
the longest of the common beginnings that it has, and only its rest has keys. A target's distance to it is, for some
cut of the target, that of the head to the beginning plus that of the tail to the rest: the edits that a head takes are
counted once for each common beginning, and the tail is sought among the rests with the edits that are left.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.io import written

c = F.col
#: Indexed strings of at most ``SHORT`` signs have deletion neighbourhoods as keys, up to ``DELETIONS`` edits.
SHORT, DELETIONS = 16, 2


def deletions(text: str, k: int) -> set[str]:
    """All strings that at most ``k`` deletions give."""
    out = last = {text}
    for _ in range(k):
        last = {t[:i] + t[i + 1:] for t in last for i in range(len(t))}
        out = out | last
    return out


def cut(length: int, k: int) -> list[tuple[int, int]]:
    """``k + 1`` segments (start, end) of nearly equal length."""
    return [(i * length // (k + 1), (i + 1) * length // (k + 1)) for i in range(k + 1)]


def whole(length: int, k: int) -> bool:
    """Whether an indexed string of this length has its deletion neighbourhood as keys."""
    return k <= DELETIONS and length <= SHORT


def held_keys(text: str, k: int) -> set[str]:
    """Keys of an indexed string for up to ``k`` edits. One of ``k`` signs or fewer has no segments: such are one key."""
    if whole(len(text), k):
        return deletions(text, k)
    return {f"{len(text)}:{i}:{text[a:b]}" for i, (a, b) in enumerate(cut(len(text), k))} if len(text) > k else {":"}


def asked_keys(text: str, k: int, edits: int | None = None) -> set[str]:
    """Keys that a target asks for, of those held for ``k`` edits, if at most ``edits`` (of ``k``) took place. A segment
    that moved by s, in a string shorter by d, took |s| edits before it and |s - d| after it at least."""
    n = len(text)
    edits = k if edits is None else edits
    out = deletions(text, k) if k <= DELETIONS and n <= SHORT + k else set()
    if k > DELETIONS and n - edits <= k:
        out = out | {":"}
    for length in range(max(k + 1, n - edits), n + edits + 1):
        if whole(length, k):
            continue
        for i, (a, b) in enumerate(cut(length, k)):
            for s in range(-edits, edits + 1):
                if abs(s) + abs(s - (n - length)) <= edits and 0 <= a + s and b + s <= n:
                    out.add(f"{length}:{i}:{text[a + s:b + s]}")
    return out


def tail_edits(text: str, starts: list[str], k: int) -> list[tuple[str, str, int]]:
    """(beginning, tail, edits left): the tails of a target that are to be sought under each of the sorted ``starts``
    with at most ``k`` edits in all. A tail that a neighbouring cut covers with the edits between them is left out.

    Beginnings are met in order, so each shares its rows of edits with the one before; a branch ends where no head of
    the target is within ``k`` edits."""
    out: list[tuple[str, str, int]] = []
    rows, last = [list(range(len(text) + 1))], ""
    for start in starts:
        same = 0
        while same < min(len(start), len(last), len(rows) - 1) and start[same] == last[same]:
            same += 1
        del rows[same + 1:]
        last = start
        for sign in start[same:]:
            row = rows[-1]
            if min(row) > k:
                break
            new = [row[0] + 1]
            for i, x in enumerate(text):
                new.append(min(row[i] + (x != sign), row[i + 1] + 1, new[i] + 1))
            rows.append(new)
        if len(rows) <= len(start):
            continue
        row = rows[-1]
        for i, e in enumerate(row):
            if e <= k and not (i and row[i - 1] < e) and not (i < len(text) and row[i + 1] < e):
                out.append((start, text[i:], k - e))
    return out


def common_starts(known: DataFrame, most: int = 1_000, step: int = 4) -> list[str]:
    """Beginnings that more than ``most`` strings (anchor) and more than a ``most``-th of all have, each as long as all
    that have it agree: found at lengths from ``step`` up, fewer than ``most`` at a length whatever the number of
    strings, at greater lengths only where a shorter beginning is common."""
    n = known.count()
    found: set[str] = set()
    length, left = step, known
    while True:
        start = F.substring("anchor", 1, length)
        many = left.where(F.length("anchor") >= length).groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.min("anchor").alias("lo"), F.max("anchor").alias("hi"))
        new = many.where(c("n") > max(most, n // most)).collect()  # fewer than ``most``
        if not new:
            return sorted(found)
        # What the first and the last by order begin with, all between them do.
        longer = [os.path.commonprefix([r.lo, r.hi]) for r in new]
        found.update(longer)
        left = known.where(start.isin([r.start for r in new]))
        length = max(length, min(map(len, longer))) + max(step, length // 4)


def rounded(k: int) -> int:
    """The edits that keys are made for: 0, 1, 2, 4, 8 and so on."""
    return k if k <= 2 else 1 << (k - 1).bit_length()


def _hash(start: str, k: int, key: str) -> int:
    return xxhash.xxh64_intdigest(f"{k}:{len(start)}:{start}{key}") - (1 << 63)


def _keyed(rows: DataFrame, name: str, keys: Callable[[str], Iterable[int]]) -> DataFrame:
    """(name, key): the 64-bit keys of each string, given out in small batches."""
    def run(batches):
        texts, found = [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, pa.int64())], [name, "key"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                made = list(keys(text))
                texts += [text] * len(made)
                found += made
                if len(found) >= 10_000:
                    yield out()
                    texts, found = [], []
        if found:
            yield out()
    return rows.select(name).mapInArrow(run, f"{name} string, key long")


def _asking(starts: list[str], level: int, share: int, most: int) -> Callable[[str], Iterable[int]]:
    def keys(text: str) -> set[int]:
        k = min(level, most, len(text) // share)
        return {_hash(start, rounded(left), key) for start, tail, left in tail_edits(text, starts, k) for key in asked_keys(tail, rounded(left), left)}
    return keys


def _holding(starts: list[str], level: int) -> Callable[[str], Iterable[int]]:
    known, sizes = set(starts), sorted({len(x) for x in starts}, reverse=True)
    edits = sorted({rounded(k) for k in range(level + 1)})
    # Whole targets are asked for with over half a level's edits, tails with any number.

    def keys(text: str) -> set[int]:
        start = next(text[:n] for n in sizes if text[:n] in known)
        return {_hash(start, k, key) for k in (edits if start else [level]) for key in held_keys(text[len(start):], k)}
    return keys


def nearest(targets: DataFrame, known: DataFrame, share: int = 3, most: int = 16, common: int = 1_000) -> DataFrame:
    """(target, anchor, distance) of each distinct target (target): the known string (anchor) with the least distance,
    ties to the first by name, if that is at most a ``share``-th of the target's length and at most ``most`` edits; targets
    without one give no row.

    Beginnings that more than ``common`` known strings have are filed apart (``common_starts``).
    Nulls are left out. Distances count characters. An equal string has distance 0.
    """
    left = written(targets.where("target is not null").select("target").distinct(), "targets")
    known = written(known.where("anchor is not null").select("anchor").distinct(), "known")
    out = left.join(known, c("target") == c("anchor")).select("target", "anchor", F.lit(0).alias("distance"))
    left = left.join(known.select(c("anchor").alias("target")), "target", "left_anti")
    allowed = F.least(F.lit(most), F.floor(F.length("target") / share))
    starts = ["", *common_starts(known, common)]
    level = 1
    while True:
        able = written(left.where(allowed >= 1 + (level // 2 if level > 1 else 0)), "targets")
        low, high = able.agg(F.min(F.length("target")), F.max(F.length("target"))).first()
        if low is None:
            return out
        near = known.where(F.length("anchor").between(low - level, high + level))
        met = _keyed(able, "target", _asking(starts, level, share, most)).join(_keyed(near, "anchor", _holding(starts, level)), "key").select("target", "anchor").distinct()
        d = F.levenshtein("target", "anchor", level)
        close = met.select("target", "anchor", d.alias("distance")).where((c("distance") >= 0) & (c("distance") <= allowed))
        best = written(close.groupBy("target").agg(F.min(F.struct("distance", "anchor")).alias("b")).select("target", "b.anchor", "b.distance"), "nearest")
        out = out.unionByName(best)
        left = able.join(best.select("target"), "target", "left_anti").where(allowed > level)
        level *= 2
