"""LM scoring: a gated recurrent language model with a class-factored output softmax, in numpy.

Tokens are words (A-Z lower-cased) and one end a document. All training documents are counted; the
``outputs`` most frequent words are the model's own, every other word belongs to one of ``buckets``
spelling buckets, and its probability is the bucket's times its share of the bucket's counts, so the
model gives every text a probability that can be compared with the unigram base. A word's probability
is its class's times its own within the class, 64 of 64, so a token costs two short softmaxes.

The network (a few hundred thousand numbers) learns by truncated backpropagation over windows of
``unroll`` tokens. A bounded sample gives it a start in one task; then all training documents are learned
once, whole: in each of ``rounds`` rounds every task takes the network, learns its part of the round's
documents, and the networks are averaged by their tokens, 32 at a time, for the next round. Scoring runs
many documents side by side, window after window, with the state carried over to a document's end, so
the log-likelihood is that of the complete document however long it is.

Counts follow the corpus. Each task counts before it shuffles; the ``head`` most frequent words are
broadcast (a fixed number), and only what documents have beyond them is joined with the count table.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapreplace
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, fold, remove, table

#: The end of a document among the words: no word is empty.
END = b""


@dataclass(frozen=True)
class Gru:
    """``train_rows`` bounds the documents that give the network its start (first by the hash of their id); what
    it learns after that, in ``rounds`` rounds, and all counts are of all training documents. ``lanes`` rows are
    learned side by side, ``block`` tokens are held at once, of which ``near``
    go through a softmax together so that its numbers stay in a core's cache, and a task learns about ``share`` tokens or one
    partition of the input, whichever is more."""

    outputs: int = 3968
    buckets: int = 128
    classes: int = 64
    hidden: int = 32
    head: int = 262_144
    train_rows: int = 1500
    epochs: int = 3
    streams: int = 64
    unroll: int = 32
    rate: float = 6e-3
    rounds: int = 3
    lanes: int = 256
    block: int = 1_000_000
    share: int = 1_000_000
    together: int = 512
    window: int = 64
    near: int = 4096

    @property
    def size(self) -> int:
        return self.outputs + self.buckets

    @property
    def kind(self) -> np.dtype:
        """The type that ids are stored as."""
        return np.dtype("<u2" if self.size < 1 << 16 else "<i4")


DEFAULT = Gru()


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[:1] + word[-2:]) % buckets


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, often: int = 48) -> None:
    """Adds each of ``rows`` to the row of ``to`` that ``at`` names, repeats included: ids that stand ``often`` or
    more times by a product with ones, the others occurrence by occurrence."""
    order = np.argsort(at.astype(np.int16 if len(to) < 1 << 15 else np.int64), kind="stable")
    ids = at[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    size = np.diff(np.r_[first, len(ids)])
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    more = np.searchsorted(-size, -np.arange(often)).tolist()  # how many ids stand more than 0, 1, ... times
    many = more[-1]
    ones = np.ones(size[0], rows.dtype)
    for i, k in zip(first[:many].tolist(), size[:many].tolist()):
        to[ids[i]] += ones[:k] @ rows.take(order[i:i + k], axis=0)
    first = first[many:]
    total = rows.take(order[first], axis=0)
    for k in range(1, often - 1):
        if more[k] == many:
            break
        total[: more[k] - many] += rows.take(order[first[: more[k] - many] + k], axis=0)
    to[ids[first]] += total


class Network:
    """Parameters by name; ids are 0 .. size-1, class of an id is id // (size / classes)."""

    def __init__(self, p: Gru, parts: dict[str, np.ndarray]):
        self.p, self.parts = p, parts
        self.width = -(-p.size // p.classes)

    @classmethod
    def new(cls, p: Gru, frequency: np.ndarray) -> Network:
        """Starts as the unigram model of ``frequency`` (one an id)."""
        rng, h, width = np.random.default_rng(0), p.hidden, -(-p.size // p.classes)
        f = np.zeros(p.classes * width)
        f[: p.size] = frequency + 0.5
        by = f.reshape(p.classes, width)
        total = by.sum(axis=1)
        parts = {
            "x": rng.normal(0, 0.1, (p.size, 3 * h)), "u": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "b": np.zeros(3 * h),
            "wc": rng.normal(0, 0.02, (h, p.classes)), "bc": np.log(np.maximum(total, 1e-9)),
            "ww": rng.normal(0, 0.02, (p.classes, h, width)), "bw": np.where(by > 0, np.log(np.maximum(by, 1e-9)) - np.log(np.maximum(total, 1e-9))[:, None], -30.0),
        }
        return cls(p, {k: v.astype(np.float32) for k, v in parts.items()})

    def dump(self) -> bytes:
        out = BytesIO()
        np.savez(out, **self.parts)
        return out.getvalue()

    @classmethod
    def load(cls, p: Gru, raw: bytes) -> Network:
        with np.load(BytesIO(raw)) as z:
            return cls(p, {k: z[k] for k in z.files})

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the update, the reset and the new state: each id's input with its bias (3 x ids x hidden) and the
        state's weights (3 x hidden x hidden), times what ``run`` takes the exponential of."""
        w, n = self.parts, self.p.hidden
        x, b = np.empty((3, len(w["x"]), n), np.float32), -w["b"]
        for i in range(3):
            np.subtract(b[i * n:i * n + n], w["x"][:, i * n:i * n + n], out=x[i])
        x[2] *= 2
        return x, w["u"].reshape(n, 3, n).transpose(1, 0, 2) * np.float32([-1, -1, -2]).reshape(3, 1, 1)

    def softmaxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights with biases as last row: of the classes, and within each class."""
        w = self.parts
        return np.vstack([w["wc"], w["bc"]]), np.concatenate([w["ww"], w["bw"][:, None]], axis=1)

    def run(self, h: np.ndarray, ids: np.ndarray, keep: np.ndarray | None = None, gates: tuple[np.ndarray, np.ndarray] | None = None, taped: bool = False) -> tuple[np.ndarray, tuple]:
        """States (steps x rows x hidden) after each of the tokens ``ids`` (steps x rows), from state ``h`` (rows x
        hidden); ``keep`` zeroes states where 0. Each gate is a block of memory of its own; ``gates`` are made if not given.
        With ``taped``, what every step had before it, its gates and its new states come too."""
        x, u = gates or self.gates()
        states = np.empty((*ids.shape, self.p.hidden), np.float32)
        held = len(ids) if taped else 1  # steps that are written over each other
        befores, news = np.empty((2, held, *states.shape[1:]), np.float32)
        gs = np.empty((held, 3, *states.shape[1:]), np.float32)
        views = [(befores[i], gs[i], gs[i, :2], *gs[i], news[i]) for i in range(held)]
        gone = [()] * len(ids)
        if keep is not None:
            step, row = np.nonzero(keep == 0)
            gone = np.split(row, np.searchsorted(step, np.arange(1, len(ids))))
        with np.errstate(over="ignore"):  # exp of a shut gate may be infinite, and the gate is 0
            for t in range(len(ids)):
                hp, g, both, z, r, gn, new = views[t % held]
                if taped or len(gone[t]):
                    hp[...] = h
                    if len(gone[t]):
                        hp[gone[t]] = 0
                else:
                    hp = h
                np.matmul(hp, u, out=g)
                own = x.take(ids[t], axis=1)
                both += own[:2]
                np.exp(both, out=both)
                both += 1
                np.divide(1, both, out=both)  # the sigmoids
                np.multiply(r, gn, out=new)
                new += own[2]
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1  # tanh(a) is 2 / (1 + exp(-2 a)) - 1
                h = states[t]
                np.subtract(hp, new, out=h)
                h *= z
                h += new
        return states, (befores, gs, news)

    def log_p(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None, made: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each target's probability given its state (rows x hidden); with ``grads``, adds the
        gradients of the summed loss there and returns the states' gradient. ``softmaxes`` are made if not given."""
        w, n = self.parts, self.p.hidden
        cls, at = np.divmod(targets, self.width)
        order = np.argsort(cls.astype(np.int16), kind="stable")  # by class: each class's rows are a slice
        cls, at = cls[order], at[order]
        edges = np.searchsorted(cls, np.arange(self.p.classes + 1)).tolist()
        outside, within = made or self.softmaxes()

        def soft(e, want):
            want = want + np.arange(0, e.size, e.shape[1])
            if e.max() > 60 or e.min() < -60:  # else neither the exponentials nor their sum leave the numbers' range
                e -= e.max(axis=1, keepdims=True)
            flat = e.reshape(-1)
            got = flat.take(want)
            np.exp(e, out=e)
            total = e @ np.ones(e.shape[1], e.dtype)
            got -= np.log(total)
            if grads is not None:
                e *= (1 / total)[:, None]
                flat[want] -= 1
            return got

        out = np.empty(len(order), w["wc"].dtype)
        d = None if grads is None else np.empty((len(order), n), out.dtype)
        for a in range(0, len(order), self.p.near):
            rows = order[a:a + self.p.near]
            one = np.ones((len(rows), n + 1), out.dtype)  # the last column carries the biases
            one[:, :-1] = states.take(rows, axis=0)
            own, ends = cls[a:a + len(rows)], a + len(rows)
            slices = [(c, slice(max(edges[c], a) - a, min(edges[c + 1], ends) - a)) for c in range(own[0], own[-1] + 1) if edges[c] < edges[c + 1]]
            outer = one @ outside
            got = soft(outer, own)
            inner = np.empty((len(rows), self.width), out.dtype)
            for c, part in slices:
                np.matmul(one[part], within[c], out=inner[part])
            got += soft(inner, at[a:ends])
            out[rows] = got
            if grads is not None:
                g = one.T @ outer
                grads["wc"] += g[:-1]
                grads["bc"] += g[-1]
                by, more = outer @ w["wc"].T, np.empty((len(rows), n), out.dtype)
                for c, part in slices:
                    e = inner[part]
                    g = one[part].T @ e
                    grads["ww"][c] += g[:-1]
                    grads["bw"][c] += g[-1]
                    np.matmul(e, w["ww"][c].T, out=more[part])
                by += more
                d[rows] = by
        return out, d

    def learn(self, tokens: np.ndarray, end: int, streams: int, epochs: int = 1, rate: float = 1.0, last: float = 1.0) -> int:
        """Truncated backpropagation (Adam) over one long row of tokens, cut into streams; the rate, as a part of
        the parameter's, goes from ``rate`` to ``last``. Every token but the first is a target, in each epoch once: where
        streams don't divide the row, the last ones end early and what is beyond is masked. Gives back how many."""
        p, n = self.p, self.p.hidden
        targets = len(tokens) - 1
        steps = -(-targets // streams)
        if steps < 1:
            return 0
        at = np.arange(steps)[:, None] + np.arange(streams)[None, :] * steps
        real = at < targets
        tokens = np.r_[tokens, np.full(steps * streams - targets, end, tokens.dtype)]
        before, target = tokens[at], tokens[at + 1]
        flat = np.concatenate([x.ravel() for x in self.parts.values()])
        m, v2, g = np.zeros((3, len(flat)), flat.dtype)
        cut = np.cumsum([x.size for x in self.parts.values()])[:-1]
        w, grads = ({k: y.reshape(x.shape) for (k, x), y in zip(self.parts.items(), np.split(whole, cut))} for whole in (flat, g))
        self.parts = w
        count, total = 0, epochs * -(-steps // p.unroll)
        for _ in range(epochs):
            h = np.zeros((streams, n), np.float32)
            for s in range(0, steps, p.unroll):
                ids, want = before[s:s + p.unroll], target[s:s + p.unroll]
                keep = ids != end
                states, tape = self.run(h, ids, keep, taped=True)
                h = states[-1]
                g.fill(0)
                here = real[s:s + p.unroll].ravel()
                if here.all():
                    _, d = self.log_p(states.reshape(-1, n), want.ravel(), grads)
                else:
                    d = np.zeros((ids.size, n), flat.dtype)
                    d[here] = self.log_p(states.reshape(-1, n)[here], want.ravel()[here], grads)[1]
                d = d.reshape(*ids.shape, n)
                befores, gs, news = tape
                after, back = np.zeros_like(h), np.ascontiguousarray(w["u"].T)
                inputs, inner = np.empty((*ids.shape, 3 * n), np.float32), np.empty((*ids.shape, n), np.float32)
                a, rest = np.empty((2, *h.shape), np.float32)
                for t in range(len(ids) - 1, -1, -1):
                    hp, (z, r, gn), new, dh, own, dn = befores[t], gs[t], news[t], d[t], inputs[t], inner[t]
                    dh += after
                    np.subtract(1, z, out=rest)
                    np.subtract(hp, new, out=a)
                    a *= dh
                    a *= z
                    np.multiply(a, rest, out=own[:, :n])
                    np.multiply(dh, rest, out=dn)
                    new *= new
                    np.subtract(1, new, out=new)
                    dn *= new
                    own[:, 2 * n:] = dn
                    dn *= r  # what reaches the state's part of the new state
                    gn *= dn
                    np.subtract(r, 1, out=r)
                    r *= 0.5  # ``gates`` makes that part -2 times as large
                    np.multiply(gn, r, out=own[:, n:2 * n])
                    after = own[:, :2 * n] @ back[:2 * n]
                    after += dn @ back[2 * n:]
                    dh *= z
                    after += dh
                    after[~keep[t]] = 0
                inputs, befores = inputs.reshape(-1, 3 * n), befores.reshape(-1, n).T
                grads["u"][:, :2 * n] += befores @ inputs[:, :2 * n]
                grads["u"][:, 2 * n:] += befores @ inner.reshape(-1, n)
                grads["b"] += np.ones(len(inputs), np.float32) @ inputs
                _add_rows(grads["x"], ids.ravel(), inputs)
                count += 1
                scale = 1.0 / max(1, np.count_nonzero(here))
                norm = np.sqrt(sum(float(np.vdot(x, x)) for x in grads.values())) * scale
                scale *= min(1.0, 1.0 / max(norm, 1e-9))
                now = p.rate * (rate + (last - rate) * count / total) * np.sqrt(1 - 0.99 ** count) / (1 - 0.9 ** count)
                for i in range(0, len(flat), 16_384):  # a part at a time, which stays in a core's cache
                    one, first, second = g[i:i + 16_384], m[i:i + 16_384], v2[i:i + 16_384]
                    one *= scale
                    first *= 0.9
                    first += one  # the mean times 10
                    second *= 0.99
                    one *= one
                    second += one  # that of squares times 100
                    np.sqrt(second, out=one)
                    one += 1e-5
                    np.divide(first, one, out=one)
                    one *= now
                    flat[i:i + 16_384] -= one
        return targets

    def score(self, documents: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log-likelihood of each document's complete token row (its end included). Documents stand one after
        the other in ``together`` lanes of about the same length; each starts from no state."""
        p, gates, made = self.p, self.gates(), self.softmaxes()
        out, size = np.zeros(len(documents)), np.array([len(x) for x in documents], np.int64)
        heap = [(0, i) for i in range(min(p.together, len(documents)))]
        lanes: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-size, kind="stable").tolist():  # longest first, each to the shortest lane
            held, lane = heap[0]
            lanes[lane].append(i)
            heapreplace(heap, (held + int(size[i]), lane))
        lanes = [lanes[i] for _, i in sorted(heap, reverse=True)]
        tokens = [np.concatenate([documents[i] for i in lane]) for lane in lanes]
        owners = [np.repeat(np.array(lane, np.int32), size[lane]) for lane in lanes]
        long = np.array([len(x) for x in tokens])
        h, last, own = np.zeros((len(lanes), p.hidden), np.float32), np.full(len(lanes), end), np.full(len(lanes), -1)
        for a in range(0, int(long.max(initial=0)), p.window):
            live, steps = int((long > a).sum()), min(p.window, int(long[0]) - a)  # longest first: those still running stand in front
            target, owner = np.full((2, live, steps), -1)
            for j in range(live):
                part = tokens[j][a:a + steps]
                target[j, :len(part)], owner[j, :len(part)] = part, owners[j][a:a + steps]
            target, owner = np.ascontiguousarray(target.T), np.ascontiguousarray(owner.T)
            start = owner != np.vstack([own[:live], owner[:-1]])
            ids = np.vstack([last[:live], target[:-1]])
            ids[start] = end
            states, _ = self.run(h[:live], ids, ~start, gates)
            h, last, own = states[-1], target[-1], owner[-1]
            inside = np.flatnonzero(target >= 0)
            rows, target, owner = states.reshape(-1, p.hidden), target.ravel(), owner.ravel()
            if len(inside) < len(target):
                rows, target, owner = rows.take(inside, axis=0), target[inside], owner[inside]
            got, _ = self.log_p(rows, target, made=made)
            out += np.bincount(owner, weights=got, minlength=len(out))
        return out


def tokens_of(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The tokens of ``texts`` (their words, A-Z lower-cased, and an end each), by runs of rows of about ``most`` bytes: the
    run's different words with the end as last, its tokens as numbers of those, and where in them each row ends."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, most + (size[at - 1] if at else 0), "right")))
        words = pc.ascii_split_whitespace(texts.slice(at, to - at))  # with empty ones before and after outer whitespace
        found = words.flatten().dictionary_encode()
        number, names = found.indices.to_numpy(), found.dictionary.cast(pa.binary())
        real = (pc.binary_length(names).to_numpy() > 0)[number]
        before = np.r_[0, np.cumsum(real)][np.cumsum(pc.list_value_length(words).to_numpy())]
        ends = before + np.arange(to - at)
        tokens = np.empty(len(ends) + (int(before[-1])), np.int32)
        inside = np.ones(len(tokens), bool)
        inside[ends] = False
        tokens[inside], tokens[ends] = number[real], len(names)
        yield pa.concat_arrays([names, pa.array([END], pa.binary())]), tokens, ends
        at = to


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each token occurs in ``docs`` (text), ends included; counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def one() -> pa.Table:
            got = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table([got["word"], got["n_sum"]], ["word", "n"])
        for b in batches:
            for words, tokens, _ in tokens_of(b.column("text")):
                n = np.bincount(tokens, minlength=len(words))
                seen = n > 0
                held.append(pa.table([words.filter(pa.array(seen)), pa.array(n[seen], pa.int64())], ["word", "n"]))
                if sum(map(len, held)) > 400_000:
                    held = [one()]
                    if len(held[0]) > 400_000:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from one().to_batches()
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head of the counts (at most ``head`` words and the end), by count then word; what is shipped to tasks. Ids of the model: the first
    ``outputs`` words, then the buckets."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    mass: np.ndarray  # of each bucket: counts of its words that are no outputs, 0.1 a word, and 0.1
    made: Encoder | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def encoder(self, p: Gru) -> Encoder:
        """Made once in a process and kept: its tasks share what was broadcast to it."""
        if self.made is None or self.made.p != p:
            self.made = Encoder(self, p)
        return self.made

    def index(self, p: Gru) -> dict[bytes, int]:
        """Of each head word its number; an end that was never counted is put last."""
        at = {w: i for i, w in enumerate(self.words)}
        at.setdefault(END, len(self.words))
        return at


def vocabulary(counts: DataFrame, p: Gru) -> Vocabulary:
    """From the count table: at most ``p.head`` words, ``p.buckets`` sums and a histogram of some thousand steps
    come to the driver. The head is cut at a step of the histogram, so no task or driver ranks all words."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * 64)
    cut, held = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > p.head:
            break
        cut = r["step"]
    top = counts.where((step >= cut) | (F.col("word") == F.lit(END))).collect()
    top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    words, n = [bytes(r["word"]) for r in top], np.array([r["n"] for r in top], np.int64)
    if END in words[p.outputs:]:  # the end is always an output
        i = words.index(END)
        words.insert(0, words.pop(i))
        n = np.r_[n[i], np.delete(n, i)]
    spelled = F.concat(F.substring("word", 1, 1), F.substring("word", -2, 2))
    key = F.when(F.octet_length("word") == 1, F.concat("word", "word")).otherwise(spelled)
    sums = counts.groupBy((F.crc32(key) % p.buckets).alias("bucket")).agg((F.sum("n") + 0.1 * F.count(F.lit(1))).alias("mass")).collect()
    mass = np.full(p.buckets, 0.1)
    for r in sums:
        mass[int(r["bucket"])] += float(r["mass"])
    for w, c in zip(words[: p.outputs], n[: p.outputs]):
        mass[bucket_of(w, p.buckets)] -= c + 0.1
    return Vocabulary(words, n, int(total), int(distinct), np.maximum(mass, 0.1))


class Encoder:
    """Texts to the model's ids, with what is known of each word without the count table."""

    def __init__(self, v: Vocabulary, p: Gru):
        names = v.words if END in v.words else [*v.words, END]
        self.p, self.names = p, pa.array(names, pa.binary())
        n = len(names)
        counts = np.zeros(n)
        counts[: len(v.counts)] = v.counts
        self.log_count, self.log_mass = np.log10(counts + 0.1), np.log10(v.mass)
        ids, share = np.arange(n), np.zeros(n)
        if n > p.outputs:
            ids[p.outputs:] = p.outputs + self.buckets(names[p.outputs:])
            share[p.outputs:] = self.log_count[p.outputs:] - self.log_mass[ids[p.outputs:] - p.outputs]
        self.ids, self.share, self.known = ids, share, counts > 0
        self.end = int(ids[names.index(END)])

    def buckets(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((bucket_of(w, self.p.buckets) for w in words), np.int64, len(words))

    def __call__(self, text: str | None) -> tuple[np.ndarray, dict]:
        """The ids of a text and its end; and sums over its tokens."""
        ids, _, sums, rest = next(self.coded(pa.array([text], pa.string())))
        more = Counter({r["word"]: r["times"] for r in rest.to_pylist()[0]})
        return ids, {**{k: x.tolist()[0] for k, x in sums.items()}, "rest": more}

    def coded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, dict, pa.Array]]:
        """Of runs of rows of ``texts``: the ids of all their tokens, where in them each row ends, each row's sums, and
        each row's words beyond the head, with how often they occur."""
        for words, tokens, ends in tokens_of(texts):
            at = pc.fill_null(pc.index_in(words, self.names), -1).to_numpy()
            rare = np.flatnonzero(at < 0)
            ids, known, log_count, share = self.ids[at], self.known[at], self.log_count[at], self.share[at]
            bucket = self.buckets(words.take(pa.array(rare)).to_pylist())
            ids[rare], known[rare], log_count[rare], share[rare] = self.p.outputs + bucket, False, 0, -self.log_mass[bucket]
            first = np.r_[0, ends[:-1] + 1]
            sums = {"n": ends + 1 - first, "known": np.add.reduceat(known[tokens].astype(np.int64), first)}
            sums |= {k: np.add.reduceat(x[tokens], first) for k, x in (("log_count", log_count), ("share", share))}
            where = np.flatnonzero((at < 0)[tokens])
            key, times = np.unique(np.searchsorted(ends, where) * len(words) + tokens[where], return_counts=True)
            cut = np.searchsorted(key, np.arange(len(ends) + 1) * len(words))
            rest = pa.StructArray.from_arrays([words.take(pa.array(key % len(words))), pa.array(times, pa.int64())], ["word", "times"])
            yield ids[tokens], ends, sums, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rest)


def _train_task(sample: DataFrame, v, p: Gru) -> bytes:
    def learn(batches):
        rows = []
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns))
        rows.sort(key=lambda r: r[:3])
        yield pa.RecordBatch.from_arrays([pa.array([train([r[2] for r in rows], v.value, p).dump()], pa.binary())], ["network"])
    made = sample.repartition(1).mapInArrow(learn, "network binary").first()
    return bytes(made[0]) if made else train([], v.value, p).dump()


def train(texts: list[str | None], v: Vocabulary, p: Gru = DEFAULT) -> Network:
    """A network that has learned the texts in the order given; without any it is the unigram model."""
    e = v.encoder(p)
    frequency = np.zeros(p.size)
    k = min(len(v.words), p.outputs)
    frequency[:k] = v.counts[:k]
    frequency[p.outputs:] = v.mass
    net = Network.new(p, frequency)
    if texts:
        rows = [ids for ids, *_ in e.coded(pa.array(texts, pa.string()))]
        net.learn(np.concatenate([[e.end], *rows]), e.end, p.streams, p.epochs, 1.0, 0.5)
    return net


def encoded(docs: DataFrame, shipped, p: Gru) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as the model reads it: its ids (one after the other, as ``p.kind``), the
    round that learns it (null: held out), its sums, its words beyond the head, and a number of its own. Written once:
    that number, drawn at random, holds from here on, and texts are cut into words for the last time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shipped.value.encoder(p)
        salt = int.from_bytes(os.urandom(8), "little") >> 1
        row = 0
        for b in batches:
            at = 0
            for ids, ends, sums, rest in e.coded(b.column("text")):
                n = len(ends)
                keys = [(salt + (row + i) * 0x9E3779B97F4A7C15) % (1 << 63) for i in range(n)]
                cut = np.r_[0, ends + 1] * p.kind.itemsize
                raw = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(ids.astype(p.kind))])
                cols = [b.column("doc_id").slice(at, n), b.column("turn").slice(at, n), pa.array(keys, pa.int64()), *(pa.array(sums[k]) for k in ("n", "known", "log_count", "share")), raw, rest]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "turn", "row", "n_tokens", "known", "log_count", "share", "ids", "rest"])
                at, row = at + n, row + n
    turn = F.when(~held_out(F.col("doc_id")), F.pmod(F.xxhash64("doc_id"), F.lit(p.rounds)))
    schema = "doc_id long, turn long, row long, n_tokens long, known long, log_count double, share double, ids binary, rest array<struct<word:binary,times:bigint>>"
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), turn.alias("turn"), "text").mapInArrow(run, schema), "encoded")


def _merged(networks: DataFrame, p: Gru) -> bytes | None:
    """The mean of networks (network, tokens) by their tokens, 32 to a task until one is left; None if there are none."""
    def mean(batches):
        total, parts = 0, {}
        for b in batches:
            for raw, n in zip(b.column("network"), b.column("tokens").to_pylist()):
                total += n
                for k, x in Network.load(p, raw.as_py()).parts.items():
                    parts[k] = parts.get(k, 0.0) + x.astype(np.float64) * n
        if total:
            out = Network(p, {k: (x / total).astype(np.float32) for k, x in parts.items()}).dump()
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary()), pa.array([total], pa.int64())], ["network", "tokens"])
    written, left = [durable(networks, "networks")], 0
    while True:
        left = written[-1].count()
        if left < 2:
            break
        written.append(durable(written[-1].repartition(-(-left // 32)).mapInArrow(mean, "network binary, tokens long"), "networks"))
    got = written[-1].first()
    remove(*written)
    return bytes(got["network"]) if got else None


def learn_all(learned: DataFrame, network: bytes, v: Vocabulary, p: Gru) -> bytes:
    """The network after it has learned every document of ``learned`` (doc_id, text) once, in rounds by the id's hash."""
    shipped = learned.sparkSession.sparkContext.broadcast(v)
    rows = encoded(learned, shipped, p)
    out = learn_rounds(rows, network, v, p)
    remove(rows)
    return out


def learn_rounds(rows: DataFrame, network: bytes, v: Vocabulary, p: Gru) -> bytes:
    """The network after it has learned, in rounds, every row of ``encoded`` that is not held out."""
    spark = rows.sparkSession.sparkContext
    end = v.index(p)[END]
    for turn in range(p.rounds):
        sent = spark.broadcast(network)
        rate = 0.5 - 0.45 * turn / max(p.rounds - 1, 1)

        def learn(batches, sent=sent, rate=rate):
            net = Network.load(p, sent.value)
            held, total = np.array([end], p.kind), 0
            for b in batches:
                held = np.r_[held, np.frombuffer(b"".join(b.column("ids").to_pylist()), p.kind)]
                while len(held) > p.block:
                    total += net.learn(held[:p.block].astype(np.int64), end, p.lanes, 1, rate, rate)
                    held = held[p.block - 1:]
            n = len(held) - 1
            if n:
                total += net.learn(held.astype(np.int64), end, max(1, min(p.lanes, n // p.unroll)), 1, rate, rate)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary()), pa.array([total], pa.int64())], ["network", "tokens"])
        part = rows.where(F.col("turn") == turn).select("ids")
        tasks = max(1, -(-v.total // (p.share * p.rounds)))
        network = _merged(part.coalesce(tasks).mapInArrow(learn, "network binary, tokens long"), p) or network
        sent.unpersist()
    return network


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 10) == 0


def score_documents(docs: DataFrame, p: Gru = DEFAULT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Null texts count as empty: one token, the end. A null doc_id counts as held out. Repeated rows are
    counted and scored as often as they occur. If nothing may be learned from, no word is known, the base
    gives every token probability 1 and the network is the uniform unigram model. An empty table gives
    no rows. Scores are log10 of the text's probability.
    """
    spark = docs.sparkSession
    mine = docs.select("doc_id", "text")
    learned = mine.where(~held_out(F.col("doc_id")))
    counts = durable(count_words(learned), "counts")
    v = vocabulary(counts, p)
    shipped = spark.sparkContext.broadcast(v)
    ids = learned.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.train_rows)
    sample = learned.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    start = _train_task(sample.select(F.xxhash64("doc_id").alias("at"), "doc_id", "text"), shipped, p)
    rows = encoded(mine, shipped, p)
    network = spark.sparkContext.broadcast(learn_rounds(rows, start, v, p))
    end = v.index(p)[END]
    same = ["doc_id", "row", "n_tokens", "known", "log_count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(p, network.value)
        for b in batches:
            to = np.cumsum(b.column("n_tokens").to_numpy())
            at = 0
            while at < len(to):
                n = max(1, int(np.searchsorted(to, 3_000_000 + (to[at - 1] if at else 0), "right")) - at)
                part = b.slice(at, n)
                got = net.score([np.frombuffer(x.as_buffer(), p.kind) for x in part.column("ids")], end) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in same), pa.array(got + part.column("share").to_numpy())], [*same, "model"])
                at += n
    schema = "doc_id long, row long, n_tokens long, known long, log_count double, model double"
    part = durable(rows.select(*same, "share", "ids").mapInArrow(run, schema), "scored")
    rest = rows.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    counted = rest.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rest_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    both = part.join(counted, "row", "left")
    more = F.coalesce("rest_log", F.lit(0.0))
    norm = float(np.log10(v.total + 0.1 * (v.distinct + 1)))
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("log_count") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("model") + more).alias("score"))


def op1_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
