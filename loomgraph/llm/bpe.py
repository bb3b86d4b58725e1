"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads *tokens*: a path from the start spells a token sequence, and it is accepted only
if it is the sequence that the merge list yields for its own bytes. It starts as one state with a
loop for each byte. Each merge ``u v -> w`` then applies one gadget: the state that arcs ``u`` lead to
is split, its copy loses the arc ``v`` (the pair is merged now, so ``v`` may no longer follow ``u``),
and an arc ``w`` is added that leads where ``u`` then ``v`` led. A gadget therefore adds one state: a
copy of an older one less one arc. Copies are kept as (parent, arc cut, time), not as dense rows, so
50,000 merges compile in well under a second and take a few megabytes.

Only one tokenization of a pre-split word is accepted. It is not found by transitions of those states, but
by a search: the longest label first, if its token may follow the last one (derived when first asked,
then kept), and back from positions that are dead.
Decoding concatenates the labels of the arcs.
"""

from __future__ import annotations

import array
import hashlib
import json
import struct
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import map_arrow, table

#: Fixed value: the pre-splitting pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words longer than this are encoded but not kept in the per-task cache.
CACHED_WORD = 64
CACHE_WORDS = 400_000
CACHE_ARCS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file, as character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are numbered; state ``target[t]`` is where every arc labelled ``t`` leads."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int] | None = None):
        chars = byte_alphabet()
        self.label: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.special = dict(special or {})
        self.label.update({i: s.encode() for s, i in self.special.items()})
        self.parts: dict[int, tuple[int, int, int]] = {}
        # A state: (state it copies, label it loses, time of the gadget); state 0 has every byte's loop.
        self.parent, self.cut, self.time = [0], [-1], [-1]
        self.target: dict[int, int] = {}
        self.lost: dict[tuple[int, int], int] = {}
        self.base: dict[int, tuple[int, int]] = {}
        for token, i in vocab.items():
            if len(token) == 1:
                self.target[i] = 0
                self.base[i] = (-1, -1)
        for now, pair in enumerate(merges):
            left, right = pair if not isinstance(pair, str) else pair.split(" ", 1)
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            # A merge of two tokens that never stand side by side by then does nothing, and makes no token.
            if u in self.base and v in self.base and self._derive(u, v):
                self._gadget(u, v, w, now)
        self._arcs: dict[int, bool] = {}
        self._labels = {self.label[i]: i for i in self.base}
        self._reach: dict[bytes, int] = {}  # the longest label that begins with these four bytes
        for b in self._labels:
            if len(b) >= 4 and len(b) > self._reach.get(b[:4], 3):
                self._reach[b[:4]] = len(b)

    def _gadget(self, u: int, v: int, w: int, now: int) -> None:
        if w not in self.base:
            self.parts[w] = (u, v, now)
            self.target[w] = self.target[v]
            self.base[w] = (v, now)
        self.parent.append(self.target[u])
        self.cut.append(v)
        self.time.append(now)
        self.target[u] = len(self.parent) - 1
        self.lost.setdefault((u, v), now)

    def has_arc(self, last: int, token: int) -> bool:
        """Whether the state that arcs ``last`` lead to has an arc ``token`` (last -1: the start)."""
        key = (last << 32) + token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= CACHE_ARCS:
                self._arcs.clear()
            known = self._arcs[key] = self._derive(last, token)
        return known

    def _derive(self, last: int, token: int) -> bool:
        # Undo gadgets from the newest to the oldest that made either side: a state copied from v's
        # had v's arcs at that time, an arc w existed where the arc u existed at that time.
        until = self.time[-1] + 1
        while True:
            cut = self.lost.get((last, token))
            if cut is not None and cut < until:
                return False
            made_last = self.base[last][1] if last >= 0 else -1
            made_token = self.parts[token][2] if token in self.parts else -1
            if made_last < 0 and made_token < 0:
                return True
            # A token twice in a row: its state was copied first, then its arc was added. The arc is
            # added after the cut, which matters for a pair of equal tokens (the left pair merges).
            if made_token >= made_last:
                until, token = made_token + 1, self.parts[token][0]
            else:
                until, last = made_last, self.base[last][0]

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the accepting path for ``word``: longest arc first, dead positions left once."""
        n, at, q = len(word), 0, -1
        path: list[int] = []
        labels, arcs, reach = self._labels, self._arcs, self._reach
        dead: set[int] = set()
        end = n
        while at < n:
            most = at + reach.get(word[at:at + 4], 3)
            if end > most:
                end = most
            while end > at:
                token = labels.get(word[at:end])
                if token is not None and end not in dead:
                    ok = arcs.get((q << 32) + token)
                    if ok is None:
                        ok = self.has_arc(q, token)
                    if ok:
                        break
                end -= 1
            if end > at:
                path.append(token)
                q, at, end = token, end, n
            else:
                if not path:
                    raise ValueError("a byte has no token in this vocabulary")
                dead.add(at)
                end = at - 1
                at -= len(self.label[path.pop()])
                q = path[-1] if path else -1
        return path


class Codec:
    """Whole texts: added tokens first, then the split pattern, then the automaton on each word.

    A space or line feed between two characters that are no white space always starts a new word, so
    texts are cut there first and each such chunk is split on its own. The ids of chunks and words are
    kept, as little-endian 32-bit integers, in caches of bounded size (two generations each: a full one
    becomes the old one).
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.auto = Automaton(model["vocab"], model["merges"], added)
        self.added = added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(SPLIT).findall
        self.blank = regex.compile(r"[\s\x1c-\x1f]").search
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.labels = [self.auto.label.get(i, b"") for i in range(max(self.auto.label, default=-1) + 1)]

    def _word(self, word: str) -> bytes:
        got = self.old_words.get(word)
        if got is None:
            ids = self.auto.encode_word(word.encode())
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) > CACHED_WORD:
                return got
        if len(self.young_words) >= CACHE_WORDS:
            self.old_words, self.young_words = self.young_words, {}
        self.young_words[word] = got
        return got

    def _pack(self, text: str) -> bytes:
        """Ids of a text that stands alone, by the split pattern."""
        out = []
        for w in self.words(text):
            out.append(self.young_words.get(w) or self._word(w))
        return b"".join(out)

    def _miss(self, chunk: str) -> bytes | None:
        """Ids of a chunk with the space before it (or the line feed that begins it); None if it can't be cut off there."""
        got = self.old.get(chunk)
        if got is None:
            body = chunk[1:] if chunk[:1] == "\n" else chunk
            if not body or self.blank(body[0]) or self.blank(body[-1]):
                return None
            got = self._pack(chunk if body is not chunk else " " + chunk)
            if len(chunk) > CACHED_WORD or self.blank(body):
                return got
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[chunk] = got
        return got

    def _piece(self, text: str) -> bytes:
        chunks = text.replace("\n", " \n").split(" ")
        if len(chunks) == 1 or not chunks[0] or self.blank(chunks[0][-1]):
            return self._pack(text)
        get = self.young.get
        out = [self._pack(chunks[0])]
        for chunk in chunks[1:]:
            ids = get(chunk)
            if ids is None:
                ids = self._miss(chunk)
                if ids is None:
                    return self._pack(text)
                get = self.young.get
            out.append(ids)
        return b"".join(out)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(a in text for a in self.added):
            return self._piece(text)
        return b"".join(self._piece(p) if p not in self.added else struct.pack("<I", self.added[p]) for p in self.cut.split(text) if p)

    def encode(self, text: str | None) -> list[int]:
        return array.array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(spec_path: str) -> Codec:
    """One codec for a worker process. The vocabulary is installed with its package on every machine."""
    with open(spec_path, encoding="utf-8") as f:
        return Codec(json.load(f))


def encode_documents(docs: DataFrame, spec_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null and empty texts have no ids, repeated rows stay."""
    def make():
        c = codec(spec_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [c.encode(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        return step
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, spec_path: str) -> DataFrame:
    """(doc_id, ids, text): the texts that the ids spell; byte sequences that are no UTF-8 are replaced."""
    def make():
        c = codec(spec_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [c.decode(i or []) for i in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
        return step
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, ids array<int>, text string")


def digest_documents(docs: DataFrame, spec_path: str) -> DataFrame:
    """Round trip in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Ids and texts stay in the task that makes them. A null doc_id stays null; repeated rows give
    repeated results; there is no length limit.
    """
    def make():
        c = codec(spec_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for text in batch.column("text"):
                packed = c.encode_bytes(text.as_py())
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(c.decode(array.array("I", packed)).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return step
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
