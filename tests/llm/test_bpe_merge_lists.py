"""The token automaton against plain merging, on random merge lists: large token numbers, merges that never fire."""

import itertools
import random

import pytest

from loomgraph.llm import bpe

CHARS = {v: k for k, v in bpe.byte_alphabet().items()}
WORDS = [bytes(w) for n in range(1, 8) for w in itertools.product(b"abc", repeat=n)]


def merged(word, merges, vocab):
    """Pairs merged in the order of the list, each from the left."""
    parts = [CHARS[b] for b in word]
    for u, v in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (u, v):
                parts[i:i + 2] = [u + v]
            i += 1
    return [vocab[x] for x in parts]


def lists(rng, proper):
    """Random merge lists; a proper one only merges what stands side by side in some word by then."""
    tokens, merges = [CHARS[b] for b in b"abc"], []
    for _ in range(rng.randint(1, 9)):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if len(u + v) > 6 or u + v in tokens:
            continue
        if proper:
            made = merged((u + v).encode("latin-1"), merges, {t: t for t in tokens})
            if made != [u, v]:
                continue
        merges.append((u, v))
        tokens.append(u + v)
    return tokens, merges


@pytest.mark.parametrize("proper", [True, False])
@pytest.mark.parametrize("most", [60, 70_000, 2**31 - 1])
def test_any_merge_list_and_any_token_numbers(proper, most):
    rng = random.Random(most + proper)
    for _ in range(25):
        tokens, merges = lists(rng, proper)
        vocab = dict(zip(tokens, rng.sample(range(most), len(tokens))))
        auto = bpe.Automaton(vocab, merges)
        for word in WORDS:
            assert auto.encode_word(word) == merged(word, merges, vocab), (merges, word)
