"""Kernels of the language model against plain formulas, scoring in lanes, and what a process makes once."""

import pickle

import numpy as np
import pytest

from loomgraph.llm import grulm

P = grulm.Gru(outputs=12, buckets=4, classes=4, hidden=6, unroll=4, together=4, window=8)


def _network(scale: float = 1.0) -> grulm.Network:
    rng = np.random.default_rng(5)
    net = grulm.Network.new(P, np.arange(16.0))
    net.parts = {k: (scale * rng.normal(size=x.shape)).astype(np.float32) for k, x in net.parts.items()}
    return net


@pytest.mark.parametrize("scale", [0.3, 3, 200])
def test_states_and_softmaxes_are_those_of_the_plain_formulas(scale):
    """Also where gates are shut and where logits leave the range of the exponential."""
    net, rng, n = _network(scale), np.random.default_rng(1), P.hidden
    w = {k: x.astype(np.float64) for k, x in net.parts.items()}
    ids, h = rng.integers(0, 16, (7, 5)), rng.normal(size=(5, n)).astype(np.float32)
    keep = rng.random((7, 5)) > 0.3
    want, state = [], h.astype(np.float64)
    with np.errstate(over="ignore"):
        for i, k in zip(ids, keep):
            state = state * k[:, None]
            x, u = w["x"][i] + w["b"], state @ w["u"]
            z, r = (1 / (1 + np.exp(-(x + u)[:, s:s + n])) for s in (0, n))
            new = np.tanh(x[:, 2 * n:] + r * u[:, 2 * n:])
            state = new + z * (state - new)
            want.append(state)
    if scale < 100:  # beyond, float32 decides which gate is open
        assert np.allclose(net.run(h, ids, keep)[0], want, atol=1e-4)
        assert np.allclose(net.run(h, ids, keep, taped=True)[0], want, atol=1e-4)
    assert np.isfinite(net.run(h, ids, keep)[0]).all()
    s, t = rng.normal(size=(40, n)).astype(np.float32), rng.integers(0, 16, 40)
    outer, inner = s @ w["wc"] + w["bc"], np.einsum("rh,rhw->rw", s, w["ww"][t // 4]) + w["bw"][t // 4]
    plain = sum(e[np.arange(40), a] - np.logaddexp.reduce(e, axis=1) for e, a in ((outer, t // 4), (inner, t % 4)))
    grads = {k: np.zeros_like(x) for k, x in net.parts.items()}
    got, d = net.log_p(s, t, grads)
    assert np.allclose(got, plain, rtol=1e-4, atol=1e-3) and np.isfinite(d).all()


def test_a_long_document_holds_no_others_up(monkeypatch):
    """Steps are those of the longest lane; every document has the score that it has alone."""
    net, rng, seen, real = _network(), np.random.default_rng(2), [], grulm.Network.run

    def run(self, h, ids, *more, **named):
        seen.append(len(ids))
        return real(self, h, ids, *more, **named)
    texts = [np.r_[rng.integers(1, 16, k - 1), 0] for k in (16, 16, 64, *[16] * 10)]
    alone = [net.score([t], 0)[0] for t in texts]
    monkeypatch.setattr(grulm.Network, "run", run)
    assert net.score(texts, 0) == pytest.approx(alone, rel=1e-4)
    assert sum(seen) == 64
    assert net.score([], 0).tolist() == []


def test_a_process_makes_one_encoder():
    v = grulm.Vocabulary([b"", b"a"], np.array([3, 2]), 5, 2, np.ones(P.buckets))
    assert v.encoder(P) is v.encoder(P)
    sent = pickle.loads(pickle.dumps(v))
    assert sent.made is None and sent.encoder(P)("a b")[0].tolist() == v.encoder(P)("a b")[0].tolist()
