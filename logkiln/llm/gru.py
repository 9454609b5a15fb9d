"""A gated recurrent language model in numpy, with a class-factored softmax.

Tokens are numbers by frequency: 0 to ``CLASSES`` x ``PER_CLASS`` - 1 are the shortlist, in classes of
``PER_CLASS`` neighbours; every other token is ``OTHER``, which has a class of its own. The probability of a token is that of
its class times that of the token in the class. Documents are laid one after another into lanes that are
worked through together in windows of ``STEPS`` tokens: the state is carried from window to window and
set to zero where a document starts, and gradients stop at a window's start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN, CLASSES, PER_CLASS, STEPS, LANES = 12, 32, 32, 16, 256
#: Lanes where nothing is learned; how many does not change a score.
SCORED = 1024
SHORT = CLASSES * PER_CLASS
OTHER, END = SHORT, 0
RATE = 0.1
SHAPES = {"gates": (SHORT + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES + 1), "bc": (CLASSES + 1,), "ww": (CLASSES, HIDDEN, PER_CLASS), "bw": (CLASSES, PER_CLASS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """First parameters: small random weights, biases from the tokens' counts (shortlist, then all others together)."""
    flat = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    p = unpack(flat)
    c = np.zeros(SHORT + 1)
    c[: len(counts)] = counts
    words = np.log(c[:SHORT].reshape(CLASSES, PER_CLASS) + 0.1)
    p["bw"][:] = words
    p["bc"][:] = np.log(np.append(c[:SHORT].reshape(CLASSES, PER_CLASS).sum(axis=1), c[SHORT]) + 0.1)
    p["bc"] -= p["bc"].max()
    return flat


class Lanes:
    """Documents in lanes, longest lanes first; a lane's documents follow each other."""

    def __init__(self, docs: list[np.ndarray], lanes: int = LANES):
        order = sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i))
        loads = [(0, k, []) for k in range(min(lanes, len(docs)))]
        for i in order:
            size, k, own = heapq.heappop(loads)
            own.append(i)
            heapq.heappush(loads, (size + len(docs[i]), k, own))
        loads.sort(key=lambda x: (-x[0], x[1]))
        self.lanes = [own for _, _, own in loads]
        self.lengths = np.array([size for size, _, _ in loads])
        width = -(-int(self.lengths.max(initial=0)) // STEPS) * STEPS
        self.targets = np.full((len(loads), width), OTHER, np.int16)
        self.fresh = np.zeros((len(loads), width), bool)
        for row, own in enumerate(self.lanes):
            at = 0
            for i in own:
                self.targets[row, at : at + len(docs[i])] = docs[i]
                if len(docs[i]):
                    self.fresh[row, at] = True
                at += len(docs[i])

    def windows(self) -> Iterator[tuple[int, int]]:
        """(first token, lanes that reach it)."""
        for at in range(0, self.targets.shape[1], STEPS):
            yield at, int((self.lengths > at).sum())

    def sums(self, scores: np.ndarray, docs: int, lengths: list[int]) -> np.ndarray:
        """Totals by document of scores laid out as the lanes are."""
        out = np.zeros(docs)
        for row, own in enumerate(self.lanes):
            total = np.concatenate([[0.0], np.cumsum(scores[row], dtype=np.float64)])
            at = 0
            for i in own:
                out[i] = total[at + lengths[i]] - total[at]
                at += lengths[i]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = 0.5 * x
    np.tanh(out, out=out)
    out *= 0.5
    out += 0.5
    return out


def forward(p: dict, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray):
    """States of a window: inputs and fresh are [lanes, steps]; gives [steps, lanes, HIDDEN] and what the way back needs."""
    kept, H = [], HIDDEN
    states = np.empty((inputs.shape[1], len(h), H), h.dtype)
    gates, kept_on = p["gates"][inputs.T], ~fresh.T[:, :, None]
    for t in range(inputs.shape[1]):
        keep = kept_on[t]
        h = h * keep
        x, r_ = gates[t], h @ p["u"]
        zr = _sigmoid(x[:, : 2 * H] + r_[:, : 2 * H])
        z, r, m = zr[:, :H], zr[:, H:], r_[:, 2 * H :]
        n = r * m
        n += x[:, 2 * H :]
        np.tanh(n, out=n)
        kept.append((h, z, r, m, n, keep))
        h = np.subtract(h, n, out=states[t])
        h *= z
        h += n
    return states, kept


def _largest(x: np.ndarray) -> np.ndarray:
    """The largest of each row, by turned blocks of rows: along short rows numpy takes two to three times as long."""
    out = np.empty((len(x), 1), x.dtype)
    for at in range(0, len(x), 512):
        out[at : at + 512, 0] = np.ascontiguousarray(x[at : at + 512].T).max(axis=0)
    return out


def _softmax(x: np.ndarray, target: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the targets, and the probabilities of all, which take the place of x; without ``whole`` they are left undivided."""
    x -= _largest(x)
    own = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    if whole:
        x /= total
    return own - np.log(total[:, 0]), x


def output(p: dict, s: np.ndarray, targets: np.ndarray, weight: np.ndarray | None = None):
    """Log-likelihoods (natural) of targets after states s; with weights also the gradients, of the negative sum."""
    cls = targets // PER_CLASS
    first = s @ p["wc"]
    first += p["bc"]
    out, d = _softmax(first, cls, weight is not None)
    # Tokens on the shortlist in the order of their classes, so that each class is a slice.
    listed = np.flatnonzero(targets < SHORT)
    order = listed[np.argsort(targets[listed].astype(np.int16), kind="stable")]
    own, c, k = s[order], cls[order], targets[order] % PER_CLASS
    edges = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    slices = [(i, slice(a, z)) for i, (a, z) in enumerate(zip(edges, edges[1:])) if z > a]
    logits = np.empty((len(order), PER_CLASS), s.dtype)
    for i, part in slices:
        np.matmul(own[part], p["ww"][i], out=logits[part])
        logits[part] += p["bw"][i]
    logs, e = _softmax(logits, k, weight is not None)
    out[order] += logs
    if weight is None:
        return out, None, None
    d[np.arange(len(s)), cls] -= 1
    d *= weight[:, None]
    grads = {"wc": s.T @ d, "bc": d.sum(axis=0), "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
    ds = d @ p["wc"].T
    e[np.arange(len(order)), k] -= 1
    e *= weight[order, None]
    back = np.empty_like(own)
    for i, part in slices:
        np.matmul(own[part].T, e[part], out=grads["ww"][i])
        np.matmul(e[part], p["ww"][i].T, out=back[part])
        grads["bw"][i] = e[part].sum(axis=0)
    ds[order] += back
    return out, grads, ds


def backward(p: dict, kept: list, ds: np.ndarray, inputs: np.ndarray) -> dict:
    """Gradients of a window's gates from those of its states."""
    H, dh, du = HIDDEN, np.zeros_like(ds[0]), np.zeros_like(p["u"])
    dx = np.empty((len(kept), ds.shape[1], 3 * H), ds.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, m, n, keep = kept[t]
        dh = dh + ds[t]
        dn = dh * (1 - z) * (1 - n * n)
        g = dx[t]
        g[:, :H], g[:, H : 2 * H], g[:, 2 * H :] = dh * (h - n) * z * (1 - z), dn * m * r * (1 - r), dn
        dpre = g.copy()
        dpre[:, 2 * H :] *= r
        du += h.T @ dpre
        dh = (dh * z + dpre @ p["u"].T) * keep
    ids = inputs.T.reshape(-1)
    order = np.argsort(ids, kind="stable")
    rows, first = np.unique(ids[order], return_index=True)
    return {"u": du, "rows": rows, "gates": np.add.reduceat(dx.reshape(-1, 3 * H)[order], first, axis=0)}


def _windows(lanes: Lanes):
    """(at, lanes, inputs, fresh, targets) of each window; a document's first input is the end of the last."""
    before = np.concatenate([np.full((len(lanes.lanes), 1), END, np.int16), lanes.targets[:, :-1]], axis=1)
    before[lanes.fresh] = END
    for at, n in lanes.windows():
        part = slice(at, at + STEPS)
        yield at, n, before[:n, part], lanes.fresh[:n, part], lanes.targets[:n, part]


def train(flat: np.ndarray, docs: list[np.ndarray], squares: np.ndarray) -> int:
    """One pass over some documents. Gradients are divided by the tokens of a full window, so the last windows,
    of few long documents, weigh little. Parameters and squared gradients are changed in place. Gives the tokens seen."""
    lanes, p, g2 = Lanes(docs), unpack(flat), unpack(squares)
    h, seen = np.zeros((len(lanes.lanes), HIDDEN), np.float32), 0
    for at, n, inputs, fresh, targets in _windows(lanes):
        states, kept = forward(p, h[:n], inputs, fresh)
        h = states[-1]
        weight = (np.arange(at, at + STEPS)[:, None] < lanes.lengths[None, :n]).astype(np.float32)
        count = int(weight.sum())
        _, grads, ds = output(p, states.reshape(-1, HIDDEN), targets.T.reshape(-1).astype(np.int64), weight.reshape(-1) / (LANES * STEPS))
        back = backward(p, kept, ds.reshape(states.shape), inputs)
        grads["u"] = back["u"]
        for name, g in grads.items():
            g2[name][...] += g * g
            p[name][...] -= RATE * g / (np.sqrt(g2[name]) + 1e-6)
        rows, g = back["rows"], back["gates"]
        g2["gates"][rows] += g * g
        p["gates"][rows] -= RATE * g / (np.sqrt(g2["gates"][rows]) + 1e-6)
        seen += count
    return seen


def score(flat: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document, whole; of tokens off the shortlist that of their class."""
    lanes, p = Lanes(docs, SCORED), unpack(flat)
    out = np.zeros(lanes.targets.shape, np.float32)
    h = np.zeros((len(lanes.lanes), HIDDEN), np.float32)
    for at, n, inputs, fresh, targets in _windows(lanes):
        states, _ = forward(p, h[:n], inputs, fresh)
        h = states[-1]
        got, _, _ = output(p, states.reshape(-1, HIDDEN), targets.T.reshape(-1).astype(np.int64))
        out[:n, at : at + STEPS] = got.reshape(-1, n).T
    return lanes.sums(out, len(docs), [len(d) for d in docs])
