"""A gated recurrent language model in numpy, with a class-factored output.

A word's probability is that of its class given the state, times that of the word in
its class given the state.  Words outside the model's vocabulary end in a tail class,
where the caller knows their share.  Inputs are words (or tail classes) and index the
gate weights directly.  Gradients run back over windows of ``WINDOW`` steps; states
are carried from window to window of a document and start at zero.
"""

from __future__ import annotations

import math

import numpy as np

HIDDEN = 16
WINDOW = 12
#: Streams grow with the tokens, so that a call makes about so many updates, up to a number of streams.
UPDATES = 128
MOST_STREAMS = 512
RATE = 0.08
_BLOCK = 4096


def new_model(class_bias: np.ndarray, word_bias: np.ndarray, inputs: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Starts at the class and word frequencies given by the biases."""
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        # reset gate, update gate and new state, one after the other
        "x": normal(3, inputs, hidden, scale=0.1),
        "u": normal(3, hidden, hidden, scale=0.25),
        # the update gate starts mostly closed, so that a state lasts
        "b": np.stack([np.zeros(hidden), np.full(hidden, 2.0), np.zeros(hidden)])[:, None].astype(np.float32),
        "w": normal(hidden, len(class_bias), scale=0.05),
        "c": class_bias.astype(np.float32),
        "v": normal(len(word_bias), hidden, scale=0.05),
        "d": word_bias.astype(np.float32),
    }


def _sigmoid(z: np.ndarray) -> np.ndarray:
    z *= 0.5
    np.tanh(z, out=z)
    z *= 0.5
    z += 0.5
    return z


def step(p: dict, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The next state of each row; keep gets what the way back needs."""
    a = h @ p["u"]
    g = np.take(p["x"], x, axis=1)
    g += p["b"]
    g[:2] += a[:2]
    r, z = _sigmoid(g[:2])
    new = r * a[2]
    new += g[2]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    if keep is not None:
        keep.append((h, r, z, new, a[2]))
    return out


def _by_class(classes: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]], int]:
    """An order of rows that puts those of one class together; slices (a, b) of classes of several words with their words [lo, hi); the number of rows in classes of words."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(len(spans))).tolist()
    slices = zip(cuts[:-1], cuts[1:], spans[:-1].tolist(), spans[1:].tolist(), strict=True)
    return order, [x for x in slices if x[1] > x[0] and x[3] - x[2] > 1], cuts[-1]


def log_likelihood(p: dict, spans: np.ndarray, states: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log of P(class) * P(word in class); words is -1 for tail classes."""
    out = np.empty(len(states), dtype=np.float32)
    ones = np.ones(max(p["w"].shape[1], len(p["v"])), dtype=np.float32)
    for low in range(0, len(states), _BLOCK):
        h, k, w = states[low : low + _BLOCK], classes[low : low + _BLOCK], words[low : low + _BLOCK]
        logits = h @ p["w"]
        logits += p["c"]
        part = logits[np.arange(len(h)), k]
        # states lie in (-1, 1) and weights stay small, so exponentials stay in range
        np.exp(logits, out=logits)
        part -= np.log(logits @ ones[: logits.shape[1]])
        order, slices, n = _by_class(k, spans)
        inside, w, inner_part = np.take(h, order[:n], axis=0), w[order[:n]], np.zeros(n, dtype=np.float32)
        for a, b, lo, hi in slices:
            inner = inside[a:b] @ p["v"][lo:hi].T
            inner += p["d"][lo:hi]
            own = inner[np.arange(b - a), w[a:b] - lo]
            np.exp(inner, out=inner)
            inner_part[a:b] = own - np.log(inner @ ones[: hi - lo])
        part[order[:n]] += inner_part
        out[low : low + _BLOCK] = part
    return out


def document_scores(p: dict, spans: np.ndarray, start: int, inputs: list[np.ndarray], classes: list[np.ndarray], words: list[np.ndarray]) -> np.ndarray:
    """Log-likelihood of each whole document; all run in step, longest first, so those still running are the first rows."""
    lengths = np.array([len(x) for x in inputs])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    total = np.zeros(len(order))
    begins = np.append(0, np.cumsum(lengths))
    if not begins[-1]:
        return total
    flat_x, flat_k, flat_w = (np.concatenate([part[i] for i in order]) for part in (inputs, classes, words))
    state = np.zeros((len(order), p["u"].shape[1]), dtype=np.float32)
    last = np.full(len(order), start)
    running = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for t, n in enumerate(running):
        state = step(p, last[:n], state[:n])
        at = begins[:n] + t
        last = flat_x[at]
        held.append((state, at))
        size += n
        if size >= _BLOCK or t + 1 == len(running):
            at = np.concatenate([a for _, a in held])
            found = log_likelihood(p, spans, np.concatenate([h for h, _ in held]), flat_k[at], flat_w[at])
            rows = np.concatenate([np.arange(len(a)) for _, a in held])
            total += np.bincount(rows, weights=found, minlength=len(total))
            held, size = [], 0
    out = np.empty_like(total)
    out[order] = total
    return out


class Trainer:
    """Adagrad on windows of parallel streams; a stream is a row of documents one after the other."""

    def __init__(self, p: dict, spans: np.ndarray, start: int, rate: float = RATE):
        self.p, self.spans, self.start, self.rate = {k: v.copy() for k, v in p.items()}, spans, start, rate
        self.squares = {k: np.full_like(v, 1e-4) for k, v in p.items()}

    def _apply(self, name: str, gradient: np.ndarray, at=slice(None)) -> None:
        np.clip(gradient, -1, 1, out=gradient)
        square = self.squares[name][at] + gradient * gradient
        self.squares[name][at] = square
        self.p[name][at] -= self.rate * gradient / np.sqrt(square)

    def window(self, x: np.ndarray, fresh: np.ndarray, classes: np.ndarray, words: np.ndarray, counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """One update from (steps, streams) arrays; fresh marks first tokens of documents, counts is 0 for padding.  Returns the states carried on, and the loss over the number of streams."""
        p, n = self.p, h.shape[1]
        kept: list = []
        states = []
        for t in range(len(x)):
            if (begun := np.flatnonzero(fresh[t])).size:
                h = h.copy()
                h[begun] = 0
            h = step(p, x[t], h, kept)
            states.append(h)
        flat, k, w = np.concatenate(states), classes.ravel(), words.ravel()
        scale = (counts.ravel() / x.shape[1]).astype(np.float32)
        ones = np.ones(max(p["w"].shape[1], len(p["v"])), dtype=np.float32)
        logits = flat @ p["w"]
        logits += p["c"]
        at = np.arange(len(k)), k
        own = logits[at]
        prob = np.exp(logits, out=logits)
        norm = prob @ ones[: prob.shape[1]]
        loss = float(((np.log(norm) - own) * scale).sum())
        prob *= (scale / norm)[:, None]
        prob[at] -= scale
        back = prob @ p["w"].T
        gradients = {"w": flat.T @ prob, "c": prob.sum(axis=0)}
        dv, dd = np.zeros_like(p["v"]), np.zeros_like(p["d"])
        order, slices, m = _by_class(k, self.spans)
        inside, w, part = np.take(flat, order[:m], axis=0), w[order[:m]], scale[order[:m]]
        inner_back = np.zeros_like(inside)
        for a, b, lo, hi in slices:
            v = p["v"][lo:hi]
            inner = inside[a:b] @ v.T
            inner += p["d"][lo:hi]
            at = np.arange(b - a), w[a:b] - lo
            own = inner[at]
            np.exp(inner, out=inner)
            norm = inner @ ones[: hi - lo]
            loss += float(((np.log(norm) - own) * part[a:b]).sum())
            inner *= (part[a:b] / norm)[:, None]
            inner[at] -= part[a:b]
            inner_back[a:b] = inner @ v
            dv[lo:hi], dd[lo:hi] = inner.T @ inside[a:b], inner.sum(axis=0)
        back[order[:m]] += inner_back
        back = back.reshape(len(x), -1, n)
        # gradients of the gates before their functions; of the new state also times the reset gate
        d = np.empty((4, *x.shape, n), dtype=np.float32)
        dh = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            before, r, z, new, a = kept[t]
            dh += back[t]
            dr, dz, dnew, reset = d[0, t], d[1, t], d[2, t], d[3, t]
            np.multiply(dh, 1 - z, out=dnew)
            dnew *= 1 - new * new
            np.multiply(dh, before - new, out=dz)
            dz *= z
            dz *= 1 - z
            np.multiply(dnew, r, out=reset)
            np.multiply(reset, a, out=dr)
            dr *= 1 - r
            dh *= z
            for gate, change in enumerate((dr, dz, reset)):
                dh += change @ p["u"][gate].T
            dh[fresh[t]] = 0
        d = d.reshape(4, -1, n)
        before = np.concatenate([k[0] for k in kept]).T
        du = np.stack([before @ d[gate] for gate in (0, 1, 3)])
        flat_x = x.ravel()
        order = np.argsort(flat_x.astype(np.int16), kind="stable")
        ordered = flat_x[order]
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self._apply("x", np.add.reduceat(np.take(d[:3], order, axis=1), at, axis=1), (slice(None), ordered[at]))
        self._apply("b", d[:3].sum(axis=1, keepdims=True))
        self._apply("u", du)
        for name, gradient in gradients.items():
            self._apply(name, gradient)
        self._apply("v", dv)
        self._apply("d", dd)
        return h, loss

    def train(self, tokens: np.ndarray, classes: np.ndarray, words: np.ndarray, first: np.ndarray) -> float:
        """One pass over documents one after the other, cut into streams, the last of them padded; returns the loss a token."""
        if not len(tokens):
            return 0.0
        streams = max(1, min(MOST_STREAMS, len(tokens) // (WINDOW * UPDATES)))
        self.rate = RATE * math.sqrt(max(1.0, streams / UPDATES))
        steps = -(-len(tokens) // streams)
        previous = np.append(self.start, tokens[:-1])
        previous[first] = self.start

        def cut(values, fill=0):
            return np.append(values, np.full(steps * streams - len(values), fill, values.dtype)).reshape(streams, steps).T

        arrays = cut(previous), cut(first), cut(classes), cut(words), cut(np.ones(len(tokens), dtype=np.float32))
        h = np.zeros((streams, self.p["u"].shape[1]), dtype=np.float32)
        loss = 0.0
        for low in range(0, steps, WINDOW):
            h, more = self.window(*(a[low : low + WINDOW] for a in arrays), h)
            loss += more
        return loss * streams / len(tokens)
