"""A gated recurrent network in numpy with a class-factored output softmax.

The probability of a token is that of its class times that of the token within the class, each
a softmax over the state. Classes are ranges of the tokens sorted by count, of
about equal mass and at most ``WIDEST`` tokens. Output biases start at the log counts, so an
untrained network gives unigram probabilities. Token 0 to ``n - 2`` are words, ``n - 1`` stands for
all others. One token, ``end``, closes every text; the state is reset after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np

HIDDEN, CLASSES, WIDEST = 32, 48, 128
WINDOW, STREAMS = 24, 96
RATE = 0.08
#: Exponentials of numbers up to this, and sums of those, are far from the limits of single precision.
SAFE = 60.0
#: Texts, and states at the classes, that are scored side by side.
SIDE = 1024

Params = dict[str, np.ndarray]


def keep_freed() -> None:
    """Have the allocator keep what a window frees for the next one, which else pages it in anew.

    The C library gives freed memory back beyond twice the largest block it has unmapped, at most 32 MiB.
    """
    np.empty(1 << 24, np.uint8)


def class_starts(counts: np.ndarray) -> np.ndarray:
    """First token of each class, and the number of tokens; the last token is a class of its own."""
    words = counts[:-1].astype(float)
    mass = words.sum() / CLASSES if words.size else 1.0
    starts, held = [0], 0.0
    for i, c in enumerate(words):
        if i > starts[-1] and (held + c > mass or i - starts[-1] >= WIDEST):
            starts.append(i)
            held = 0.0
        held += c
    return np.array([*starts, len(counts) - 1, len(counts)] if words.size else [0, len(counts)])


def initial(counts: np.ndarray, starts: np.ndarray) -> Params:
    rng = np.random.default_rng(5)
    n, mass = len(counts), counts.astype(float) + 0.1
    by_class = np.add.reduceat(mass, starts[:-1])
    small = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
    return {
        "X": small(n, 3 * HIDDEN), "U": small(HIDDEN, 3 * HIDDEN) * 2,
        "Wc": small(HIDDEN, len(starts) - 1), "bc": np.log(by_class / by_class.sum()).astype(np.float32),
        "Ww": small(n, HIDDEN), "bw": np.log(mass / np.repeat(by_class, np.diff(starts))).astype(np.float32),
    }


def _against(x: np.ndarray) -> np.ndarray:
    """A copy of weights by gate whose first two gates are negated, as their sigmoids need them."""
    x = x.copy()
    x[:, : 2 * HIDDEN] *= -1
    return x


def _sigmoid_against(x: np.ndarray) -> None:
    """The sigmoid of ``-x``, in place; what overflows becomes 0."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _gates(a: np.ndarray, u: np.ndarray, h: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """One token per column: fills the gates ``zr``, the candidate ``n`` and the next state ``out``.

    ``a`` and ``u`` come from the token and from the state ``h``, by :func:`_against` of the weights.
    """
    np.add(a[: 2 * HIDDEN], u[: 2 * HIDDEN], out=zr)
    _sigmoid_against(zr)
    np.multiply(zr[HIDDEN:], u[2 * HIDDEN :], out=n)
    n += a[2 * HIDDEN :]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[:HIDDEN]
    out += n


def _by_class(targets: np.ndarray, starts: np.ndarray):
    """Class of each target, an order of the targets by class, and each class of more than one token that occurs, with its place there."""
    of = np.repeat(np.arange(len(starts) - 1, dtype=np.uint16), np.diff(starts))[targets]
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(starts))).tolist()
    bounds = starts.tolist()
    parts = [
        (bounds[c], bounds[c + 1], cuts[c], cuts[c + 1])
        for c in range(len(starts) - 1) if cuts[c] < cuts[c + 1] and bounds[c + 1] - bounds[c] > 1
    ]
    return of, order, parts


def _with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A line of weights and a bias for each token; the bias meets a 1 after the state."""
    return np.concatenate([w, b[:, None]], axis=1)


def _reach(weights: np.ndarray) -> float:
    """The farthest from 0 that numbers of a state between -1 and 1 can be."""
    return float(np.abs(weights).sum(axis=1).max())


def _exp(z: np.ndarray, views: Sequence[np.ndarray], reach: float = np.inf) -> None:
    """Exponentials in place, up to a factor for each column of the views, which make up ``z``."""
    if z.size and reach > SAFE and (z.max() > SAFE or z.min() < -SAFE):
        for v in views:
            v -= v.max(axis=0)
    np.exp(z, out=z)


def _log_of(z: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
    """Log-softmax of a column's line ``at``, for each column; changes ``z``."""
    if reach > SAFE and (z.max() > SAFE or z.min() < -SAFE):
        z -= z.max(axis=0)
    own = z[at, np.arange(at.size)]
    return own - np.log(np.exp(z, out=z).sum(axis=0))


def log_probs(p: Params, starts: np.ndarray, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target given its state."""
    weights = [_with_bias(p["Wc"].T, p["bc"]), _with_bias(p["Ww"], p["bw"])]
    return _log_probs(*weights, [np.inf, np.inf], starts, np.append(h, np.ones_like(h[:, :1]), axis=1), targets)


def _log_probs(classes: np.ndarray, words: np.ndarray, reach: list[float], starts: np.ndarray, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """As :func:`log_probs`, with weights and states from :func:`_with_bias` and the reach of both weights."""
    of, order, parts = _by_class(targets, starts)
    # Some columns at a time stay in a core's cache.
    out = np.concatenate([_log_of(classes @ h[i : i + SIDE].T, of[i : i + SIDE], reach[0]) for i in range(0, targets.size, SIDE)])
    h, within, own = h.take(order, axis=0), (targets - starts[of])[order], np.zeros(targets.size, out.dtype)
    for lo, hi, a, b in parts:
        own[a:b] = _log_of(words[lo:hi] @ h[a:b].T, within[a:b], reach[1])
    out[order] += own
    return out


def score_texts(p: Params, starts: np.ndarray, texts: list[np.ndarray], end: int, group: int = SIDE) -> np.ndarray:
    """Log-probability of whole texts (token arrays that close with ``end``).

    Texts of like length run side by side; their states are carried from window to window.
    """
    keep_freed()
    total = np.zeros(len(texts))
    by_length = np.argsort([-t.size for t in texts], kind="stable")
    # A sigmoid is half of 1 and the tanh of half its number; what follows has twice the gates.
    xg, xn, ug, un = (np.ascontiguousarray(x) for w in "XU" for x in np.split(p[w], [2 * HIDDEN], axis=1))
    xg, ug, un = xg / 2, ug / 2, un / 2
    weights = [_with_bias(p["Wc"].T, p["bc"]), _with_bias(p["Ww"], p["bw"])]
    reach = [_reach(w) for w in weights]
    for at in range(0, len(texts), group):
        own = by_length[at : at + group]
        sizes = np.array([texts[i].size for i in own])
        tokens, first = np.concatenate([texts[i] for i in own]).astype(np.int64, copy=False), np.cumsum(sizes) - sizes
        h, last = np.zeros((own.size, HIDDEN), np.float32), np.full(own.size, end)
        lo = 0
        while lo < sizes[0]:
            live = int(np.searchsorted(-sizes, -lo))  # texts that go on here
            span = min(lo + max(1, 8192 // live), int(sizes[0]))
            lines = np.searchsorted(-sizes, -np.arange(lo, span)).tolist()  # texts that go on at each place
            states, targets = np.ones((sum(lines), HIDDEN + 1), np.float32), np.empty(sum(lines), np.int64)
            done = 0
            for t, now in enumerate(lines, lo):
                h, last = h[:now], last[:now]
                zr = h @ ug
                zr += xg.take(last, axis=0)
                np.tanh(zr, out=zr)
                zr += 1
                n = h @ un
                n *= zr[:, HIDDEN:]
                n += xn.take(last, axis=0)
                np.tanh(n, out=n)
                h = h - n
                h *= 0.5
                h *= zr[:, :HIDDEN]
                h += n
                states[done : done + now, :HIDDEN] = h
                last = tokens.take(first[:now] + t, out=targets[done : done + now], mode="clip")
                done += now
            logs = _log_probs(*weights, reach, starts, states, targets)
            total += np.bincount(np.concatenate([own[:now] for now in lines]), logs, minlength=len(texts))
            lo = span
    return total


def _sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of the rows of each."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows.take(order, axis=0)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(first, append=keys.size)
    out = rows.take(first, axis=0)
    # Frequent keys one by one, the others a row of each at a time: reduceat adds number by number.
    for i in np.flatnonzero(size > 8).tolist():
        np.add.reduce(rows[first[i] : first[i] + size[i]], 0, None, out[i])
    size[size > 8] = 1
    for k in range(1, size.max()):
        at = np.flatnonzero(size > k)
        out[at] += rows.take(first[at] + k, axis=0)
    return keys[first], out


class Learner:
    """AdaGrad on truncated windows of token streams."""

    def __init__(self, params: Params, starts: np.ndarray, end: int):
        self.p = {k: v.copy() for k, v in params.items()}
        # Weights and biases of words are moved as one.
        self.words = np.concatenate([params["Ww"], params["bw"][:, None]], axis=1)
        self.p["Ww"], self.p["bw"] = self.words[:, :HIDDEN], self.words[:, HIDDEN]
        self.starts, self.end = starts, end
        self.g2 = {k: np.full_like(v, 1e-3) for k, v in (self.p | {"words": self.words}).items() if k not in ("Ww", "bw")}
        self.words_grad = np.empty_like(self.words)

    def _output(self, h: np.ndarray, goal: np.ndarray, streams: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the states, a line per target and a 1 at its end, and of the output weights, both by ``streams``."""
        p, places = self.p, np.arange(goal.size)
        of, order, parts = _by_class(goal, self.starts)
        classes = _with_bias(p["Wc"].T, p["bc"])
        d = classes @ h.T
        _exp(d, [d], _reach(classes))
        d /= d.sum(axis=0) * streams
        d[of, places] -= 1 / streams
        dflat = d.T @ p["Wc"].T
        by_class = d @ h
        moves = {"Wc": by_class[:, :HIDDEN].T, "bc": by_class[:, HIDDEN], "words": self.words_grad}
        # Columns are targets by class, lines the words of the class; all classes lie in one array.
        flat, within, words = h.take(order, axis=0), (goal - self.starts[of])[order], moves["words"]
        first = np.cumsum([0, *((hi - lo) * (b - a) for lo, hi, a, b in parts)])
        z, sums, ones = np.empty(first[-1], np.float32), np.ones(goal.size, np.float32), np.ones(WIDEST, np.float32)
        views = [z[i:j].reshape(hi - lo, b - a) for i, j, (lo, hi, a, b) in zip(first.tolist(), first[1:].tolist(), parts)]
        for v, (lo, hi, a, b) in zip(views, parts):
            np.dot(self.words[lo:hi], flat[a:b].T, out=v)
        _exp(z, views)
        for v, (lo, hi, a, b) in zip(views, parts):
            np.dot(ones[: hi - lo], v, out=sums[a:b])
        # Softmax less 1 at the target, times the sum.
        if parts:
            _, _, a, b = np.array(parts).T
            own = np.concatenate([places[x:y] for _, _, x, y in parts])
            z[within[own] * np.repeat(b - a, b - a) + np.repeat(first[:-1] - a, b - a) + own] -= sums[own]
        sums = sums[:, None] * streams
        flat /= sums
        back = np.zeros((goal.size, HIDDEN), np.float32)
        for lo, hi in zip([0, *(hi for _, hi, _, _ in parts)], [*(lo for lo, *_ in parts), len(words)]):
            words[lo:hi] = 0  # between two classes that occur
        own = np.ascontiguousarray(p["Ww"])
        for v, (lo, hi, a, b) in zip(views, parts):
            np.dot(v, flat[a:b], out=words[lo:hi])
            np.dot(v.T, own[lo:hi], out=back[a:b])
        back /= sums
        place = np.empty_like(order)
        place[order] = places
        dflat += back.take(place, axis=0)
        return dflat, moves

    @np.errstate(over="ignore")
    def window(self, h: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """One truncated step over ``(time, stream)`` tokens; the state to carry on, a column per stream."""
        p, (steps, streams), k = self.p, ids.shape, HIDDEN
        at, ended = np.nonzero(ids == self.end)
        cuts = np.searchsorted(at, np.arange(steps + 1)).tolist()
        ends = [ended[i:j] for i, j in pairwise(cuts)]
        a = p["X"].take(ids.ravel(), axis=0).reshape(steps, streams, 3 * k).transpose(0, 2, 1).copy()
        a[:, : 2 * k] *= -1
        ut = np.ascontiguousarray(_against(p["U"]).T)
        u, zr, before, n, states = (np.empty((steps, m * k, streams), np.float32) for m in (3, 2, 1, 1, 1))
        for t in range(steps):
            before[t] = h
            if ends[t].size:
                before[t][:, ends[t]] = 0
            np.matmul(ut, before[t], out=u[t])
            _gates(a[t], u[t], before[t], zr[t], n[t], states[t])
            h = states[t]
        flat = np.ones((steps, streams, k + 1), np.float32)
        flat[:, :, :k] = states.transpose(0, 2, 1)
        dflat, moves = self._output(flat.reshape(-1, k + 1), targets.ravel(), streams)
        dflat = dflat.reshape(steps, streams, k).transpose(0, 2, 1).copy()
        z, r, other = zr[:, :k], zr[:, k:], 1 - zr
        # What the state is off by, times these, is what the state's part of n, then z, r and n are off by.
        by = np.empty((steps, 4, k, streams), np.float32)
        by_n = np.multiply(n, n, out=by[:, 3])
        np.subtract(1, by_n, out=by_n)
        by_n *= other[:, :k]
        np.multiply(by_n, r, out=by[:, 0])
        np.subtract(states, n, out=by[:, 1])  # (before - n) * z
        by[:, 1] *= other[:, :k]
        np.multiply(u[:, 2 * k :], by[:, 0], out=by[:, 2])
        by[:, 2] *= other[:, k:]
        dh, turned = np.zeros_like(h), np.ascontiguousarray(np.roll(p["U"], k, axis=1))
        off, back = np.empty((steps, 4 * k, streams), np.float32), np.empty_like(dh)
        for t in range(steps - 1, -1, -1):
            dh += dflat[t]
            np.multiply(dh, by[t], out=off[t].reshape(4, k, streams))
            dh *= z[t]
            dh += np.matmul(turned, off[t, : 3 * k], out=back)
            if ends[t].size:
                dh[:, ends[t]] = 0
        moves["U"] = np.roll(np.matmul(off[:, : 3 * k], before.transpose(0, 2, 1)).sum(axis=0).T, -k, axis=1)
        rows, moved = _sums(off[:, k:].transpose(0, 2, 1).reshape(-1, 3 * k), ids.ravel().astype(np.uint16))
        self._move(p["X"], self.g2["X"], moved, rows)
        for name, grad in moves.items():
            if name == "U":
                np.clip(grad, -5, 5, out=grad)
            self._move(p[name] if name != "words" else self.words, self.g2[name], grad)
        return h

    @staticmethod
    def _move(value: np.ndarray, g2: np.ndarray, grad: np.ndarray, at: np.ndarray | None = None) -> None:
        """Move the lines ``at``, all if that is None; changes ``grad``."""
        squares = grad * grad
        if at is None:
            g2 += squares
            np.sqrt(g2, out=squares)
        else:
            squares += g2.take(at, axis=0)
            g2[at] = squares
            np.sqrt(squares, out=squares)
        grad *= RATE
        grad /= squares
        if at is None:
            value -= grad
        else:
            value[at] -= grad

    def fit(self, tokens: np.ndarray, epochs: int = 1) -> None:
        """Learn from a run of texts that each close with ``end``."""
        keep_freed()
        length = tokens.size // STREAMS
        tokens, cut = np.concatenate([[self.end], tokens]), STREAMS * length
        # The last tokens, fewer than streams, are a stream of their own.
        for _ in range(epochs):
            for streams, own in ((STREAMS, tokens[: cut + 1]), (1, tokens[cut:])):
                ids, goals = (x.reshape(streams, -1).T for x in (own[:-1], own[1:]))
                h = np.zeros((HIDDEN, streams), np.float32)
                for lo in range(0, len(ids), WINDOW):
                    h = self.window(h, ids[lo : lo + WINDOW], goals[lo : lo + WINDOW])
