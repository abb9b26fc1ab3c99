"""A gated recurrent language model in numpy with a class-factored output softmax.

Symbols are numbered by falling frequency; class = symbol // width, so the probability of a symbol is
P(class | state) * P(symbol | class, state). All lanes of a batch step together; the state begins at
zero with each text and is carried across windows within it. For scoring a lane holds whole texts, so
every text is scored with the state of all that stands before; for training the texts are one stream
that is cut into equal lanes.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

import numpy as np

HIDDEN, CLASSES, WIDTH = 12, 24, 24
SYMBOLS = CLASSES * WIDTH
WINDOW = 16  # steps that gradients run back
TRAIN_LANES, SCORE_LANES = 512, 512  # at most
LANE_STEPS = 1024  # symbols a training lane should have, so that small inputs are learned in as many steps
RATE = 6e-3
CLIP = 1.0
TRAIN_TOKENS = 1 << 19  # symbols of a training stream
SCORE_TOKENS = 1 << 22  # symbols laid into lanes at once for scoring, so that long texts have company

H = HIDDEN
SHAPES = {"G": (SYMBOLS, 3 * H), "U": (H, 3 * H), "Wc": (H, CLASSES), "bc": (CLASSES,),
          "Ww": (CLASSES, H, WIDTH), "bw": (CLASSES, WIDTH)}


def initial(frequency: np.ndarray) -> dict[str, np.ndarray]:
    """First parameters: small seeded weights, output biases at the symbols' frequencies."""
    rng = np.random.default_rng(7)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    share = (frequency + 0.5).reshape(CLASSES, WIDTH)
    by_class = share.sum(1)
    p["bc"] = np.log(by_class / by_class.sum()).astype(np.float32)
    p["bw"] = np.log(share / by_class[:, None]).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in SHAPES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = v[at:at + n].reshape(shape).astype(np.float32)
        at += n
    return out


class Stream:
    """All texts one after another, cut into lanes of equal length (the last may be shorter). A text
    that a cut goes through is continued with a zero state."""

    def __init__(self, texts: list[np.ndarray], lanes: int, end: int):
        total = sum(map(len, texts))
        steps = -(-total // max(1, lanes))
        self.lanes = -(-total // steps) if total else 0
        self.steps = steps
        y = np.zeros(self.lanes * steps, np.int16)
        y[:total] = np.concatenate(texts) if texts else []
        x, first = np.empty_like(y), np.zeros(len(y), bool)
        x[1:] = y[:-1]
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        x[begins], first[begins] = end, True
        shape = (self.lanes, steps)
        self.x, self.y, self.first = (np.ascontiguousarray(v.reshape(shape).T) for v in (x, y, first))
        self.live = np.where(np.arange(steps) < total - (self.lanes - 1) * steps, self.lanes, self.lanes - 1)


class Lanes:
    """Whole texts (arrays of symbols, each ending with the end symbol) in lanes of nearly equal length.

    The lanes lie one after another, the longest first, so memory follows the symbols of all texts
    whatever the longest one has; ``span`` gathers the steps that are wanted.
    """

    def __init__(self, texts: list[np.ndarray], lanes: int, end: int):
        order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
        lanes = max(1, min(lanes, len(texts)))
        load = [(0, k) for k in range(lanes)]
        heapify(load)
        held: list[list[int]] = [[] for _ in range(lanes)]
        for i in order:
            n, k = load[0]
            held[k].append(i)
            heapreplace(load, (n + len(texts[i]), k))
        held.sort(key=lambda own: -sum(len(texts[i]) for i in own))
        self.sizes = np.array([sum(len(texts[i]) for i in own) for own in held])
        self.starts = np.cumsum(self.sizes) - self.sizes
        laid = [i for own in held for i in own]
        lengths = np.array([len(texts[i]) for i in laid], np.int64)
        begins = np.cumsum(lengths) - lengths
        self.y = np.concatenate([texts[i] for i in laid]).astype(np.int16, copy=False) if laid else np.zeros(0, np.int16)
        self.x, self.first = np.empty_like(self.y), np.zeros(len(self.y), bool)
        self.x[1:] = self.y[:-1]
        self.x[begins], self.first[begins] = end, True
        self.text = np.repeat(np.array(laid, np.int32), lengths)
        self.lanes, self.steps = lanes, int(self.sizes.max())

    def span(self, t0: int, t1: int) -> tuple[np.ndarray, ...]:
        """``x`` (the symbol before), ``y`` (the symbol to tell), ``text`` (its number) and ``first`` (a text's
        first step), steps x lanes from ``t0`` up to ``t1``, and ``live``: so many lanes still run at each step."""
        steps = np.arange(t0, t1)
        live = np.searchsorted(-self.sizes, -steps)
        at = np.minimum(self.starts[:live[0]] + steps[:, None], len(self.y) - 1)
        return self.x[at], self.y[at], self.text[at], self.first[at], live


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, x)
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def _step(p, h, x, first):
    """One step of all lanes (states are features x lanes): the state after it and what the backward
    step needs."""
    h = np.where(first, h.dtype.type(0), h)
    a = p["G"].take(x, 0).T
    u = p["U"].T @ h
    gates = _sigmoid(a[:2 * H] + u[:2 * H])
    z, r = gates[:H], gates[H:]
    n = r * u[2 * H:]
    n += a[2 * H:]
    np.tanh(n, n)
    return n + z * (h - n), (h, z, r, n, u[2 * H:])


def _softmax(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of the targets, and the probabilities; ``logits`` are choices x positions."""
    np.clip(logits, -60, 60, logits)  # no symbol is ever impossible, and exp cannot overflow
    own = logits[target, np.arange(len(target))]
    np.exp(logits, logits)
    total = logits.sum(axis=0)
    logits /= total
    return own - np.log(total), logits


def _output(p, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
    """Natural-log probability of symbols ``y`` after states ``h`` (features x positions); with
    ``grads``, also d loss / d h. Positions are put in order of class, so each class is one slice."""
    cls = (y // WIDTH).astype(np.int8)
    order = np.argsort(cls, kind="stable")
    h, y = h.take(order, 1), y[order]
    cls, word = y // WIDTH, y % WIDTH
    logp, prob = _softmax(p["Wc"].T @ h + p["bc"][:, None], cls)
    dh = None
    if grads is not None:
        prob[cls, np.arange(len(y))] -= 1
        grads["Wc"], grads["bc"] = h @ prob.T, prob.sum(1)
        dh = p["Wc"] @ prob
    cut = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        at = slice(cut[c], cut[c + 1])
        if at.start == at.stop:
            continue
        hc = h[:, at]
        lw, pw = _softmax(p["Ww"][c].T @ hc + p["bw"][c][:, None], word[at])
        logp[at] += lw
        if grads is not None:
            pw[word[at], np.arange(at.stop - at.start)] -= 1
            grads["Ww"][c], grads["bw"][c] = hc @ pw.T, pw.sum(1)
            dh[:, at] += p["Ww"][c] @ pw
    back = np.empty_like(logp)
    back[order] = logp
    if dh is not None:
        out = np.empty_like(dh)
        out[:, order] = dh
        dh = out
    return back, dh


def score(p: dict[str, np.ndarray], texts: list[np.ndarray], end: int) -> np.ndarray:
    """Natural-log probability of each whole text."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    lanes = Lanes(texts, SCORE_LANES, end)
    h = np.zeros((H, lanes.lanes), p["U"].dtype)
    span = 32
    for t0 in range(0, lanes.steps, span):
        x, y, text, first, live = lanes.span(t0, min(t0 + span, lanes.steps))
        states = []
        for t, k in enumerate(live):
            h, _ = _step(p, h[:, :k], x[t, :k], first[t, :k])
            states.append(h)
        logp, _ = _output(p, np.concatenate(states, axis=1), _span(y, 0, live))
        out += np.bincount(_span(text, 0, live), logp, len(texts))
    return out


def _span(grid: np.ndarray, t0: int, live: np.ndarray) -> np.ndarray:
    """The live lanes of the steps from ``t0`` on, one after another."""
    return np.concatenate([grid[t0 + i, :k] for i, k in enumerate(live)])


class Trainer:
    """Truncated backpropagation through time with Adam."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.steps = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def learn(self, texts: list[np.ndarray], end: int) -> None:
        wanted = max(8, sum(map(len, texts)) // LANE_STEPS)
        lanes = Stream(texts, min(TRAIN_LANES, wanted), end)
        h = np.zeros((H, lanes.lanes), self.p["U"].dtype)
        for t0 in range(0, lanes.steps, WINDOW):
            h = self._window(lanes, t0, min(t0 + WINDOW, lanes.steps), h)

    def _window(self, lanes: Stream, t0: int, t1: int, h: np.ndarray) -> np.ndarray:
        p, saved, states, live = self.p, [], [], lanes.live[t0:t1]
        for t, k in zip(range(t0, t1), live):
            h, cache = _step(p, h[:, :k], lanes.x[t, :k], lanes.first[t, :k])
            saved.append(cache)
            states.append(h)
        grads = {"Ww": np.zeros_like(p["Ww"]), "bw": np.zeros_like(p["bw"])}
        _, dout = _output(p, np.concatenate(states, axis=1), _span(lanes.y, t0, live), grads)
        cut = np.cumsum([0, *live])
        da, dU, dnext = np.empty((3 * H, int(cut[-1])), dout.dtype), np.zeros_like(p["U"]), None
        for s in range(t1 - t0 - 1, -1, -1):
            before, z, r, n, un = saved[s]
            dh = dout[:, cut[s]:cut[s + 1]]
            if dnext is not None:
                dh[:, :dnext.shape[1]] += dnext
            d = da[:, cut[s]:cut[s + 1]]
            d[:H] = dh * (before - n) * z * (1 - z)
            dn = dh * (1 - z)
            dn *= 1 - n * n
            d[H:2 * H] = dn * un * r * (1 - r)
            d[2 * H:] = dn
            du = d.copy()
            du[2 * H:] *= r
            dU += before @ du.T
            dnext = dh * z
            dnext += p["U"] @ du
            dnext = np.where(lanes.first[t0 + s, :dnext.shape[1]], dnext.dtype.type(0), dnext)
        grads["U"] = dU
        x = _span(lanes.x, t0, live)
        order = np.argsort(x, kind="stable")
        names, starts = np.unique(x[order], return_index=True)
        grads["G"] = np.zeros_like(p["G"])
        grads["G"][names] = np.add.reduceat(da.take(order, 1), starts, axis=1).T
        self._update(grads, len(x))
        return h

    def _update(self, grads: dict[str, np.ndarray], tokens: int) -> None:
        self.steps += 1
        scale = 1.0 / tokens
        size = scale * np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale *= min(1.0, CLIP / max(size, 1e-12))
        rate = self.rate * np.sqrt(1 - 0.99 ** self.steps) / (1 - 0.9 ** self.steps)
        for k, g in grads.items():
            g *= np.float32(scale)
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= np.float32(rate) * m / (np.sqrt(v) + 1e-8)
