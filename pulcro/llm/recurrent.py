"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

import heapq

import numpy as np

Weights = dict[str, np.ndarray]
#: Words whose probabilities are computed at a time, so that their tables stay in the cache.
BLOCK = 4096
#: Just below the largest array whose release raises the bound up to which freed memory is kept.
HELD_BYTES = 31 << 20


def keep_memory() -> None:
    """Makes the C library keep freed memory of this size: new pages cost more than the arithmetic on them."""
    np.empty(HELD_BYTES, dtype=np.uint8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of both signs without overflow; overwrites ``x``, an array of its own."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def softmax(x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each column of ``x``, which is overwritten, and the logs of those in rows ``wanted``.

    A column is a case: sums over few rows are sums of long vectors.
    """
    columns = np.arange(x.shape[1])
    x -= x.max(0)
    logs = x[wanted, columns]
    np.exp(x, out=x)
    total = x.sum(0)
    x /= total
    return x, logs - np.log(total)


def summed_rows(values: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their ``numbers``, 0 to n - 1."""
    order = np.argsort(numbers.astype(np.uint16) if n <= 1 << 16 else numbers, kind="stable")
    named = numbers[order]
    starts = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
    out = np.zeros((n, values.shape[1]), dtype=values.dtype)
    out[named[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Gru:
    """P(word | words before) = P(class of word | state) * P(word | class, state).

    Word numbers are ranks by frequency; ``classes`` gives the class of each, in blocks of
    neighbouring ranks. The state is updated by a gated recurrent unit over word vectors.
    """

    def __init__(self, classes: np.ndarray, weights: Weights):
        self.classes, self.w = classes, weights
        self.firsts = np.searchsorted(classes, np.arange(int(classes[-1]) + 2))

    @staticmethod
    def start(counts: np.ndarray, hidden: int, n_classes: int, seed: int) -> Gru:
        """Random weights; biases give each class and word its share of ``counts``."""
        mass = np.cumsum(np.sqrt(counts)) / np.sqrt(counts).sum()
        classes = np.minimum((mass * n_classes * (1 - 1e-9)).astype(np.int64), n_classes - 1)
        classes = np.unique(classes, return_inverse=True)[1]
        random = np.random.default_rng(seed)
        n = int(classes[-1]) + 1

        def draw(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) * 0.1).astype(np.float32)

        share = np.bincount(classes, weights=counts)
        weights = {
            "x": draw(len(counts), 3 * hidden),
            "u": draw(hidden, 3 * hidden),
            "b": np.zeros(3 * hidden, dtype=np.float32),
            "c": draw(hidden, n),
            "cb": np.log(share / share.sum()).astype(np.float32),
            "o": draw(len(counts), hidden),
            "ob": np.log(counts / share[classes]).astype(np.float32),
        }
        return Gru(classes, weights)

    def step(self, words: np.ndarray, h: np.ndarray) -> np.ndarray:
        """State after ``words``, one per lane."""
        return self._step((self.w["x"] + self.w["b"])[words], h)

    def _step(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """State after words with inputs ``x``, overwritten; ``keep`` gets what the way back needs."""
        n = h.shape[1]
        u = h @ self.w["u"]
        gates = sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = r * u[:, 2 * n :]
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        if keep is not None:
            keep.append((h, z, r, new, u[:, 2 * n :]))
        return out

    def _by_class(self, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """An order that puts rows of a class side by side; (from, to) of rows and of words of each."""
        order = np.argsort(classes.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(len(self.firsts)))
        bounds = zip(cuts[:-1].tolist(), cuts[1:].tolist(), self.firsts[:-1].tolist(), self.firsts[1:].tolist(), strict=True)
        return order, [(i, j, a, b) for i, j, a, b in bounds if j > i and b > a + 1]

    def log_probs(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word after its state."""
        w, out = self.w, np.empty(len(words), dtype=h.dtype)
        for at in range(0, len(words), BLOCK):
            classes = self.classes[words[at : at + BLOCK]]
            order, parts = self._by_class(classes)
            hs, targets = h[at : at + BLOCK][order], words[at : at + BLOCK][order]
            logits = w["c"].T @ hs.T
            logits += w["cb"][:, None]
            logs = _logs(logits, classes[order])
            for i, j, a, b in parts:
                logits = w["o"][a:b] @ hs[i:j].T
                logits += w["ob"][a:b, None]
                logs[i:j] += _logs(logits, targets[i:j] - a)
            out[at : at + BLOCK][order] = logs
        return out

    def gradients(self, seen: np.ndarray, h: np.ndarray) -> tuple[float, Weights, np.ndarray]:
        """Loss a word, its gradients and the last state, over one window.

        ``seen`` (steps + 1, lanes): each step reads a row and predicts the next. The state before
        the window is taken as given, which truncates the way back there.
        """
        w, n = self.w, h.shape[1]
        grads = {k: np.zeros_like(v) for k, v in w.items() if k in ("o", "ob")}
        keep: list = []
        steps, lanes = len(seen) - 1, seen.shape[1]
        hs = np.empty((steps, lanes, n), dtype=h.dtype)
        inputs = (w["x"] + w["b"])[seen[:-1]]
        for t in range(steps):
            h = hs[t] = self._step(inputs[t], h, keep)
        targets = seen[1:].reshape(-1)
        total = len(targets)
        # Rows in the order of the classes of their targets, so that those of a class are one slice.
        order, parts = self._by_class(self.classes[targets])
        states, targets = hs.reshape(-1, n)[order], targets[order]
        classes = self.classes[targets]
        logits = w["c"].T @ states.T
        logits += w["cb"][:, None]
        d, logs = softmax(logits, classes)
        loss = -float(logs.sum())
        d[classes, np.arange(total)] -= 1
        grads["c"], grads["cb"] = states.T @ d.T, d.sum(1)
        dh = d.T @ w["c"].T
        for i, j, a, b in parts:
            logits = w["o"][a:b] @ states[i:j].T
            logits += w["ob"][a:b, None]
            d, logs = softmax(logits, targets[i:j] - a)
            loss -= float(logs.sum())
            d[targets[i:j] - a, np.arange(j - i)] -= 1
            grads["o"][a:b] = d @ states[i:j]
            grads["ob"][a:b] = d.sum(1)
            dh[i:j] += d.T @ w["o"][a:b]
        for k in ("c", "cb", "o", "ob"):
            grads[k] /= total
        dh /= total
        after = np.empty_like(dh)
        after[order] = dh
        after = after.reshape(steps, lanes, n)
        back = np.zeros_like(hs[0])
        d_xs, d_us = np.empty((2, steps, lanes, 3 * n), dtype=h.dtype)
        before = np.empty_like(hs)
        for t in range(steps - 1, -1, -1):
            before[t], z, r, new, un = keep[t]
            d_x, d_u = d_xs[t], d_us[t]
            back += after[t]
            d_z, d_r, d_new = d_x[:, :n], d_x[:, n : 2 * n], d_x[:, 2 * n :]
            # new: back * (1 - z) * (1 - new²); z: back * (before - new) * z * (1 - z); r: d_new * un * r * (1 - r)
            rest = 1 - z
            np.multiply(back, rest, out=d_new)
            np.subtract(before[t], new, out=d_z)
            d_z *= z
            d_z *= back
            d_z *= rest
            new *= new
            np.subtract(1, new, out=new)
            d_new *= new
            np.subtract(1, r, out=rest)
            rest *= un
            np.multiply(d_new, r, out=d_u[:, 2 * n :])
            np.multiply(d_u[:, 2 * n :], rest, out=d_r)
            d_u[:, : 2 * n] = d_x[:, : 2 * n]
            back *= z
            back += d_u @ w["u"].T
        d_xs = d_xs.reshape(-1, 3 * n)
        grads["x"] = summed_rows(d_xs, seen[:-1].reshape(-1), len(w["x"]))
        grads["b"] = grads["x"].sum(0)
        grads["u"] = before.reshape(-1, n).T @ d_us.reshape(-1, 3 * n)
        return loss / total, grads, h


def _logs(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Logs of the shares that rows ``wanted`` have of each column of ``x``, which is overwritten."""
    x -= x.max(0)
    logs = x[wanted, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return logs - np.log(x.sum(0))


class Adam:
    def __init__(self, weights: Weights, rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def apply(self, grads: Weights) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(size, 1e-9))
        for k, g in grads.items():
            g = g * scale
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            g *= g
            g *= 0.01
            v *= 0.99
            v += g
            np.divide(v, 1 - 0.99**self.t, out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= self.rate / (1 - 0.9**self.t)
            self.w[k] -= g


def train(model: Gru, windows: np.ndarray, steps: int, lanes: int, rate: float) -> int:
    """One pass over ``windows`` (n, k * steps + 1): the state is carried along each; words seen."""
    keep_memory()
    adam = Adam(model.w, rate)
    hidden = model.w["u"].shape[0]
    for at in range(0, len(windows), lanes):
        part = windows[at : at + lanes].T.astype(np.int64)
        h = np.zeros((part.shape[1], hidden), dtype=np.float32)
        for start in range(0, len(part) - 1, steps):
            _, grads, h = model.gradients(part[start : start + steps + 1], h)
            adam.apply(grads)
    return windows.size


def score(model: Gru, texts: list[np.ndarray], end: int, lanes: int = 512, steps: int = 64) -> np.ndarray:
    """Natural log-likelihood of each whole text, an array of word numbers that ends with ``end``.

    Texts are dealt to lanes of about equal length; a lane reads its texts one after the other in
    windows, carries the state across windows and clears it where a text begins.
    """
    out = np.zeros(len(texts))
    if not texts:
        return out
    keep_memory()
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    heap = [(0, k) for k in range(min(lanes, len(texts)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for i in order:
        n, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (n + len(texts[i]), k))
    dealt.sort(key=lambda own: -sum(len(texts[i]) for i in own))
    words = [np.concatenate([texts[i] for i in own]) for own in dealt]
    owner = [np.repeat(np.array(own), [len(texts[i]) for i in own]) for own in dealt]
    lengths = np.array([len(x) for x in words])
    hidden = model.w["u"].shape[0]
    h = np.zeros((len(words), hidden), dtype=np.float32)
    last = np.full(len(words), end, dtype=np.int64)
    inputs = model.w["x"] + model.w["b"]
    for start in range(0, int(lengths[0]), steps):
        live = int(np.searchsorted(-lengths, -start, "left"))
        width = min(steps, int(lengths[0]) - start)
        block = np.full((width, live), end, dtype=np.int64)
        whose = np.full((width, live), -1, dtype=np.int64)
        for k in range(live):
            part = words[k][start : start + width]
            block[: len(part), k] = part
            whose[: len(part), k] = owner[k][start : start + width]
        h, states = h[:live], np.empty((width, live, hidden), dtype=np.float32)
        before = last[:live]
        for t in range(width):
            # The end of a text was read: the next one begins from the empty state.
            ended = before == end
            if ended.any():
                h[ended] = 0
            h = states[t] = model._step(inputs[before], h)
            before = block[t]
        last = before
        valid = whose.reshape(-1) >= 0
        logs = model.log_probs(states.reshape(-1, hidden)[valid], block.reshape(-1)[valid])
        out += np.bincount(whose.reshape(-1)[valid], weights=logs, minlength=len(out))
    return out
