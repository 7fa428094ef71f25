"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, lanes of whole documents."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """Vocabulary of ``classes * width`` ids; the class of an id is ``id // width``.

    The input weights are one table row per id, so a step needs one gather and one small product.
    """

    def __init__(self, classes: int, width: int, hidden: int, log_probs: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        v, h = classes * width, hidden
        self.classes, self.width, self.hidden = classes, width, hidden
        self.p = {
            "table": rng.normal(0, 0.1, (v, 3 * h)), "gate": np.zeros(3 * h), "u": rng.normal(0, h ** -0.5, (h, 3 * h)),
            "cw": rng.normal(0, 0.05, (h, classes)), "cb": np.zeros(classes), "ww": rng.normal(0, 0.05, (classes, h, width)), "wb": np.zeros((classes, width)),
        }
        if log_probs is not None:  # start as the unigram model
            lp = log_probs.reshape(classes, width)
            self.p["cb"] = np.logaddexp.reduce(lp, axis=1)
            self.p["wb"] = lp - self.p["cb"][:, None]
        self.p = {k: x.astype(F32) for k, x in self.p.items()}
        self.moments, self.updates = None, 0

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, x in self.p.items():
            self.p[k] = np.asarray(flat[at:at + x.size], F32).reshape(x.shape)
            at += x.size
        return self

    def run(self, ids: np.ndarray, reset: np.ndarray, h: np.ndarray, active: np.ndarray | None = None, trace: bool = False):
        """States *before* each of the (time, lane) ids and the state after the last; with ``trace`` also the gates.

        ``active[t]`` lanes (a prefix) take part in step t. ``reset`` marks first tokens: their state is zero.
        """
        steps, lanes = ids.shape
        n = self.hidden
        x = self.p["table"][ids] + self.p["gate"]
        before = np.zeros((steps, lanes, n), F32)
        kept = []
        for t in range(steps):
            k = lanes if active is None else int(active[t])
            hk = h[:k]
            if reset[t, :k].any():
                hk = np.where(reset[t, :k, None], F32(0), hk)
            before[t, :k] = hk
            r = hk @ self.p["u"]
            zr = sigmoid(x[t, :k, : 2 * n] + r[:, : 2 * n])
            z, g = zr[:, :n], zr[:, n:]
            c = np.tanh(x[t, :k, 2 * n:] + g * r[:, 2 * n:])
            h[:k] = c + z * (hk - c)
            if trace:
                kept.append((zr, c, r[:, 2 * n:]))
        return before, h, kept

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grad: bool = False):
        """Natural log-probability of each target; with ``grad`` also the gradients of its sum."""
        p, cls, word = self.p, targets // self.width, targets % self.width
        rows = np.arange(len(targets))

        def softmax(logits):
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            s = e.sum(axis=1, keepdims=True)
            return logits - np.log(s), e / s if grad else None

        lc, pc = softmax(states @ p["cw"] + p["cb"])
        out = lc[rows, cls]
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1))
        if grad:
            dc = -pc
            dc[rows, cls] += 1
            g = {"cw": states.T @ dc, "cb": dc.sum(0), "ww": np.zeros_like(p["ww"]), "wb": np.zeros_like(p["wb"])}
            ds = dc @ p["cw"].T
        for c in range(self.classes):
            at = order[cuts[c]:cuts[c + 1]]
            if not len(at):
                continue
            lw, pw = softmax(states[at] @ p["ww"][c] + p["wb"][c])
            here = np.arange(len(at))
            out[at] += lw[here, word[at]]
            if grad:
                dw = -pw
                dw[here, word[at]] += 1
                g["ww"][c], g["wb"][c] = states[at].T @ dw, dw.sum(0)
                ds[at] += dw @ p["ww"][c].T
        return (out, g, ds) if grad else out

    def train(self, docs: list[np.ndarray], lanes: int = 16, window: int = 32, rate: float = 0.02, most: int = 256) -> Gru:
        """One pass of Adam over the documents, backpropagation cut at ``window`` steps, states carried on.

        Long streams take up to ``most`` lanes, as long as that leaves 128 steps of Adam. A further call goes on with the
        moments of the last one.
        """
        stream = np.concatenate(docs)
        lanes = max(1, min(lanes, len(stream) // (4 * window)), min(most, len(stream) // (128 * window)))
        first = np.zeros(len(stream), bool)
        first[np.cumsum([0, *map(len, docs)])[:-1]] = True
        steps = -(-len(stream) // lanes)
        size = steps * lanes
        weight = np.ones(size, F32)
        weight[len(stream):] = 0
        pad = size - len(stream)
        ids = np.pad(stream, (0, pad)).reshape(lanes, steps).T
        reset = np.pad(first, (0, pad), constant_values=True).reshape(lanes, steps).T
        weight = weight.reshape(lanes, steps).T
        m, v = self.moments = self.moments or tuple({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        h, n = np.zeros((lanes, self.hidden), F32), self.hidden
        for s in range(0, steps, window):
            i, r, w = ids[s:s + window], reset[s:s + window], weight[s:s + window]
            before, h, kept = self.run(i, r, h.copy(), trace=True)
            live = w.ravel() > 0
            _, g, ds_live = self.log_probs(before.reshape(-1, n)[live], i.ravel()[live], grad=True)
            ds = np.zeros((w.size, n), F32)
            ds[live] = ds_live
            ds = ds.reshape(before.shape)
            dx = np.zeros((*i.shape, 3 * n), F32)
            du, dh = np.zeros_like(self.p["u"]), np.zeros_like(h)
            for t in range(len(i) - 1, -1, -1):
                zr, c, rc = kept[t]
                z, q, hb = zr[:, :n], zr[:, n:], before[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (hb - c) * z * (1 - z)
                dq = dc * rc * q * (1 - q)
                dx[t] = np.concatenate([dz, dq, dc], axis=1)
                dr = np.concatenate([dz, dq, dc * q], axis=1)
                du += hb.T @ dr
                dh = np.where(r[t][:, None], F32(0), dh * z + dr @ self.p["u"].T + ds[t])
            g["u"], g["gate"] = du, dx.sum((0, 1))
            g["table"] = np.zeros_like(self.p["table"])
            np.add.at(g["table"], i.ravel(), dx.reshape(-1, 3 * n))
            self.updates += 1
            k = self.updates
            count = max(1, int(live.sum()))
            for name, x in self.p.items():
                d = np.clip(-g[name] / count, -1, 1)
                m[name] += F32(0.1) * (d - m[name])
                v[name] += F32(0.01) * (d * d - v[name])
                x -= F32(rate) * (m[name] / (1 - 0.9 ** k)) / (np.sqrt(v[name] / (1 - 0.99 ** k)) + F32(1e-6))
        return self

    def score(self, ids: np.ndarray, ends: np.ndarray, lanes: int = 512, window: int = 96) -> np.ndarray:
        """Natural log-likelihood of each whole document; ``ends`` are the exclusive ends of the documents in ``ids``.

        Documents are dealt to lanes, longest first to the shortest lane; a lane's state is carried from window to window.
        """
        sizes = np.diff(ends, prepend=0)
        order = np.argsort(-sizes, kind="stable")
        lanes = max(1, min(lanes, len(sizes)))
        load = [(0, j) for j in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        import heapq

        for d in order.tolist():
            total, j = heapq.heappop(load)
            held[j].append(d)
            heapq.heappush(load, (total + int(sizes[d]), j))
        length = np.array([sizes[x].sum() for x in held], np.int64)
        rank = np.argsort(-length, kind="stable")
        held, length = [held[j] for j in rank], length[rank]
        starts = ends - sizes
        where = [np.concatenate([np.arange(starts[d], ends[d]) for d in x]) for x in held]
        first = np.zeros(len(ids), bool)
        first[starts] = True
        out = np.zeros(len(ids), np.float64)
        h = np.zeros((lanes, self.hidden), F32)
        for s in range(0, int(length[0]), window):
            k = int(np.searchsorted(-length, -s, side="left"))
            steps = min(window, int(length[0]) - s)
            at = np.zeros((steps, k), np.int64)
            ok = np.zeros((steps, k), bool)
            for j in range(k):
                part = where[j][s:s + steps]
                at[:len(part), j] = part
                ok[:len(part), j] = True
            active = ok.sum(axis=1)
            before, h[:k], _ = self.run(ids[at], first[at] & ok, h[:k].copy(), active)
            flat = ok.ravel()
            out[at.ravel()[flat]] = self.log_probs(before.reshape(-1, self.hidden)[flat], ids[at].ravel()[flat])
        return np.add.reduceat(out, starts)
