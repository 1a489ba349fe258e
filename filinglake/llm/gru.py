"""A gated recurrent language model in numpy, with a class-factored softmax.

Documents lie end to end in one array of output ids, each closed by the end
id. They are dealt to streams in whole documents; all streams advance together
by windows of ``WINDOW`` steps. The state is carried from window to window and
cleared at the end of a document, so a document of any length is scored from
its first token to its end. Training is backpropagation truncated at the
window's edge, with Adagrad.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
NEVER = -1e9  # bias of a place that no id has


def init(n_out: int, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters for ``n_out`` output ids in classes of near-square-root size, by rank; the last row of an output matrix is its bias."""
    rng = np.random.default_rng(seed)
    size = int(np.ceil(np.sqrt(n_out)))
    n_classes = -(-n_out // size)
    u = lambda *s, a=0.1: rng.uniform(-a, a, s).astype(np.float32)
    p = {
        "x": u(n_out, 3 * hidden),  # input projection of each id: reset, update, candidate
        "u": u(hidden, 3 * hidden, a=1 / np.sqrt(hidden)),
        "c": u(hidden + 1, n_classes),
        "o": u(n_classes, hidden + 1, size),
    }
    p["c"][-1] = 0
    p["o"][:, -1] = np.where(np.arange(n_classes * size).reshape(n_classes, size) < n_out, 0, NEVER)
    return p


def warm(p: dict[str, np.ndarray], counts: np.ndarray) -> None:
    """Start the output biases at the log frequencies."""
    n_classes, _, size = p["o"].shape
    f = np.zeros(n_classes * size)
    f[: len(counts)] = counts + 1.0
    f = f.reshape(n_classes, size)
    p["c"][-1] = np.log(f.sum(1) / f.sum())
    p["o"][:, -1] = np.where(f > 0, np.log(np.maximum(f, 1) / f.sum(1, keepdims=True)), NEVER)


def even(ends: np.ndarray, most: int, least: int = 16) -> int:
    """Number of streams of near-equal length, so that the last windows do not hold one long document alone."""
    longest = int(np.diff(ends, prepend=0).max()) if len(ends) else 1
    return max(1, min(most, max(least, int(ends[-1]) // longest))) if len(ends) else 1


def streams(ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of at most ``most`` runs of whole documents, the longest first."""
    total = int(ends[-1]) if len(ends) else 0
    n = max(1, min(most, len(ends), total // (2 * WINDOW) or 1))
    goal = (np.arange(1, n) * total) // n
    cuts = np.unique(ends[np.searchsorted(ends, goal)])
    edges = np.unique(np.concatenate([[0], cuts, [total]]))
    a, b = edges[:-1], edges[1:]
    order = np.argsort(a - b, kind="stable")
    return a[order], b[order]


def _exp_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the exponentials of each row, which take the place of ``x``."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], np.float32)


def _by_id(y: np.ndarray, n_out: int) -> np.ndarray:
    """Stable order of ids."""
    return np.argsort(y.astype(np.uint16) if n_out <= 1 << 16 else y, kind="stable")


class Model:
    def __init__(self, p: dict[str, np.ndarray], end: int, batch: int = 256):
        self.p, self.end, self.batch = p, end, batch
        self.hidden = p["u"].shape[0]

    def _inputs(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each gate and id, and the rows of ids ``y``: of their reset gates, their update gates, their candidates."""
        return self.p["x"].reshape(-1, self.hidden), 3 * y + np.arange(3)[:, None, None]

    def _step(self, h: np.ndarray, g: np.ndarray, clear: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        """The next state after input projections ``g``, side by side or gate by gate; ``keep`` takes the gates with the candidate's part of the state, and the candidate."""
        k = self.hidden
        if g.ndim == 2:
            g = g.reshape(-1, 3, k).swapaxes(0, 1)
        # each gate's numbers lie together, so that one loop runs over all streams
        a, n = keep if keep is not None else (np.empty((3, *h.shape), np.float32), np.empty_like(h))
        np.matmul(h, self.p["u"].reshape(k, 3, k).swapaxes(0, 1), out=a)
        rz = a[:2]
        rz += g[:2]
        rz *= 0.5
        np.tanh(rz, out=rz)  # the logistic function by tanh, which does not overflow
        rz *= 0.5
        rz += 0.5
        np.multiply(a[0], a[2], out=n)
        n += g[2]
        np.tanh(n, out=n)
        new = h - n
        new *= a[1]
        new += n
        if clear.any():
            new[clear] = 0
        return new

    def _output(self, m: np.ndarray, y: np.ndarray, grad: dict | None = None) -> np.ndarray:
        """Natural log probabilities of ``y`` at states ``m``; with ``grad``, its gradients and that of m."""
        c, o = self.p["c"], self.p["o"]
        n_classes, wide, size = o.shape
        order = _by_id(y, n_classes * size)  # by class, and by id inside it
        ys = y[order]
        ms = np.empty((len(y), wide), np.float32)
        ms[:, :-1], ms[:, -1] = m.take(order, axis=0), 1
        cls, rows = ys // size, np.arange(len(y))
        bounds = np.searchsorted(ys, np.arange(n_classes + 1) * size).tolist()
        own = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
        lc, lo = ms @ c, np.empty((len(y), size), np.float32)
        for k, at in own:
            np.matmul(ms[at], o[k], out=lo[at])
        of_c, of_o = rows * n_classes + cls, rows * size + (ys - cls * size)
        out = lc.ravel().take(of_c)
        out += lo.ravel().take(of_o)
        sums_c, sums_o = _exp_sums(lc), _exp_sums(lo)
        out -= np.log(sums_c)
        out -= np.log(sums_o)
        if grad is not None:
            lc *= (1 / sums_c)[:, None]
            lc.ravel()[of_c] -= 1
            lo *= (1 / sums_o)[:, None]
            lo.ravel()[of_o] -= 1
            grad["c"], grad["o"] = ms.T @ lc, np.zeros_like(o)
            dm = np.empty((len(y), wide - 1), np.float32)
            for k, at in own:
                np.matmul(ms[at].T, lo[at], out=grad["o"][k])
                np.matmul(lo[at], o[k, :-1].T, out=dm[at])
            dm += lc @ c[:-1].T
            grad["m"] = np.empty_like(dm)
            grad["m"][order] = dm
        back = np.empty_like(out)
        back[order] = out
        return back

    def _windows(self, ids: np.ndarray, ends: np.ndarray, most: int):
        """For each window: (positions of shape steps x streams, which of them are inside, ids there, positions after which a state is cleared)."""
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        a, b = streams(ends, most)
        longest = int((b - a).max()) if len(a) else 0
        for w in range(0, longest, WINDOW):
            live = int(np.count_nonzero(b - a > w))
            at = a[:live] + w + np.arange(min(WINDOW, longest - w))[:, None]
            inside = at < b[:live]
            near = np.minimum(at, len(ids) - 1)
            y = ids[near]
            y[~inside] = self.end
            yield at, inside, y, last[near] | ~inside

    def score(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probability of every token; each document ends in the end id."""
        out = np.zeros(len(ids), np.float32)
        h = np.zeros((self.batch, self.hidden), np.float32)
        for at, inside, y, clear in self._windows(ids, ends, self.batch):
            h = h[: at.shape[1]]
            x, rows = self._inputs(y)
            states = np.empty((*at.shape, self.hidden), np.float32)
            for t in range(len(at)):
                states[t] = h
                h = self._step(h, x.take(rows[:, t], axis=0), clear[t])
            if inside.all():
                out[at] = self._output(states.reshape(-1, self.hidden), y.ravel()).reshape(at.shape)
            else:
                out[at[inside]] = self._output(states[inside], y[inside])
        return out

    def train(self, ids: np.ndarray, ends: np.ndarray, memory: dict[str, np.ndarray], rate: float = 0.05) -> int:
        """One pass over documents that end at ``ends``, where the state is cleared.

        ``memory`` holds Adagrad's sums of squares. Returns the number of tokens.
        """
        k, p = self.hidden, self.p
        h = np.zeros((self.batch, k), np.float32)
        most = even(ends, self.batch)
        scale = 1.0 / max(1, len(streams(ends, most)[0]))  # every token weighs the same
        for at, inside, y, clear in self._windows(ids, ends, most):
            live = at.shape[1]
            h = h[:live]
            x, rows = self._inputs(y)
            states, n = (np.empty((*at.shape, k), np.float32) for _ in range(2))
            a = np.empty((3, *at.shape, k), np.float32)
            for t in range(len(at)):
                states[t] = h
                h = self._step(h, x.take(rows[:, t], axis=0), clear[t], (a[:, t], n[t]))
            grad: dict = {}
            if inside.all():
                self._output(states.reshape(-1, k), y.ravel(), grad)
                dm = grad.pop("m").reshape(states.shape)
            else:
                self._output(states[inside], y[inside], grad)
                dm = np.zeros_like(states)
                dm[inside] = grad.pop("m")
            dh, part, through, cleared = np.zeros_like(h), np.empty_like(h), np.empty((3, *h.shape), np.float32), clear.any(1).tolist()
            back = p["u"].reshape(k, 3, k).transpose(1, 2, 0)
            # the gradients of a step take the place of its gates, of the candidate's part of the state and of the candidate
            for t in range(len(at) - 1, -1, -1):
                (r, z, q), nt = a[:, t], n[t]
                if cleared[t]:
                    dh[clear[t]] = 0  # a state that is cleared passes no gradient back
                on = dh * z
                dh -= on
                np.subtract(states[t], nt, out=part)
                part *= z
                np.multiply(part, dh, out=z)
                nt *= nt
                nt *= dh
                np.subtract(dh, nt, out=nt)
                np.multiply(nt, q, out=part)
                part *= r
                np.multiply(nt, r, out=q)
                r *= part
                np.subtract(part, r, out=r)
                np.matmul(a[:, t], back, out=through)
                dh = on
                dh += through[0]
                dh += through[1]
                dh += through[2]
                dh += dm[t]
            grad["u"] = np.concatenate((states.swapaxes(1, 2) @ a).sum(1), axis=1)
            flat = y.ravel()
            order = _by_id(flat, len(p["x"]))
            ordered = flat[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            touched, dx = ordered[first], np.zeros((len(flat), 3 * k + k % 2), np.float32)
            for i, d in enumerate((a[0], a[1], n)):
                dx[:, i * k : (i + 1) * k] = d.reshape(-1, k).take(order, axis=0)
            sums = np.add.reduceat(dx.view(np.complex64), first).view(np.float32)[:, : 3 * k] * scale  # two numbers an addition
            memory["x"][touched] += sums * sums
            p["x"][touched] -= rate * sums / np.sqrt(memory["x"][touched] + 1e-6)
            for name in ("u", "c", "o"):
                g = grad[name]
                g *= scale
                np.clip(g, -5, 5, out=g)
                root = g * g
                memory[name] += root
                np.add(memory[name], 1e-6, out=root)
                np.sqrt(root, out=root)
                g *= rate
                g /= root
                p[name] -= g
        return len(ids)


def memory_of(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.full_like(v, 0.01) for k, v in p.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = v[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out
