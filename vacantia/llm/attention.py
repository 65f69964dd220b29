"""A small causal self-attention model over subword ids, in numpy.

The network predicts the group of the next piece, then its class in that group, from a window; a piece's share of its
class is its share of all training pieces there. Frequent pieces are classes of their own, so little is lost. The first
groups hold the pieces that begin a word, and the end, so the probability that a word ends before a place is a sum of groups.
"""

from __future__ import annotations

import numpy as np

WIDTH, CONTEXT, DIM = 32, 8, 24
#: Groups, classes in a group; how many groups hold pieces that begin words; how many classes (the last ones of these and of
#: the other groups) hold several pieces, of equal weight.
GROUPS, SIZE, BEGINNING, SHARED = 32, 32, 20, 16
CLASSES = GROUPS * SIZE
BEGIN, END = 1, 2
#: Weight of the network beside the words' own shares.
LAMBDA = 0.5


def classes(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each piece and log10 of its share of it, from the corpus's piece counts (each counts half more)."""
    out = np.zeros(len(counts), dtype=np.int64)
    for pieces, first, end in ((np.flatnonzero(begins), 0, BEGINNING * SIZE), (np.flatnonzero(~begins), BEGINNING * SIZE, CLASSES)):
        order = pieces[np.argsort(-counts[pieces], kind="stable")]
        single = end - first - SHARED
        out[order[:single]] = first + np.arange(min(single, len(order)))
        rest = order[single:]
        if len(rest):
            mass = np.cumsum(counts[rest] + 0.5)
            out[rest] = end - SHARED + np.minimum(SHARED - 1, (mass - 1e-9) * SHARED / mass[-1]).astype(np.int64)
    total = np.bincount(out, weights=counts + 0.5, minlength=CLASSES)
    return out, np.log10((counts + 0.5) / total[out]).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and first scored place of the windows over rows of `lengths` predictions: each is scored once.

    A row's first window scores all its places; each further one begins with CONTEXT places that the last one scored.
    """
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WIDTH) // (WIDTH - CONTEXT))), 0)
    row = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return row, k * (WIDTH - CONTEXT), np.where(k > 0, CONTEXT, 0)


_ONES = np.ones(32, dtype=np.float32)
_MASK = np.tril(np.ones((WIDTH, WIDTH), dtype=np.float32))
#: Between these, exp and the sums of it need no shift in float32.
_LOW, _HIGH = -60.0, 60.0


class Model:
    """One head of causal attention beside the token itself; output in two steps, group and class in the group."""

    def __init__(self, vocabulary: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        self.p = [draw(vocabulary, DIM), draw(WIDTH, DIM), draw(DIM, 3 * DIM), draw(DIM, DIM), draw(DIM, GROUPS), np.zeros(GROUPS, np.float32), draw(GROUPS, DIM, SIZE), np.zeros((GROUPS, SIZE), np.float32)]

    def _scaled(self) -> np.ndarray:
        """The weights of queries, keys and values; those of queries with the scale of the products."""
        w = self.p[2].copy()
        w[:, :DIM] *= np.float32(DIM**-0.5)
        return w

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scaled queries, keys and values of each piece and of each place; a window's are sums of these."""
        w = self._scaled()
        return self.p[0] @ w, self.p[1] @ w

    def _forward(self, x: np.ndarray, skip: int = 0, tables: tuple[np.ndarray, np.ndarray] | None = None):
        """States of the windows x; queries, keys, values, weights and outputs of the places from `skip` only, which see all before."""
        e, place, _, wo = self.p[:4]
        if tables is None:
            h = e.take(x, axis=0)
            h += place
            qkv = (h.reshape(-1, DIM) @ self._scaled()).reshape(*x.shape, 3 * DIM)
            h = h[:, skip:]
        else:
            h = e.take(x[:, skip:], axis=0)
            h += place[skip:]
            qkv = tables[0].take(x, axis=0)
            qkv += tables[1]
        q, k, v = qkv[:, skip:, :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
        a = np.matmul(q, k.transpose(0, 2, 1))
        if a.size and a.max() > 30:
            np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= _MASK[skip:]
        a /= (a.reshape(-1, WIDTH) @ _ONES[:WIDTH]).reshape(*a.shape[:2], 1)
        c = np.matmul(a, v)
        z = (c.reshape(-1, DIM) @ wo).reshape(c.shape)
        z += h
        np.clip(z, -6, 6, out=z)
        return h, q, k, v, a, c, z

    def log_shares(self, x: np.ndarray, where: np.ndarray, want: np.ndarray, skip: int = 0, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(class `want`) at the flat places `where` of the windows x, and log10 P(a word begins or the text ends) there.

        The latter only where `want` is of a piece that begins a word, or the end; elsewhere 0. Places are counted without
        each window's first `skip`. `tables` are those of the model, if many windows are scored.
        """
        group = (want // SIZE).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        z, want, group = _with_one(self._forward(x, skip, tables)[-1], where[order]), want[order], group[order]
        out, begin = np.empty(len(want), dtype=np.float32), np.zeros(len(want), dtype=np.float32)
        edges = np.searchsorted(group, np.arange(GROUPS + 1))
        n = edges[BEGINNING]
        wg, wi = self._ends()
        logits = z @ wg
        both, begin[order[:n]] = _log_softmax_at(logits, group, BEGINNING, n)
        both += _log_softmax_at(_inner(z, edges, wi, logits), want % SIZE)
        out[order] = both
        return out / np.float32(np.log(10)), begin / np.float32(np.log(10))

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of groups and of classes in them, each with its shifts as the last row, for states that end in a 1."""
        return np.concatenate([self.p[4], self.p[5][None]]), np.concatenate([self.p[6], self.p[7][:, None]], axis=1)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.012, seed: int = 9, done: float = 0.0, part: float = 1.0) -> None:
        """Adam over windows x of ids with next classes y (-1: none): `part` of the whole training, after `done` of it."""
        rng = np.random.default_rng(seed)
        # The pieces' numbers, of which a step needs some rows, and all other parameters as one vector.
        m, v, rest = np.zeros_like(self.p[0]), np.zeros_like(self.p[0]), np.zeros((2, sum(a.size for a in self.p[1:])), np.float32)
        step, steps = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                step += 1
                now = rate * min(1, step / 50) * (1 - 0.95 * (done + part * step / steps))
                used, (g, *others) = self._used_gradients(x[at], y[at])
                now_m, now_v = m.take(used, axis=0), v.take(used, axis=0)
                self.p[0][used] -= _adam(now_m, now_v, g, now, step)
                m[used], v[used] = now_m, now_v
                change, k = _adam(*rest, np.concatenate([g.reshape(-1) for g in others]), now, step), 0
                for a in self.p[1:]:
                    a -= change[k : k + a.size].reshape(a.shape)
                    k += a.size

    def moved(self, old: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """`changed` by training on windows x."""
        return self.changed(old, np.bincount(x.reshape(-1), minlength=len(old[0])), len(x))

    def changed(self, old: list[np.ndarray], uses: np.ndarray, n: int) -> np.ndarray:
        """What training changed from `old`, times its weight (a piece's uses, else the n windows), and the weights."""
        uses = uses.astype(np.float32)
        rest = [((a - b) * np.float32(n)).reshape(-1) for a, b in zip(self.p[1:], old[1:], strict=True)]
        return np.concatenate([((self.p[0] - old[0]) * uses[:, None]).reshape(-1), uses, *rest, [np.float32(n)]]).astype(np.float32)

    def move(self, total: np.ndarray) -> None:
        """The weighted mean of what the parts of the corpus changed, from the sum of their `moved`."""
        total, n = np.asarray(total, dtype=np.float64), len(self.p[0])
        uses = total[n * DIM : n * DIM + n]
        self.p[0] += (total[: n * DIM].reshape(n, DIM) / np.maximum(uses, 1)[:, None]).astype(np.float32)
        at = n * DIM + n
        for a in self.p[1:]:
            a += (total[at : at + a.size] / max(1.0, total[-1])).astype(np.float32).reshape(a.shape)
            at += a.size

    def _gradients(self, x, y):
        """The gradients of all parameters."""
        used, grads = self._used_gradients(x, y)
        de = np.zeros_like(self.p[0])
        de[used] = grads[0]
        return de, *grads[1:]

    def _used_gradients(self, x, y):
        """The pieces that x has, and the gradients: of these pieces' numbers, then of the other parameters."""
        wo, (wg, wi) = self.p[3], self._ends()
        h, q, k, v, a, c, z = self._forward(x)
        rows = lambda u: u.reshape(-1, u.shape[-1])
        there = np.flatnonzero(y.reshape(-1) >= 0)
        want = y.reshape(-1)[there]
        group = (want // SIZE).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        there, want, group = there[order], want[order], group[order]
        flat = _with_one(z, there)
        n = np.float32(max(1, len(want)))
        p = flat @ wg
        _softmax_less(p, group, n)
        dflat, dwg, dwi = p @ wg[:DIM].T, flat.T @ p, np.zeros_like(wi)
        edges = np.searchsorted(group, np.arange(GROUPS + 1))
        p = _inner(flat, edges, wi, p)
        _softmax_less(p, want % SIZE, n)
        for g in range(GROUPS):
            i, j = edges[g], edges[g + 1]
            if j > i:
                np.matmul(flat[i:j].T, p[i:j], out=dwi[g])
                dflat[i:j] += p[i:j] @ wi[g, :DIM].T
        dz = np.zeros_like(z)
        rows(dz)[there] = dflat
        dz *= np.abs(z) < 6
        dc = (rows(dz) @ wo.T).reshape(dz.shape)
        dqkv = np.empty((*x.shape, 3 * DIM), dtype=np.float32)
        np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[..., 2 * DIM :])
        ds = np.matmul(dc, v.transpose(0, 2, 1))
        # A row's sum of weights times their gradients is that of c times its gradient.
        ds -= (rows(dc * c) @ _ONES[:DIM]).reshape(*x.shape, 1)
        ds *= a
        np.matmul(ds, k, out=dqkv[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., DIM : 2 * DIM])
        dh = (rows(dqkv) @ self._scaled().T).reshape(dz.shape)
        dh += dz
        dw = rows(h).T @ rows(dqkv)
        dw[:, :DIM] *= np.float32(DIM**-0.5)
        small = x.reshape(-1).astype(np.uint16) if len(self.p[0]) <= 1 << 16 else x.reshape(-1)
        order = np.argsort(small, kind="stable")
        small = small[order]
        first = np.flatnonzero(np.concatenate([[True], small[1:] != small[:-1]]))
        de = np.add.reduceat(rows(dh).take(order, axis=0), first, axis=0)
        return small[first].astype(np.int64), (de, dh.sum(0), dw, rows(c).T @ rows(dz), dwg[:DIM], dwg[DIM], dwi[:, :DIM], dwi[:, DIM])


def _adam(m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: float, step: int) -> np.ndarray:
    """Takes the gradient g into the moments m and v, and gives what the parameters lose, in place of g."""
    m *= np.float32(0.9)
    m += np.float32(0.1) * g
    v *= np.float32(0.99)
    g *= g
    g *= np.float32(0.01)
    v += g
    np.multiply(v, np.float32(1 / (1 - 0.99**step)), out=g)
    np.sqrt(g, out=g)
    g += np.float32(1e-8)
    np.divide(m, g, out=g)
    g *= np.float32(rate / (1 - 0.9**step))
    return g


def _with_one(z: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The states at these flat places, each with a 1 behind it."""
    out = np.ones((len(places), DIM + 1), dtype=np.float32)
    out[:, :DIM] = z.reshape(-1, DIM).take(places, axis=0)
    return out


def _inner(z: np.ndarray, edges: np.ndarray, wi: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Into `out`: the logits of the classes in their group, of states sorted by group."""
    for g in range(GROUPS):
        i, j = edges[g], edges[g + 1]
        if j > i:
            np.matmul(z[i:j], wi[g], out=out[i:j])
    return out


def _shifted(x: np.ndarray) -> None:
    """Lessens each row by its largest number, where exp would overflow or its sum vanish otherwise."""
    if x.size and not (x.max() < _HIGH and x.min() > _LOW):
        x -= x.max(axis=1, keepdims=True)


def _softmax_less(x: np.ndarray, at: np.ndarray, n: np.float32) -> None:
    """In place: each row's shares less 1 at `at`, over n."""
    _shifted(x)
    np.exp(x, out=x)
    x *= (1 / ((x @ _ONES[: x.shape[1]]) * n))[:, None]
    x.reshape(-1)[np.arange(len(at)) * x.shape[1] + at] -= 1 / n


def _log_softmax_at(x: np.ndarray, at: np.ndarray, first: int = 0, rows: int = 0):
    """The log of each row's share at `at`; with `first`, also that of the first so many columns together, of the first `rows`."""
    _shifted(x)
    own = x.reshape(-1)[np.arange(len(at)) * x.shape[1] + at]
    np.exp(x, out=x)
    total = np.log(x @ _ONES)
    out = np.minimum(own - total, 0)
    return (out, np.minimum(np.log(np.maximum(x[:rows, :first] @ _ONES[:first], np.float32(1e-37))) - total[:rows], 0)) if first else out
