"""A convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its
maximum over a window, and a linear layer scores the windows' maxima combined over a document (their
mean, and for ``whole_max`` their maximum too). Windows overlap by the largest width less one, so every
position of a whole text is seen.

Applying it folds embedding and filters into two tables indexed by byte pairs: a filter of up to four
taps is then two table look-ups and a sum per position.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

TAPS = 4
WINDOW = 256
STRIDE = WINDOW - (TAPS - 1)


def encode(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def window_count(n_bytes: int) -> int:
    return max(1, -(-(n_bytes - (TAPS - 1)) // STRIDE))


def windows(data: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Windows (all, or those at the given numbers) of a text's bytes, zero-padded."""
    which = np.arange(window_count(len(data))) if which is None else which
    padded = np.zeros(int(which.max()) * STRIDE + WINDOW if len(data) < (int(which.max()) * STRIDE + WINDOW) else len(data), np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[which * STRIDE]


@dataclass
class ByteCnn:
    """``embed`` (256, d); ``filters`` (TAPS * d, F), zero beyond a filter's width; ``out`` (F or 2F, classes)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    whole_max: bool

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        taps = self.filters.reshape(TAPS, self.embed.shape[1], -1)
        one = np.stack([self.embed @ t for t in taps])  # (TAPS, 256, F)
        pair = lambda a, b: (one[a][:, None, :] + one[b][None, :, :]).reshape(65536, -1).astype(np.float32)
        return np.ascontiguousarray(pair(0, 1) + self.bias.astype(np.float32)), np.ascontiguousarray(pair(2, 3))

    def logits(self, pooled_mean: np.ndarray, pooled_max: np.ndarray) -> np.ndarray:
        features = np.concatenate([pooled_mean, pooled_max], axis=1) if self.whole_max else pooled_mean
        return features @ self.out + self.out_bias


class Applied:
    """A network ready to score texts; made once per task."""

    def __init__(self, net: ByteCnn, block: int = 64):
        self.net, self.block = net, block
        self.first, self.second = net.tables()
        self.places = WINDOW - TAPS + 1
        shape = (block, self.places, self.first.shape[1])
        self.a, self.b = np.empty(shape, np.float32), np.empty(shape, np.float32)

    def pool(self, own: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each of at most ``block`` windows, cut at zero."""
        n, p = len(own), self.places
        pairs = own[:, :-1].astype(np.intp) * 256 + own[:, 1:]
        a, b = self.a[:n], self.b[:n]
        np.take(self.first, pairs[:, :p], axis=0, out=a, mode="clip")
        np.take(self.second, pairs[:, 2 : 2 + p], axis=0, out=b, mode="clip")
        a += b
        return np.maximum(a.max(axis=1), 0)

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        """Softmax over the classes, one row per text; texts are read whole, in blocks of windows across texts."""
        sums: list[np.ndarray] = []
        tops: list[np.ndarray] = []
        counts: list[int] = []
        waiting: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def work(last: bool) -> None:
            nonlocal waiting, owners, held
            if not held or (held < self.block and not last):
                return
            rows, who = np.concatenate(waiting), np.concatenate(owners)
            upto = len(rows) if last else len(rows) // self.block * self.block
            for at in range(0, upto, self.block):
                pooled, own = self.pool(rows[at : min(upto, at + self.block)]), who[at : min(upto, at + self.block)]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                for i, s, m in zip(own[starts], np.add.reduceat(pooled, starts, axis=0), np.maximum.reduceat(pooled, starts, axis=0), strict=True):
                    sums[i] += s
                    np.maximum(tops[i], m, out=tops[i])
            waiting, owners, held = [rows[upto:]], [who[upto:]], len(rows) - upto

        width = self.first.shape[1]
        for i, text in enumerate(texts):
            data = encode(text)
            n = window_count(len(data))
            sums.append(np.zeros(width, np.float64))
            tops.append(np.zeros(width, np.float64))
            counts.append(n)
            for at in range(0, n, 512):
                which = np.arange(at, min(n, at + 512))
                waiting.append(windows(data[at * STRIDE : (which[-1]) * STRIDE + WINDOW], which - at))
                owners.append(np.full(len(which), i))
                held += len(which)
                work(False)
        work(True)
        if not sums:
            return np.zeros((0, len(self.net.out_bias)))
        z = self.net.logits(np.stack(sums) / np.array(counts)[:, None], np.stack(tops))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


#: Windows whose convolutions are held at once while training.
_CHUNK = 256


def _patches(emb: np.ndarray, dim: int) -> np.ndarray:
    """(n, places, TAPS * dim) view of embedded windows."""
    return np.lib.stride_tricks.sliding_window_view(emb.reshape(len(emb), -1), TAPS * dim, axis=1)[:, ::dim]


def _pooled(p: dict[str, np.ndarray], x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of each filter's maximum in each window, a bounded number of windows at a time."""
    tops, raws = [], []
    for at in range(0, len(x), _CHUNK):
        cols = _patches(p["e"][x[at : at + _CHUNK]], dim)
        conv = (cols.reshape(-1, TAPS * dim) @ p["w"]).reshape(len(cols), cols.shape[1], -1)
        top = conv.argmax(axis=1)
        tops.append(top)
        raws.append(np.take_along_axis(conv, top[:, None, :], 1)[:, 0] + p["b"])
    return np.concatenate(tops), np.concatenate(raws)


def train(bags: list[np.ndarray], labels: np.ndarray, n_classes: int, whole_max: bool, widths: tuple[int, ...] = (2, 3, 4), per_width: int = 12, dim: int = 8, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Fit by Adam on bags of windows (one bag per document, all its windows). The gradient runs through each filter's maximum only."""
    rng = np.random.default_rng(seed)
    n_filters = len(widths) * per_width
    mask = np.zeros((TAPS, dim, n_filters), np.float32)
    for k, w in enumerate(widths):
        mask[:w, :, k * per_width : (k + 1) * per_width] = 1
    mask = mask.reshape(TAPS * dim, n_filters)
    p = {
        "e": rng.normal(0, 0.5, (256, dim)), "w": rng.normal(0, 0.3, (TAPS * dim, n_filters)) * mask, "b": np.zeros(n_filters),
        "v": rng.normal(0, 0.1, (n_filters * (1 + whole_max), n_classes)), "c": np.zeros(n_classes),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    if not bags:
        return ByteCnn(p["e"], p["w"], p["b"], p["v"] * 0, p["c"], whole_max)
    sizes = np.array([len(x) for x in bags])
    step, total = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[i] for i in pick])
            starts = np.r_[0, np.cumsum(sizes[pick])[:-1]]
            owner = np.repeat(np.arange(len(pick)), sizes[pick])
            top, raw = _pooled(p, x, dim)
            h = np.maximum(raw, 0)
            features = np.add.reduceat(h, starts, axis=0) / sizes[pick][:, None]
            if whole_max:
                high = np.maximum.reduceat(h, starts, axis=0)
                features = np.concatenate([features, high], axis=1)
            z = features @ p["v"] + p["c"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(pick)), labels[pick]] -= 1
            q /= len(pick)
            g = {"v": features.T @ q + 1e-4 * p["v"], "c": q.sum(axis=0)}
            df = q @ p["v"].T
            dh = (df[:, :n_filters] / sizes[pick][:, None])[owner]
            if whole_max:
                dh = dh + df[owner, n_filters:] * (h == high[owner])
            dh = (dh * (raw > 0)).astype(np.float32)
            g["b"], g["w"], g["e"] = dh.sum(axis=0), np.zeros_like(p["w"]), np.zeros_like(p["e"])
            for lo in range(0, len(x), 8 * _CHUNK):
                part = slice(lo, lo + 8 * _CHUNK)
                own, d = x[part], dh[part]
                touched = own[np.arange(len(own))[:, None, None], top[part][:, :, None] + np.arange(TAPS)]  # (n, F, TAPS)
                g["w"] += np.einsum("nf,nfk->kf", d, p["e"][touched].reshape(len(own), n_filters, -1), optimize=True) * mask
                back = (d[:, :, None] * p["w"].T[None]).reshape(-1, dim)
                for j in range(dim):
                    g["e"][:, j] += np.bincount(touched.ravel(), back[:, j], 256).astype(np.float32)
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.9 * step / total)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return ByteCnn(p["e"], p["w"], p["b"], p["v"], p["c"], whole_max)


def scored(batches: Iterator, net: ByteCnn) -> Iterator:
    """(batch, probabilities) for Arrow batches whose column 1 is the text."""
    applied = Applied(net)
    for batch in batches:
        yield batch, applied.probabilities(t.as_py() for t in batch.column(1))
