"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words are runs of letters, lower-cased. A word's input is its own embedding (words
seen in enough training texts) beside the mean embedding of its hashed character
n-grams, edges marked. A window of ``length`` words starts at every word up to the last
that has as many; a shorter text is one window. Each window goes through a gated recurrent
network in both directions; attention weights pool the states to one logit. The
score of a text is the calibrated probability of its highest window.

Windows that start at neighbouring words take their inputs from one array, a column a
word, so a step of all of them is a slice of it and no input is gathered twice.

Labels are of texts, not windows. Of a toxic training text the windows around the
words and word beginnings with the highest log-odds are positive; windows of clean
training texts, one every ``stride`` words, are negative; after each round of fitting, those of
all windows that it ranks highest are added for the next. Rows to learn from are a sample of about ``toxic_rows`` and ``clean_rows`` labelled
rows at most, of texts up to ``train_chars`` characters; scoring has no limits.

Null, empty and letter-free texts have no window and get score 0; equal texts get equal
scores. Without labelled rows of both kinds every text gets 0. A column named ``toxicity``
is replaced. A text is tokenised in pieces, so long ones need no more room than others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import tidy

WORDS = re.compile(r"[^\W\d_]+")
GRAMS = (3, 4, 5, 6)
_CACHE_WORDS = 100_000
_WINDOWS = 2048
_WORDS = 4096


def tokenize(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def gram_ids(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the character n-grams of ``words`` and, for each word, how many it has (one at least)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(f"\x02{'\x03\x02'.join(words)}\x03".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    count = sum(np.maximum(size - i + 1, 0) for i in GRAMS)
    # where a word's n-grams go, less where its characters are: shorter ones first, each by place
    at = np.cumsum(count) - count - (np.cumsum(size) - size)
    out = np.empty(count.sum(), np.int32)
    h = flat * np.uint64(0x9E3779B97F4A7C15)
    for i in range(1, max(GRAMS)):
        if len(flat) <= i:
            break
        h = (h[: len(flat) - i] ^ flat[i:]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        if i + 1 in GRAMS:
            own = np.flatnonzero(owner[: len(flat) - i] == owner[i:])
            ids = h[own] >> np.uint64(17)
            out[own + at[owner[own]]] = ids & np.uint64(buckets - 1) if buckets & (buckets - 1) == 0 else ids % np.uint64(buckets)
            at += np.maximum(size - i, 0)
    return out, count


def window_starts(n: int, length: int, stride: int) -> np.ndarray:
    """Starts of every ``stride``-th window of a text of n > 0 words, to learn from; the last one ends with the text."""
    if n <= length:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - length + 1, stride)
    return starts if starts[-1] == n - length else np.append(starts, n - length)


def _sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by the index in ``rows``."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) > 0)))
        out[rows[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Net:
    """Parameters and passes. Shapes: words x (dw + dc) inputs, states of ``hidden`` for each direction."""

    def __init__(self, vocab: int, buckets: int, dw: int, dc: int, hidden: int, att: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        d, h = dw + dc, hidden
        self.hidden = h
        self.p = {
            "word": rng.normal(0, 0.1, (vocab, dw)) * (np.arange(vocab) > 0)[:, None],
            "char": rng.normal(0, 0.03, (buckets, dc)),  # small: an n-gram never trained says nothing
            **{f"W{k}": rng.normal(0, d**-0.5, (d, 3 * h)) for k in "fb"},
            **{f"U{k}": rng.normal(0, h**-0.5, (h, 3 * h)) for k in "fb"},
            **{f"b{k}": np.zeros(3 * h) for k in "fb"},
            "A": rng.normal(0, (2 * h) ** -0.5, (2 * h, att)),
            "v": rng.normal(0, att**-0.5, att),
            "o": rng.normal(0, (2 * h) ** -0.5, 2 * h),
            "c": np.array([-1.0]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, word: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Input rows of words: ids of their own embeddings, and their n-gram ids, ``count`` for each."""
        starts = np.concatenate(([0], np.cumsum(count)[:-1]))
        mean = np.add.reduceat(self.p["char"][grams], starts, axis=0) / count[:, None]
        return np.hstack([self.p["word"][word], mean]).astype(np.float32)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]

    def forward(self, gf: np.ndarray, gb: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows. ids: windows x length, rows of the projected inputs; mask: False at padding."""
        h2, (b, n) = self.hidden, ids.shape
        states, tape = {}, {}
        for k, g, steps in (("f", gf, range(n)), ("b", gb, range(n - 1, -1, -1))):
            u, h = self.p[f"U{k}"], np.zeros((b, h2), np.float32)
            out = np.empty((n, b, h2), np.float32)
            for t in steps:
                a, hu = g[ids[:, t]], h @ u
                zr = _sigmoid(a[:, : 2 * h2] + hu[:, : 2 * h2])
                z, r = zr[:, :h2], zr[:, h2:]
                cand = np.tanh(a[:, 2 * h2 :] + r * hu[:, 2 * h2 :])
                new = cand + z * (h - cand)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    tape[k, t] = (h, z, r, cand, hu[:, 2 * h2 :])
                out[t] = h = new
            states[k] = out
        s = np.concatenate([states["f"], states["b"]], axis=2)  # length x windows x 2h
        e = np.tanh(s @ self.p["A"])
        w = e @ self.p["v"]
        if mask is not None:
            w = np.where(mask.T, w, -1e9)
        w = np.exp(w - w.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, s)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, (s, e, w, pooled, tape)) if keep else logit

    def every(self, gf: np.ndarray, gb: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Logits of the windows of ``n`` words that start at each word of ``ids`` up to the last that has as many."""
        out = np.empty(max(0, len(ids) - n + 1), np.float32)
        for a in range(0, len(out), _WINDOWS):
            b = min(_WINDOWS, len(out) - a)
            part = ids[a : a + b + n - 1]
            out[a : a + b] = self._slid(gf[part].T, gb[part].T, b, n)
        return out

    def _slid(self, gf: np.ndarray, gb: np.ndarray, b: int, n: int) -> np.ndarray:
        """Logits of ``b`` windows from gate inputs with a column a word; states have a row a unit and a column a window."""
        h = self.hidden
        states = np.empty((n, 2 * h, b), np.float32)
        hu, gates, cand = np.empty((3 * h, b), np.float32), np.empty((2 * h, b), np.float32), np.empty((h, b), np.float32)
        for k, g, lo in (("f", gf, 0), ("b", gb, h)):
            # sigmoid(x) = (1 + tanh(x / 2)) / 2: the inner half goes into the weights, as does the outer one of the reset gate
            g = np.multiply(g, np.repeat(np.float32([0.5, 1]), (2 * h, h))[:, None], order="C")
            u, state = np.ascontiguousarray(self.p[f"U{k}"].T * np.float32(0.5)), None
            for t in range(n) if k == "f" else range(n - 1, -1, -1):
                x, new = g[:, t : t + b], states[t, lo : lo + h]
                if state is None:  # a window starts from zero
                    np.tanh(x[:h], out=gates[:h])
                    np.tanh(x[2 * h :], out=cand)
                    np.subtract(1, gates[:h], out=new)
                    new *= np.float32(0.5)
                    new *= cand
                else:
                    np.matmul(u, state, out=hu)
                    np.add(x[: 2 * h], hu[: 2 * h], out=gates)
                    np.tanh(gates, out=gates)
                    gates += 1
                    np.multiply(gates[h:], hu[2 * h :], out=cand)
                    cand += x[2 * h :]
                    np.tanh(cand, out=cand)
                    np.subtract(state, cand, out=new)
                    new *= gates[:h]
                    new *= np.float32(0.5)
                    new += cand
                state = new
        both = np.vstack([self.p["A"].T, self.p["o"]])
        weight, worth, e = np.empty((n, b), np.float32), np.empty((n, b), np.float32), np.empty((len(both), b), np.float32)
        for t in range(n):
            np.matmul(both, states[t], out=e)
            worth[t] = e[-1]
            np.matmul(self.p["v"], np.tanh(e[:-1], out=e[:-1]), out=weight[t])
        weight -= weight.max(0)
        np.exp(weight, out=weight)
        return (weight * worth).sum(0) / weight.sum(0) + self.p["c"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean logistic loss; those of the input rows x come apart."""
        gf, gb = self.project(x)
        logit, (s, e, w, pooled, tape) = self.forward(gf, gb, ids, mask, keep=True)
        p, h2, (b, n) = _sigmoid(logit), self.hidden, ids.shape
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = ((p - y) / b).astype(np.float32)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()])}
        dpool = d[:, None] * self.p["o"]
        ds = w[:, :, None] * dpool
        dw = np.einsum("tbh,bh->tb", s, dpool)
        dw = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tb,tba->a", dw, e)
        de = dw[:, :, None] * self.p["v"] * (1 - e * e)
        g["A"] = np.einsum("tbh,tba->ha", s, de)
        ds = ds + de @ self.p["A"].T
        dx = np.zeros_like(x)
        for k, lo, steps in (("f", 0, range(n - 1, -1, -1)), ("b", h2, range(n))):
            u, dh = self.p[f"U{k}"], np.zeros((b, h2), np.float32)
            gu, da_all = np.zeros_like(u), np.empty((n, b, 3 * h2), np.float32)
            for t in steps:
                h, z, r, cand, hun = tape[k, t]
                dh = dh + ds[t][:, lo : lo + h2]
                m = mask[:, t, None]
                live = np.where(m, dh, 0)
                dcand = live * (1 - z) * (1 - cand * cand)
                dz = live * (h - cand) * z * (1 - z)
                dr = dcand * hun * r * (1 - r)
                da = np.hstack([dz, dr, dcand])
                dhu = np.hstack([dz, dr, dcand * r])
                gu += h.T @ dhu
                da_all[t] = da
                dh = np.where(m, live * z, dh) + dhu @ u.T
            g[f"U{k}"] = gu
            dgate = _sum_by(ids.T.ravel(), da_all.reshape(n * b, -1), len(x))
            g[f"W{k}"], g[f"b{k}"] = x.T @ dgate, dgate.sum(0)
            dx += dgate @ self.p[f"W{k}"].T
        return g, dx, loss


@dataclass
class ToxModel:
    net: Net | None
    vocab: dict[str, int]
    buckets: int
    length: int
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self._rows: dict[str, int] = {}
        self._proj: list[np.ndarray] = []

    def forget(self) -> None:
        """Empty the projection cache."""
        self._rows, self._proj = {}, []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _project(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for a in range(0, len(words), _WORDS):  # an n-gram takes a row of its own for a moment
            some = words[a : a + _WORDS]
            own = np.fromiter((self.vocab.get(w, 0) for w in some), np.int32, len(some))
            parts.append(self.net.project(self.net.inputs(own, *gram_ids(some, self.buckets))))
        return tuple(np.vstack(g) for g in zip(*parts, strict=True))

    def _ids(self, words: list[str]) -> np.ndarray:
        """Rows of the projection cache for ``words``; new ones are projected together."""
        if len(self._rows) > _CACHE_WORDS:
            self.forget()
        rows, new = self._rows, []
        for w in dict.fromkeys(words):
            if w not in rows:
                rows[w] = len(rows)
                new.append(w)
        if new:
            gf, gb = self._project(new)
            if self._proj:
                gf, gb = np.vstack([self._proj[0], gf]), np.vstack([self._proj[1], gb])
            self._proj = [gf, gb]
        return np.fromiter(map(rows.__getitem__, words), np.int32, len(words))

    def window_logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Logits of all windows of each tokenised text, by the word they start at; none without a word."""
        ids = self._ids([w for t in texts for w in t])
        n, sizes = self.length, np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        logits = self.net.every(*self._proj, ids, n) if (sizes >= n).any() else np.zeros(0, np.float32)  # those that begin in one text and end in another are left out below
        found = [logits[a : a + max(0, size - n + 1)] for a, size in zip(first, sizes, strict=True)]
        step = np.arange(n)
        for a in range(0, len(short), _WINDOWS):
            part = short[a : a + _WINDOWS]
            mask = step < sizes[part][:, None]
            z = self.net.forward(*self._proj, ids[np.minimum(first[part][:, None] + step, len(ids) - 1)], mask)
            for i, value in zip(part, z, strict=True):
                found[i] = np.array([value], np.float32)
        return found

    def top_logits(self, texts: list[list[str]]) -> np.ndarray:
        """The highest logit of each tokenised text over all of its windows; -inf without a word."""
        return np.array([z.max(initial=-np.inf) for z in self.window_logits(texts)])

    def scores(self, texts: list[str | None], words_at_once: int = 200_000) -> np.ndarray:
        """Calibrated probability of each text's highest window; 0 without a word.

        Texts are put together to about ``words_at_once`` words. A longer one is cut into pieces that share
        ``length`` - 1 words, and the highest of its pieces counts.
        """
        top = np.full(len(texts), -np.inf)
        if self.net is None:
            return np.zeros(len(texts))
        part, owner, size = [], [], 0

        def flush() -> None:
            nonlocal part, owner, size
            if part:
                np.maximum.at(top, owner, self.top_logits(part))
            part, owner, size = [], [], 0

        for i, text in enumerate(texts):
            for piece in _pieces(text, words_at_once, self.length - 1):
                part.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= words_at_once:
                    flush()
        flush()
        z = np.clip(self.scale * np.where(np.isfinite(top), top, 0) + self.shift, -50, 50)
        return np.where(np.isfinite(top), 1 / (1 + np.exp(-z)), 0.0)


def _pieces(text: str | None, most: int, shared: int) -> Iterator[list[str]]:
    """The words of a text, in pieces of up to ``most`` words that share ``shared`` words with the one before."""
    if not text or len(text) <= most:  # a word has a letter at least
        if words := tokenize(text):
            yield words
        return
    words: list[str] = []
    fresh = 0
    for m in WORDS.finditer(text.lower()):
        words.append(m.group())
        fresh += 1
        if len(words) == most:
            yield words
            words, fresh = words[len(words) - shared :], 0
    if fresh:
        yield words


def _clues(toxic: list[list[str]], clean: list[list[str]], least: int) -> dict[str, float]:
    """Log-odds of words and word beginnings (5 letters) that mark toxic texts."""

    def seen(texts: list[list[str]]) -> Counter:
        c: Counter = Counter()
        for t in texts:
            words = set(t)
            c.update(words)
            c.update({f"{w[:5]}*" for w in words if len(w) > 5})
        return c

    pos, neg = seen(toxic), seen(clean)
    odds = {k: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((neg[k] + 0.5) / (len(clean) + 1)) for k, n in pos.items() if n >= least}
    return {k: v for k, v in odds.items() if v > 2.0}


def train(
    toxic: list[list[str]],
    clean: list[list[str]],
    length: int = 12,
    stride: int = 6,
    hidden: int = 8,
    buckets: int = 32768,
    vocab_docs: int = 4,
    negatives: int = 12_000,
    epochs: int = 2,
    rounds: int = 4,
    seed: int = 3,
) -> ToxModel:
    """Fit on tokenised texts of either kind."""
    toxic, clean = [t for t in toxic if t], [t for t in clean if t]
    if len(toxic) < 2 or len(clean) < 2:
        return ToxModel(None, {}, buckets, length)
    rng = np.random.default_rng(seed)
    aside = [g[::5] for g in (toxic, clean)]  # for calibration only
    toxic, clean = ([t for i, t in enumerate(g) if i % 5 or len(g) < 10] for g in (toxic, clean))
    docs = Counter(w for t in toxic + clean for w in set(t))
    vocab = {w: i + 1 for i, w in enumerate(sorted(w for w, n in docs.items() if n >= vocab_docs))}
    net = Net(len(vocab) + 1, buckets, 8, 8, hidden, 8, seed)
    model = ToxModel(net, vocab, buckets, length)
    clues = _clues(toxic, clean, max(2, len(toxic) // 150))

    positive, negative = [], []
    for t in toxic:
        worth = np.array([max(clues.get(w, 0.0), clues.get(f"{w[:5]}*", 0.0)) for w in t])
        hits = np.flatnonzero(worth > 0)
        for i in rng.permutation(hits)[:8]:
            a = int(np.clip(i - rng.integers(0, length), 0, max(0, len(t) - length)))
            positive.append(t[a : a + length])
    every = [(i, a) for i, t in enumerate(clean) for a in window_starts(len(t), length, stride)]
    for j in rng.permutation(len(every))[:negatives]:
        i, a = every[j]
        negative.append(clean[i][a : a + length])
    for t in clean[:: max(1, len(clean) // 1500)]:  # short texts and text ends
        k = int(rng.integers(1, length))
        negative.append(t[:k])
    if not positive:
        return ToxModel(None, {}, buckets, length)
    moments: dict[str, list[np.ndarray]] = {}
    hard: list[list[str]] = []
    for again in range(rounds):
        _fit(net, model, positive, negative + hard, epochs, rng, moments, rate=0.01 * 0.6**again)
        model.forget()
        if again + 1 < rounds:
            for a in range(0, len(clean), 200):
                part = clean[a : a + 200]
                for t, z in zip(part, model.window_logits(part), strict=True):
                    best = [int(a + z[a : a + stride].argmax()) for a in range(0, len(z), stride)]  # of neighbours the highest
                    hard += [t[j : j + length] for j in sorted(best, key=lambda j: -z[j])[:6] if z[j] > -3]
    model.forget()
    if len(aside[0]) < 60:  # too few to calibrate by alone
        aside = [aside[0] + toxic, aside[1] + clean]
    tops = [np.concatenate([model.top_logits(g[a : a + 200]) for a in range(0, len(g), 200)]) for g in aside]
    model.scale, model.shift = _platt(tops[0], tops[1])
    model.forget()
    return model


def _platt(pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of top logits, by Newton steps with a light ridge; the slope stays positive."""
    x = np.concatenate([pos, neg]).astype(float)
    y = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
    mean, sd = x.mean(), x.std() + 1e-9
    f = np.stack([(x - mean) / sd, np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (p - y) + 1e-2 * w
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    if w[0] <= 0:
        return 1.0, 0.0
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


def _fit(net: Net, model: ToxModel, positive: list, negative: list, epochs: int, rng: np.random.Generator, moments: dict, rate: float = 0.01, size: int = 256) -> None:
    """Adam over balanced batches; embeddings move only where a batch uses them."""
    words = list(dict.fromkeys(w for t in positive + negative for w in t))
    index = {w: i for i, w in enumerate(words)}
    grams, count = gram_ids(words, model.buckets)
    ends = np.cumsum(count)
    own = np.fromiter((model.vocab.get(w, 0) for w in words), np.int32, len(words))
    n = model.length

    def packed(windows: list) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = np.zeros((len(windows), n), np.int64), np.zeros((len(windows), n), bool)
        for i, t in enumerate(windows):
            ids[i, : len(t)] = [index[w] for w in t]
            mask[i, : len(t)] = True
        return ids, mask

    pi, pm = packed(positive)
    ni, nm = packed(negative)
    step = 0
    batches = -(-len(negative) // (size * 3 // 4))
    for _ in range(epochs):
        order = rng.permutation(len(negative))
        for b in range(batches):
            step += 1
            lr = rate * (1 - 0.9 * step / (epochs * batches))
            neg = order[b * (size * 3 // 4) : (b + 1) * (size * 3 // 4)]
            pos = rng.integers(0, len(positive), size // 4)
            ids, mask = np.vstack([pi[pos], ni[neg]]), np.vstack([pm[pos], nm[neg]])
            y = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))]).astype(np.float32)
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            spans = [np.arange(ends[w] - count[w], ends[w]) for w in used]
            g_ids, g_n = grams[np.concatenate(spans)], count[used]
            word = np.where(rng.random(len(used)) < 0.4, 0, own[used])  # as words outside the vocabulary stand
            x = net.inputs(word, g_ids, g_n)
            grad, dx, _ = net.gradients(x, local, mask, y)
            for k, g in grad.items():
                m = moments.setdefault(k, [np.zeros_like(net.p[k]), np.zeros_like(net.p[k])])
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                net.p[k] -= (lr * m[0] / (np.sqrt(m[1]) + 1e-6)).astype(np.float32)
            dw = net.p["word"].shape[1]
            for k, rows, part in (("word", word, dx[:, :dw]), ("char", g_ids, np.repeat(dx[:, dw:] / g_n[:, None], g_n, axis=0))):
                u, inv = np.unique(rows, return_inverse=True)
                g = _sum_by(inv, part, len(u))
                m = moments.setdefault(k, [np.zeros((len(net.p[k]), 1), np.float32)])
                m[0][u] += (g * g).mean(1, keepdims=True)
                net.p[k][u] -= (5 * lr * g / (np.sqrt(m[0][u]) + 1e-5)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, clean_rows: int = 3000, train_chars: int = 30_000, seed: int = 3, **training: float) -> ToxModel:
    """Fit from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1; other labels are left out).

    Each class of labels is sampled by a hash of the id, about ``toxic_rows`` and ``clean_rows`` at most. That bounded
    sample is broadcast to the documents, so no text is shuffled; texts that are null or longer than ``train_chars`` are
    not learned from.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    at_random = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("toxic") == 1, toxic_rows / max(1, n.get(1, 0))).otherwise(clean_rows / max(1, n.get(0, 0)))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.char_length("text") <= train_chars))
    taken = texts.join(F.broadcast(rows.where(at_random < share)), "doc_id").collect()
    taken.sort(key=lambda r: (r["doc_id"], r["text"]))
    kinds = [[tokenize(r["text"]) for r in taken if r["toxic"] == k] for k in (1, 0)]
    return train(kinds[0], kinds[1], seed=seed, **training)


def score(docs: DataFrame, model: ToxModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, from 0 to 1. A map over rows with the model as a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in batch]))
        shared.value.forget()

    kept = [c for c in docs.columns if c != "toxicity"]
    return docs.select(*kept, predict(F.col(text)).alias("toxicity"))
