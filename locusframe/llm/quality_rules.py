"""Quality rules: fixed rules over document counts, and gradient-boosted trees over document statistics.

Every whole text is counted (words, characters in them, symbols, repeated lines, words in repeated five-word
windows) and becomes a vector of statistics. Trees are grown on histograms of at most BINS bins by second-order
boosting of the logistic loss, in numpy, on a bounded sample of labelled rows. Along the statistics of FALLING
(shares of symbols, repeated lines and repeated windows) a score never rises: a split against that direction isn't
taken, and both sides of one that follows it are kept on their side of its middle in all further splits. All trees
lie in flat arrays of nodes, and a batch of rows walks all of them at once, one level a step.

Repeated windows are found by a hash of their words, and those that share one are compared word by word.
Texts are batched to about a megabyte; a longer text is its own batch, and is split into words in pieces.

Null and empty texts have no words and fail the fixed rules, like all of fewer than ten words. Labels other than
0 and 1 and ids with both are left out; without labels every score is 0.5 and the fixed rules alone decide.
Equal texts get equal rows. Columns of the names added are replaced; others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import tidy

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = (
    "log_words", "log_chars", "word_mean", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "white", "beyond_ascii",
    "distinct", "top_word", "long_words", "short_words", "log_lines", "bar",
)
#: Statistics along which a score never rises.
FALLING = ("symbols", "dup_lines", "repeats")
WINDOW = 5
BINS = 64
_GROUP = 1 << 20  # bytes of text counted together
_WHITE = np.array([32, *range(9, 14)])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b".,;:?!'\"-()", np.uint8)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids (equal words, equal ids) of all texts, the text of each, and the words' bytes."""
    seen: dict[bytes, int] = {}
    ids, owner, size = [], [], []
    for i, data in enumerate(texts):
        at = 0
        while at < len(data):
            stop = len(data)
            if stop - at > _GROUP:
                stop = data.find(b" ", at + _GROUP)
                stop = len(data) if stop < 0 else stop
            words = data[at:stop].split()
            ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
            size.append(np.fromiter(map(len, words), np.int64, len(words)))
            owner.append(np.full(len(words), i, np.int64))
            at = stop
    none = [np.zeros(0, np.int64)]
    return np.concatenate(ids or none), np.concatenate(owner or none), np.concatenate(size or none)


def _repeated(ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text that stand in a window of WINDOW words found at least twice in it."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    h = owner[:n].astype(np.uint64)
    for i in range(WINDOW):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[0]) + ids[i : n + i].astype(np.uint64) * np.uint64(_ODD[1])
    starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    order = starts[np.argsort(h[starts], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    shared = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
    if not len(shared):
        return np.zeros(texts, np.int64)
    rows = np.column_stack([owner[shared], *(ids[shared + i] for i in range(WINDOW))])
    _, which, many = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    shared = shared[many[which.ravel()] > 1]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, shared, 1)
    np.add.at(change, shared + WINDOW, -1)
    return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=texts)


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and STATS of whole texts, a row for each."""
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    m = len(data)
    ids, owner, size = _word_ids(data)
    words = np.bincount(owner, minlength=m)
    kinds = np.zeros((m, 256), np.int64)
    lines = np.zeros((m, 2), np.int64)
    for i, d in enumerate(data):
        if d:
            kinds[i] = np.bincount(np.frombuffer(d, np.uint8), minlength=256)
            full = [x for x in d.split(b"\n") if x.strip()]
            lines[i] = len(full), len(full) - len(set(full))
    chars = kinds.sum(1) - kinds[:, 128:192].sum(1)
    white, symbols = kinds[:, _WHITE].sum(1), kinds[:, _SYMBOLS].sum(1)
    repeats = _repeated(ids, owner, m)
    counts = np.column_stack([words, chars - white, symbols, lines[:, 1], repeats])

    pair, many = np.unique(owner << 32 | ids, return_counts=True)
    of = pair >> 32
    top = np.zeros(m, np.int64)
    np.maximum.at(top, of, many)
    c, w, ln = np.maximum(chars, 1), np.maximum(words, 1), np.maximum(lines[:, 0], 1)
    stats = np.column_stack([
        np.log1p(words), np.log1p(chars), (chars - white) / w, symbols / c, lines[:, 1] / ln, repeats / w, kinds[:, 65:91].sum(1) / c, kinds[:, 48:58].sum(1) / c,
        kinds[:, _MARKS].sum(1) / c, white / c, kinds[:, 192:].sum(1) / c, np.bincount(of, minlength=m) / w, top / w,
        np.bincount(owner[size > 20], minlength=m) / w, np.bincount(owner[size == 1], minlength=m) / w, np.log1p(lines[:, 0]), kinds[:, 124] / w,
    ])
    return counts, stats


def _groups(texts: pd.Series) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else None
        if held and size + len(t or "") > _GROUP:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


@dataclass
class Trees:
    """All nodes of all trees: a leaf has feature 0, threshold infinity and itself as its left child."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: int = 0
    base: float = 0.0

    def scores(self, stats: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(stats), 0)
        row = np.arange(len(stats))[:, None]
        for _ in range(self.depth):
            at = np.where(stats[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(1), -30, 30)))


def grow(stats: np.ndarray, good: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, shrink: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees of ``good`` (0 or 1) on ``stats``; ``least`` is the sum of second derivatives that a child needs."""
    n, d = stats.shape
    if not n:
        return Trees()
    edges = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(d)]
    binned = np.column_stack([np.searchsorted(edges[f], stats[:, f], "left") for f in range(d)])
    sign = np.array([-1 if s in FALLING else 0 for s in STATS])
    mean = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    columns = np.arange(d) * BINS

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - good, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        at = np.full(n, roots[-1])
        open_ = {roots[-1]: (-np.inf, np.inf)}  # nodes of this level and the bounds of their values
        for level in range(depth + 1):
            further = {}
            for node, (low, high) in open_.items():
                rows = np.flatnonzero(at == node)
                g, h = grad[rows].sum(), hess[rows].sum()
                nodes[node][4] = rate * float(np.clip(-g / (h + shrink), low, high))
                if level == depth or h < 2 * least:
                    continue
                cell = (binned[rows] + columns).ravel()
                gl = np.bincount(cell, np.repeat(grad[rows], d), d * BINS).reshape(d, BINS).cumsum(1)[:, :-1]
                hl = np.bincount(cell, np.repeat(hess[rows], d), d * BINS).reshape(d, BINS).cumsum(1)[:, :-1]
                gr, hr = g - gl, h - hl
                vl, vr = (np.clip(-a / (b + shrink), low, high) for a, b in ((gl, hl), (gr, hr)))
                v = np.clip(-g / (h + shrink), low, high)
                # the loss that each side's value saves, at values within the bounds
                gain = sum(-(a * x + 0.5 * (b + shrink) * x * x) for a, b, x in ((gl, hl, vl), (gr, hr, vr))) + g * v + 0.5 * (h + shrink) * v * v
                gain[(hl < least) | (hr < least) | (sign[:, None] * (vr - vl) < 0)] = 0
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                kids = [len(nodes), len(nodes) + 1]
                nodes[node][:4] = [int(f), float(edges[f][b]), *kids]
                nodes.extend([0, np.inf, k, k, 0.0] for k in kids)
                at[rows] = np.where(binned[rows, f] <= b, *kids)
                middle = (vl[f, b] + vr[f, b]) / 2
                further[kids[0]] = (middle, high) if sign[f] < 0 else (low, high)
                further[kids[1]] = (low, middle) if sign[f] < 0 else (low, high)
            open_ = further
        raw += np.array([x[4] for x in nodes[roots[-1] :]])[at - roots[-1]]
    f, t, a, b, v = zip(*nodes, strict=True)
    return Trees(np.array(f, np.int32), np.array(t), np.array(a, np.int32), np.array(b, np.int32), np.array(v), np.array(roots, np.int32), depth, base)


def sample(docs: DataFrame, labels: DataFrame, rows: int = 20_000, seed: int = 12) -> DataFrame:
    """``stats`` and ``quality`` of about ``rows`` labelled documents, from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = known.where("quality = _most").select("doc_id", "quality")
    at_random = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0
    some = known.where(at_random < rows / max(1, known.count()))

    @F.pandas_udf("array<double>")
    @tidy
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([s for group in _groups(batch) for s in measure(group)[1]])

    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(compute("text").alias("stats"), "quality")


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, seed: int = 12) -> Trees:
    """Trees from a sample of about ``rows`` labelled documents; the sample's statistics come to the driver."""
    known = sample(docs, labels, rows, seed).orderBy("stats", "quality").toPandas()
    if not len(known):
        return Trees()
    return grow(np.stack(known["stats"]), known["quality"].to_numpy(float))


def judge(docs: DataFrame, model: Trees, cut_off: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS, ``rule_score``, ``base_failed`` and ``kept``: one map over whole texts with the model broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"{c} long" for c in COUNTS) + ", rule_score double"

    @F.pandas_udf(fields)
    @tidy
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [measure(group) for group in _groups(batch)]
            counts = np.concatenate([c for c, _ in parts]) if parts else np.zeros((0, len(COUNTS)), np.int64)
            scores = np.concatenate([shared.value.scores(s) for _, s in parts]) if parts else np.zeros(0)
            yield pd.DataFrame({**dict(zip(COUNTS, counts.T, strict=True)), "rule_score": scores})

    added = (*COUNTS, "rule_score", "base_failed", "kept")
    own = [c for c in docs.columns if c not in added]
    name = next(n for n in (f"_judged{i}" for i in range(len(own) + 1)) if n not in own)
    found = docs.select(*own, compute(F.col(text)).alias(name)).select(*own, f"{name}.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("rule_score") >= cut_off))
