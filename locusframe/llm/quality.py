"""Quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a vector of statistics (lengths, shares of character classes,
repetition of words, word runs and lines). Random Fourier features approximate a
Gaussian kernel over the standardised statistics. Every partition sums its own
part of the normal equations, apart for each of ``folds`` folds; the sums over
partitions give the ridge weights, and those without one fold score its rows. Isotonic
regression of label on these held-out scores, over a fixed grid of score bins, turns
scores into probabilities.

Rows to learn from are a sample of labelled rows, about ``rows`` at most, by a hash of the
id; their labels are broadcast to the documents, so no text is shuffled, and only
sums (features squared, bins) reach the driver. Scoring is one map over all rows.
Null and empty texts have the statistics of an empty text and get a score like any other;
equal texts get equal scores. Without labels every score is 0.5. A column named
``quality_score`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import tidy

STATS = (
    "log_chars", "log_words", "word_mean", "word_sd", "upper", "digit", "space", "stop", "mark", "pipe", "other",
    "distinct", "top_word", "repeat_next", "repeat_pair", "log_lines", "repeat_line", "end_mark", "long_word", "one_char",
)


def _classes() -> np.ndarray:
    """Class of each byte: 0 letter or part of one, 1 upper, 2 digit, 3 white space, 4 sentence mark, 5 symbol, 6 bar, 7 other."""
    kind = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:?'\"-()" else 5 if c in "!$%&*#@^~_+=<>/\\" else 6 if c == "|" else 7
    return kind


_KIND = _classes()


def text_stats(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATS."""
    if not text:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    share = np.bincount(_KIND[raw], minlength=8) / n
    words = text.split()
    w = len(words)
    if not w:
        return [np.log1p(n)] + [0.0] * 5 + [share[3]] + [0.0] * (len(STATS) - 7)
    length = np.fromiter(map(len, words), np.int64, w)
    count = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) if w > 1 else 0
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    ends = sum(x[-1] in "!$%&*#@" for x in words)
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(length.mean()), float(length.std()), share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        len(count) / w, max(count.values()) / w, same / max(1, w - 1), 1 - pairs / max(1, w - 1), float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), ends / w, float((length > 20).mean()), float((length == 1).mean()),
    ]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array ``stats`` in place of its text (and of a column of that name)."""

    @F.pandas_udf("array<double>")
    @tidy
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_stats(t if isinstance(t, str) else None) for t in batch])

    return docs.select(*[c for c in docs.columns if c not in (text, "stats")], compute(F.col(text)).alias("stats"))


@dataclass
class QualityModel:
    mean: np.ndarray
    sd: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    low: float = 0.0
    step: float = 1.0
    levels: np.ndarray | None = None  # calibrated probability of each score bin

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -8, 8)
        return np.hstack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def bins(self, ridge: np.ndarray) -> np.ndarray:
        return (ridge - self.low) / self.step

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        at = np.clip(self.bins(self.ridge(stats)), 0, len(self.levels) - 1)
        return np.interp(at, np.arange(len(self.levels)), self.levels)


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators; bins without rows take their neighbours' levels."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([float(good[i]), float(total[i]), i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, t, _, b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + t, blocks[-1][2], b]
    # a pinch of both labels keeps levels off 0 and 1
    at = [x for g, t, a, b in blocks for x in ((a, (g + 0.5) / (t + 1)), (b, (g + 0.5) / (t + 1)))]
    level = np.interp(np.arange(len(total)), [a for a, _ in at], [v for _, v in at])
    return np.maximum.accumulate(level)


def sample(docs: DataFrame, labels: DataFrame, rows: int = 20_000, seed: int = 11) -> DataFrame:
    """``stats`` and ``quality`` of about ``rows`` labelled documents at most, from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality: 0 or 1)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    at_random = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0
    some = known.where(at_random < rows / max(1, known.count()))
    return statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).select("doc_id", "stats", "quality")


def solve(gram: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from the sums of squares of features and label (last); the last feature, a one, is not shrunk."""
    a, b, n = gram[:-1, :-1], gram[:-1, -1], gram[-2, -2]
    penal = np.full(len(a), ridge * max(n, 1.0))
    penal[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penal), b)


def fit(labelled: DataFrame, features: int = 192, ridge: float = 1e-5, bins: int = 512, width: float = 10.0, folds: int = 4, seed: int = 11) -> QualityModel:
    """Fit from ``doc_id, stats, quality`` (0 or 1; other rows are left out), over all rows given."""
    rows = labelled.where(F.col("quality").isin(0, 1)).select("stats", "quality", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(folds)).cast("int").alias("fold"))
    d = len(STATS)
    parts = [F.count("*").alias("n")]
    parts += [f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = rows.agg(*parts).first()
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features)
    if not r["n"]:
        return QualityModel(np.zeros(d), np.ones(d), omega, phase)
    model = QualityModel(np.array([r[f"m{i}"] for i in range(d)]), np.maximum(1e-6, np.array([r[f"s{i}"] for i in range(d)])), omega, phase)
    size = features + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, size, size))
        for batch in batches:
            for k, part in batch.groupby("fold"):
                x = np.hstack([model.features(np.stack(part["stats"])), part["quality"].to_numpy(float)[:, None]])
                total[k] += x.T @ x
        i, j = np.triu_indices(size)
        for k in range(folds):
            if total[k].any():
                yield pd.DataFrame({"fold": k, "i": i, "j": j, "v": total[k][i, j]})

    gram = np.zeros((folds, size, size))
    for c in rows.mapInPandas(sums, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect():
        gram[c["fold"], c["i"], c["j"]] = gram[c["fold"], c["j"], c["i"]] = c["v"]
    model.weights = solve(gram.sum(0), ridge)
    others = [solve(gram.sum(0) - g, ridge) if (gram.sum(0) - g)[-2, -2] > 0 else model.weights for g in gram]
    model.low, model.step = -0.5, 2.0 / (bins - 1)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby("fold"):
                at = np.clip(np.rint(model.bins(model.features(np.stack(part["stats"])) @ others[k])), 0, bins - 1).astype(int)
                yield pd.DataFrame({"bin": at, "quality": part["quality"].to_numpy()})

    total, good = np.zeros(bins), np.zeros(bins)
    for c in rows.mapInPandas(binned, "bin int, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("g")).collect():
        total[c["bin"]], good[c["bin"]] = c["n"], c["g"]
    model.levels = isotonic(total, good)
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, from 0 to 1: one map over whole texts with the model broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            stats = np.array([text_stats(t if isinstance(t, str) else None) for t in batch]).reshape(-1, len(STATS))
            yield pd.Series(shared.value.scores(stats))

    return docs.select(*[c for c in docs.columns if c != "quality_score"], predict(F.col(text)).alias("quality_score"))
