"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased; every character that is not a letter counts as a space,
runs of spaces as one. Its subwords are the runs of 2, 3 and 4 characters, with
the spaces at word edges. Each subword's hash names one of ``buckets`` embedding
rows; the average of a text's rows goes through a linear softmax. Both layers are
trained by stochastic gradient descent in numpy, on a sample of labelled rows of
at most about ``per_lang`` rows of each language (whole texts, and short windows of
the same texts so that short texts are learned too). A temperature fitted on a
tenth of the sample calibrates the scores, and the score below which
``reject_share`` of its windows fall is the rejection threshold.

For scoring, embeddings and weights are multiplied once into a table of one logit
row for each bucket; the average of those rows is the same model.

A null text or one without a letter gets ``und`` with score 0. Null labels are not
learned from. Without any labelled row every text gets ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import tidy

UND = "und"
ORDERS = (2, 3, 4)
_CHUNK = 1 << 20  # characters worked on at once

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subword_ids(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids of all subwords of ``texts`` (one row for each order), the number of positions of each text, and whether it has a letter."""
    coded = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    flat = np.concatenate(coded)
    letter = _letter_table()[flat]
    owner = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space of a run
    keep[np.concatenate(([0], np.cumsum([len(c) for c in coded])[:-1]))] = True
    code = np.where(letter, flat, np.uint32(32))[keep].astype(np.uint64)
    owner, letter = owner[keep], letter[keep]
    count = np.bincount(owner, minlength=len(coded))
    some = np.bincount(owner, weights=letter, minlength=len(coded)) > 0
    ids = np.empty((len(ORDERS), len(code)), np.int32)
    h = code * np.uint64(0x9E3779B97F4A7C15)
    for i in range(1, max(ORDERS)):
        following = np.concatenate((code[i:], np.full(min(i, len(code)), 32, np.uint64)))
        h = (h ^ following) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        if i + 1 in ORDERS:
            ids[ORDERS.index(i + 1)] = (h >> np.uint64(20)) % np.uint64(buckets)
    return ids, count, some


@dataclass(frozen=True)
class LangModel:
    """``table``: one row of logits for each bucket; ``langs``: the classes, sorted."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Class and calibrated probability of each text."""
        lang, score = [UND] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        full = [i for i, t in enumerate(texts) if t]
        at = 0
        while at < len(full):
            size, stop = 0, at
            while stop < len(full) and (stop == at or size + len(texts[full[stop]]) <= _CHUNK):
                size += len(texts[full[stop]])
                stop += 1
            part = full[at:stop]
            ids, count, some = subword_ids([texts[i] for i in part], len(self.table))
            logits = np.zeros((len(part), len(self.langs)))
            starts = np.concatenate(([0], np.cumsum(count)[:-1]))
            for row in ids:
                logits += np.add.reduceat(self.table[row], starts, axis=0, dtype=np.float64)
            logits = (logits / (len(ORDERS) * count[:, None]) + self.bias) / self.temperature
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for j, i in enumerate(part):
                if some[j]:
                    k = int(p[j].argmax())
                    lang[i], score[i] = self.langs[k], p[j, k]
            at = stop
        return lang, score


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 4, rate: float = 8.0, reject_share: float = 0.005, seed: int = 5) -> LangModel:
    """Fit on (language, bucket ids, counts) rows by stochastic gradient descent."""
    langs = tuple(sorted({r[0] for r in rows}))
    if not langs:
        return LangModel((), np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets, dim))
    weight, bias = rng.normal(0, 0.3, (dim, len(langs))), np.zeros(len(langs))
    index = {x: i for i, x in enumerate(langs)}
    data = [(index[lang], ids, n / n.sum()) for lang, ids, n in rows if n.sum()]
    rng.shuffle(data)
    held, fit = data[: len(data) // 10], data[len(data) // 10 :]
    step, steps = 0, epochs * max(1, len(fit))
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, ids, n = fit[i]
            lr = rate * (1 - step / steps)
            step += 1
            v = n @ emb[ids]
            z = v @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            emb[ids] -= lr * n[:, None] * (weight @ p)
            weight -= 0.1 * lr * np.outer(v, p)
            bias -= 0.01 * lr * p
    table = (emb @ weight).astype(np.float32)
    temperature, threshold = 1.0, 0.0
    if held:
        z = np.array([n @ table[ids] + bias for _, ids, n in held])
        y = np.array([h[0] for h in held])
        loss = []
        grid = np.geomspace(0.25, 4, 33)
        for t in grid:
            q = z / t - (z / t).max(1, keepdims=True)
            loss.append(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]))
        temperature = float(grid[int(np.argmin(loss))])
        q = np.exp(z / temperature - (z / temperature).max(1, keepdims=True))
        threshold = float(np.quantile((q / q.sum(1, keepdims=True)).max(1), reject_share))
    return LangModel(langs, table, bias, temperature, threshold)


def fit(docs: DataFrame, per_lang: int = 400, windows: int = 3, buckets: int = 1 << 16, seed: int = 5, **training: float) -> LangModel:
    """Fit a model from columns ``doc_id, text, lang`` of labelled rows.

    Of a language with n rows each row is taken with probability per_lang / n, by
    a hash of its id. Executors turn the taken texts into bucket counts (at most
    ``buckets`` a text), so what reaches the driver is bounded.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], buckets)
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, per_lang / n).otherwise(share)
    at_random = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0
    taken = labelled.where(at_random < share).select("lang", "text")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = text.split()
                cuts = [text]
                for _ in range(windows if len(words) > 4 else 0):
                    n = int(rng.integers(2, 24))
                    a = int(rng.integers(0, max(1, len(words) - n)))
                    cuts.append(" ".join(words[a : a + n]))
                for piece in cuts:
                    ids, _, some = subword_ids([piece], buckets)
                    if some[0]:
                        u, n = np.unique(ids, return_counts=True)
                        out.append((lang, u.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "ids", "n"])

    rows = taken.mapInPandas(featurise, "lang string, ids binary, n binary").collect()
    rows = sorted((r["lang"], bytes(r["ids"]), bytes(r["n"])) for r in rows)
    return train([(a, np.frombuffer(b, np.int32), np.frombuffer(c, np.int32).astype(float)) for a, b, c in rows], buckets, seed=seed, **training)


def identify(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rejected`` (score below the calibrated threshold, or ``und``).

    A map over rows with the model as a broadcast table of buckets x languages.
    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    @tidy
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = shared.value.predict([t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"lang": lang, "score": score})

    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    return docs.select(*kept, predict(F.col(text)).alias("_lang")).select(
        *kept,
        F.col("_lang.lang").alias("lang_pred"),
        F.col("_lang.score").alias("lang_score"),
        ((F.col("_lang.score") < model.reject_below) | (F.col("_lang.lang") == UND)).alias("lang_rejected"),
    )
