"""Mixed model for any number of samples (M08): restricted likelihood from a block tridiagonal form of the kinship matrix.

The matrix stays in tiles of about ``tile`` samples squared. Block Lanczos steps turn it into Q' K Q = T with blocks of
``width``: the first block of Q spans the fixed effects and the trait, every new block is kept orthogonal to all earlier
ones, and a block that the matrix adds nothing to goes on from random directions, so T has all of K's size and the
result is exact up to rounding. Each step is a tiled product and a few sums over row blocks; the driver sees blocks of T, of
``width`` squared, and coefficients of a block over all samples (width numbers a sample), never the matrix.

For a ratio delta the likelihood, its slope and the fixed effects follow from one backward pass over T's blocks, since the
trait and the effects lie in Q's first block. Ratios are searched as in ``mixed.restricted_fit``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators.mixed import _traits
from locusframe.operators.relationship import _rounded, kinship
from locusframe.plans import fixture as fx
from locusframe.plans.tables import keep_table

_TALL = "b int, m binary"


def _bytes(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype=float).tobytes()


def _shaped(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, columns)


def _summed(rows: DataFrame, key: str) -> DataFrame:
    """Sums of equally shaped arrays ``m`` by ``key``, in part before they move."""
    kind = dict(rows.dtypes)[key]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for k, m in zip(batch[key], batch["m"], strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(m)
        if held:
            yield pd.DataFrame({key: list(held), "m": [_bytes(m) for m in held.values()]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [part[key].iloc[0]], "m": [_bytes(sum(np.frombuffer(m) for m in part["m"]))]})

    return rows.select(key, "m").mapInPandas(partial, f"{key} {kind}, m binary").groupBy(key).applyInPandas(whole, f"{key} {kind}, m binary")


@dataclass
class Tridiagonal:
    """Blocks of T = Q' K Q: ``a[k]`` on the diagonal, ``b[k]`` = Q_{k+1}' K Q_k below it; the first block's coefficients ``r`` of [X, y]."""

    a: list[np.ndarray] = field(default_factory=list)
    b: list[np.ndarray] = field(default_factory=list)
    r: np.ndarray | None = None
    q: list[DataFrame] = field(default_factory=list)

    def at(self, delta: float) -> dict | None:
        """Inverse of the first block's part of (T + delta I)^-1, log determinant, and both slopes in delta; null where T + delta I is not positive."""
        s, ds, log_det, slope, solved = None, None, 0.0, 0.0, []
        for k in range(len(self.a) - 1, -1, -1):
            eye = np.eye(len(self.a[k]))
            if s is None:
                now, dnow = self.a[k] + delta * eye, eye
            else:
                x = np.linalg.solve(s, self.b[k])
                now, dnow = self.a[k] + delta * eye - self.b[k].T @ x, eye + x.T @ ds @ x
                solved.append(x)
            try:
                low = np.linalg.cholesky((now + now.T) / 2)
            except np.linalg.LinAlgError:
                return None
            s, ds = now, dnow
            log_det += 2 * np.log(np.diag(low)).sum()
            slope += np.trace(np.linalg.solve(s, ds))
        first = np.linalg.inv(s)
        return {"m": first, "dm": -first @ ds @ first, "log_det": log_det, "slope": slope, "solved": solved[::-1]}

    def coefficients(self, delta: float, start: np.ndarray) -> list[np.ndarray]:
        """The blocks of (T + delta I)^-1 times a vector that has only the first block ``start``."""
        found = self.at(delta)
        out = [found["m"] @ start]
        for x in found["solved"]:
            out.append(-x @ out[-1])
        return out


class _Blocks:
    """The observations in row blocks, the matrix in tiles, and what block Lanczos needs of both."""

    def __init__(self, kin: DataFrame, obs: DataFrame, tile: int) -> None:
        self.spark = obs.sparkSession
        self.n = obs.count()
        groups = max(1, -(-self.n // tile))
        placed = obs.withColumn("b", F.pmod(F.xxhash64("o"), F.lit(groups)).cast("int"))
        placed = placed.withColumn("r", (F.row_number().over(Window.partitionBy("b").orderBy("o")) - 1).cast("int"))  # a block of about ``tile``
        self.obs = keep_table(placed)
        size = self.obs.groupBy("b").agg(F.count("*").cast("int").alias("size"))
        at = self.obs.select("taxon", "b", "r").join(size, "b")
        both = kin.where("value IS NOT NULL").select("i", "j", F.col("value").cast("double").alias("value"))
        both = both.unionByName(both.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
        cells = both.join(at.select(F.col("taxon").alias("i"), F.col("b").alias("x"), F.col("r").alias("rx"), F.col("size").alias("sx")), "i")
        cells = cells.join(at.select(F.col("taxon").alias("j"), F.col("b").alias("y"), F.col("r").alias("ry"), F.col("size").alias("sy")), "j")

        def dense(p: pd.DataFrame) -> pd.DataFrame:
            m = np.zeros((p["sx"].iloc[0], p["sy"].iloc[0]))
            m[p["rx"].to_numpy(), p["ry"].to_numpy()] = p["value"].to_numpy()
            return pd.DataFrame({"x": [p["x"].iloc[0]], "y": [p["y"].iloc[0]], "m": [_bytes(m)]})

        self.tiles = keep_table(cells.select("x", "y", "rx", "ry", "sx", "sy", "value").groupBy("x", "y").applyInPandas(dense, "x int, y int, m binary"))

    def columns(self, names: list[str], width: int, seed: int) -> DataFrame:
        """Row blocks of a mean column, ``names`` and random columns up to ``width``."""

        def build(p: pd.DataFrame) -> pd.DataFrame:
            p, b = p.sort_values("r"), int(p["b"].iloc[0])
            own = np.column_stack([np.ones(len(p)), *(p[c].to_numpy(float) for c in names)])
            extra = np.random.default_rng([seed, b]).normal(size=(len(p), width - own.shape[1]))
            return pd.DataFrame({"b": [b], "m": [_bytes(np.hstack([own, extra]))]})

        return keep_table(self.obs.select("b", "r", *names).groupBy("b").applyInPandas(build, _TALL))

    def mapped(self, tall: DataFrame, width: int, change) -> DataFrame:
        """``change`` of every row block."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield pd.DataFrame({"b": p["b"], "m": [_bytes(change(_shaped(m, width), b)) for b, m in zip(p["b"], p["m"], strict=True)]})

        return keep_table(tall.mapInPandas(run, _TALL))

    def gram(self, tall: DataFrame, width: int) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                parts = [_shaped(m, width) for m in p["m"]]
                if parts:
                    yield pd.DataFrame({"k": [0], "m": [_bytes(sum(x.T @ x for x in parts))]})

        return _shaped(_summed(tall.mapInPandas(run, "k int, m binary"), "k").first()["m"], width)

    def inner(self, q: list[DataFrame], widths: list[int], tall: DataFrame, width: int) -> list[np.ndarray]:
        """Q_k' W of all blocks k."""
        every = self._stack(q).withColumnRenamed("m", "q").join(tall, "b")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield pd.DataFrame({"k": p["k"], "m": [_bytes(_shaped(x, widths[k]).T @ _shaped(w, width)) for k, x, w in zip(p["k"], p["q"], p["m"], strict=True)]})

        found = {r["k"]: _shaped(r["m"], width) for r in _summed(every.mapInPandas(run, "k int, m binary"), "k").collect()}
        return [found[k] for k in range(len(q))]

    def _stack(self, q: list[DataFrame]) -> DataFrame:
        parts = [x.select("b", F.lit(k).alias("k"), "m") for k, x in enumerate(q)]
        while len(parts) > 1:
            parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + (parts[-1:] if len(parts) % 2 else [])
        return parts[0]

    def less(self, q: list[DataFrame], widths: list[int], tall: DataFrame, width: int) -> tuple[DataFrame, list[np.ndarray]]:
        """W - Q Q' W, and Q' W."""
        c = self.inner(q, widths, tall, width)
        shared = self.spark.sparkContext.broadcast(c)
        rows = self._stack(q).withColumnRenamed("m", "q")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield pd.DataFrame({"b": p["b"], "m": [_bytes(-_shaped(x, widths[k]) @ shared.value[k]) for k, x in zip(p["k"], p["q"], strict=True)]})

        return keep_table(_summed(rows.mapInPandas(run, _TALL).unionByName(tall), "b")), c

    def product(self, tall: DataFrame, width: int) -> DataFrame:
        """K W."""
        joined = self.tiles.select("x", F.col("y").alias("b"), F.col("m").alias("t")).join(tall, "b")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                out = []
                for t, m in zip(p["t"], p["m"], strict=True):
                    v = _shaped(m, width)
                    out.append(_bytes(_shaped(t, len(v)) @ v))
                yield pd.DataFrame({"b": p["x"], "m": out})

        zero = self.mapped(tall, width, lambda m, b: np.zeros_like(m))
        return keep_table(_summed(joined.mapInPandas(run, _TALL).unionByName(zero), "b"))

    def orthonormal(self, q: list[DataFrame], widths: list[int], tall: DataFrame, width: int, keep: int, seed: int, scale: float) -> DataFrame:
        """``keep`` orthonormal columns, orthogonal to all of ``q``: those of W first (of at least 1e-9 of the root of ``scale``), random ones for what W lacks."""
        found, sizes = [], []
        while sum(sizes) < keep:  # directions of W by falling size: sums of squares tell those apart that differ by 1e5 at most
            value, vector = np.linalg.eigh(self.gram(tall, width))
            floor = max(1e-18 * scale, 1e-300)
            order = np.flatnonzero(value > max(floor, 1e-10 * value.max()))[::-1][: keep - sum(sizes)]
            if not len(order):
                break
            turn = vector[:, order] / np.sqrt(value[order])
            found.append(self._settled([*q, *found], [*widths, *sizes], self.mapped(tall, width, lambda m, b, turn=turn: m @ turn), len(order)))
            sizes.append(len(order))
            if len(order) < width and sum(sizes) < keep:
                tall, _ = self.less(found, sizes, tall, width)
        lack = keep - sum(sizes)
        if lack:
            extra = self.mapped(tall, width, lambda m, b: np.random.default_rng([seed, b]).normal(size=(len(m), lack)))
            found.append(self._settled([*q, *found], [*widths, *sizes], extra, lack))
            sizes.append(lack)
        if len(found) == 1:
            return found[0]
        every = self._stack(found)

        def beside(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("k")
            return pd.DataFrame({"b": [int(p["b"].iloc[0])], "m": [_bytes(np.hstack([_shaped(m, sizes[k]) for k, m in zip(p["k"], p["m"], strict=True)]))]})

        return keep_table(every.groupBy("b").applyInPandas(beside, _TALL))

    def _settled(self, q: list[DataFrame], widths: list[int], now: DataFrame, width: int) -> DataFrame:
        """Columns made orthogonal to all of ``q`` and orthonormal, twice, so that rounding of the first time goes."""
        for _ in range(2):
            if q:
                now, _ = self.less(q, widths, now, width)
            low = np.linalg.inv(np.linalg.cholesky(self.gram(now, width)))
            now = self.mapped(now, width, lambda m, b, low=low: m @ low.T)
        return now


def tridiagonal(kin: DataFrame, obs: DataFrame, names: list[str], width: int = 64, tile: int = 512, seed: int = 3) -> tuple[Tridiagonal, _Blocks]:
    """T of the matrix ``i, j, value`` (i >= j; absent cells are 0) over the observations ``o, taxon`` and ``names``; ``names`` ends with the trait."""
    blocks, t = _Blocks(kin, obs, tile), Tridiagonal()
    n = blocks.n
    width = min(n, max(width, len(names) + 1))
    tall, widths, w = blocks.columns(names, width, seed), [], width
    scale = float(np.trace(blocks.gram(tall, w)))
    while sum(widths) < n:
        keep = min(width, n - sum(widths))
        fresh = blocks.orthonormal(t.q, widths, tall, w, keep, seed + 1 + len(widths), scale)
        if not widths:
            t.r = blocks.inner([fresh], [keep], tall, w)[0][:, : len(names) + 1]
        else:
            t.b.append(blocks.inner([fresh], [keep], raw, w)[0])
        t.q.append(fresh)
        widths.append(keep)
        w = keep
        raw = blocks.product(fresh, w)
        t.a.append(blocks.inner([fresh], [w], raw, w)[0])
        scale = max(scale if len(widths) > 1 else 0.0, float(np.trace(blocks.gram(raw, w))))
        if sum(widths) < n:
            tall, _ = blocks.less(t.q, widths, raw, w)
    t.a = [(a + a.T) / 2 for a in t.a]
    return t, blocks


def fit(t: Tridiagonal, n: int, low: float = 1e-5, high: float = 1e5, regions: int = 100) -> dict:
    """The model of the highest restricted likelihood, by slopes on a grid of log(delta) and bisection, as ``mixed.restricted_fit``."""
    x, y = t.r[:, :-1], t.r[:, -1]
    value, vector = np.linalg.eigh(x.T @ x)
    basis = vector[:, value > 1e-10 * value.max()]  # fixed effects without a combination that is 0
    xb = x @ basis
    left = n - basis.shape[1]
    flat = y - xb @ np.linalg.lstsq(xb, y, rcond=None)[0]
    if left < 2 or flat @ flat <= 1e-20 * max(1.0, float(y @ y)):
        return {"delta": None}
    plain = np.linalg.slogdet(xb.T @ xb)[1]

    def state(log_d: float) -> dict | None:
        found = t.at(np.exp(log_d))
        if found is None:
            return None
        xx, xy, yy = xb.T @ found["m"] @ xb, xb.T @ found["m"] @ y, float(y @ found["m"] @ y)
        beta = np.linalg.solve(xx, xy)
        e = xb @ beta - y
        rest = yy - float(xy @ beta)
        fall = -float(e @ found["dm"] @ e)
        log_det = found["log_det"] + np.linalg.slogdet(xx)[1] - plain
        slope = left * fall / rest - found["slope"] - np.trace(np.linalg.solve(xx, xb.T @ found["dm"] @ xb))
        return {"lnl": 0.5 * (left * (np.log(left / (2 * np.pi)) - 1 - np.log(rest)) - log_det), "slope": slope, "beta": basis @ beta, "genetic": rest / left}

    grid = [(g, s) for g in np.linspace(np.log(low), np.log(high), regions + 1) if (s := state(g))]
    if not grid:
        return {"delta": None}
    best = [grid[0], grid[-1]]
    for (a, sa), (b, sb) in zip(grid, grid[1:], strict=False):
        if sa["slope"] > 0 >= sb["slope"]:
            for _ in range(50):
                mid = (a + b) / 2
                now = state(mid)
                a, b = (mid, b) if now and now["slope"] > 0 else (a, mid)
            if middle := state((a + b) / 2):
                best.append(((a + b) / 2, middle))
    at, found = max(best, key=lambda g: g[1]["lnl"])
    delta = float(np.exp(at))
    return {"delta": delta, "genetic": found["genetic"], "residual": found["genetic"] * delta, "lnl": float(found["lnl"]), "beta": found["beta"]}


@dataclass
class MixedModel:
    """A fitted model: ``n, delta, genetic, residual, share, lnl, effects`` (mean first); ``delta`` is null without variance or freedom."""

    kin: DataFrame
    form: Tridiagonal
    blocks: _Blocks
    n: int
    found: dict

    def row(self) -> tuple:
        f = self.found
        return (self.n, *([None] * 6 if f["delta"] is None else [f["delta"], f["genetic"], f["residual"], 1 / (1 + f["delta"]), f["lnl"], [float(b) for b in f["beta"]]]))

    def genetic_values(self) -> DataFrame:
        """``taxon, blup`` of every sample of the matrix, observed or not."""
        f, t = self.found, self.form
        if f["delta"] is None:
            raise ValueError("the trait has no variance or too few samples")
        c = t.coefficients(f["delta"], t.r[:, -1] - t.r[:, :-1] @ f["beta"])
        widths = [len(a) for a in t.a]
        shared = self.blocks.spark.sparkContext.broadcast(c)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield pd.DataFrame({"b": p["b"], "m": [_bytes(_shaped(m, widths[k]) @ shared.value[k]) for k, m in zip(p["k"], p["m"], strict=True)]})

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                for b, m in zip(p["b"], p["m"], strict=True):
                    z = np.frombuffer(m)
                    yield pd.DataFrame({"b": b, "r": np.arange(len(z), dtype=np.int32), "z": z})

        z = _summed(self.blocks._stack(t.q).mapInPandas(run, _TALL), "b").mapInPandas(spread, "b int, r int, z double")
        z = keep_table(self.blocks.obs.select("taxon", "b", "r").join(z, ["b", "r"]).groupBy("taxon").agg(F.sum("z").alias("z")))
        m = self.kin.select("i", "j", F.col("value").cast("double").alias("value"))
        both = m.unionByName(m.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
        some = both.join(z.withColumnRenamed("taxon", "j"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("z")).alias("blup"))
        every = both.select("i").distinct()
        return every.join(some, "i", "left").select(F.col("i").alias("taxon"), F.coalesce("blup", F.lit(0.0)).alias("blup"))


def mixed_model(kin: DataFrame, trait: DataFrame, base: list[str] | None = None, width: int = 64, tile: int = 512) -> MixedModel:
    """The mixed model of one trait (``taxon, y``, base columns) for any number of samples of ``kin`` (``i, j, value``, i >= j).

    Rows with a null or a sample that the matrix lacks are left out; a repeated sample is two observations of one sample.
    """
    names = [*(base or []), "y"]
    known = kin.select(F.col("i").alias("taxon")).unionByName(kin.select(F.col("j").alias("taxon"))).distinct()
    good = trait.select("taxon", *[F.col(c).cast("double").alias(c) for c in names]).na.drop().join(known, "taxon", "left_semi")
    obs = keep_table(good.withColumn("o", F.monotonically_increasing_id()))
    n = obs.count()
    if n < 3:
        return MixedModel(kin, Tridiagonal(), None, n, {"delta": None})
    form, blocks = tridiagonal(kin, obs, names, width, tile)
    return MixedModel(kin, form, blocks, n, fit(form, n))


def _fitted(s: SparkSession, d: str, name: str, width: int) -> MixedModel:
    return mixed_model(keep_table(kinship(fx.calls(s, d))), _traits(s, d).where(F.col("trait") == name), width=width, tile=16)


def _components(s: SparkSession, d: str) -> DataFrame:
    rows = [("mean", *_fitted(s, d, "mean", 24).row())]
    out = s.createDataFrame(rows, "trait string, n long, delta double, genetic double, residual double, share double, lnl double, effects array<double>")
    return _rounded(out.drop("effects"), "share")


def _residuals(s: SparkSession, d: str) -> DataFrame:
    """How far the genetic values u are from K (e - u) = delta u, with e the trait around the fitted mean, and the sum of e - u from 0."""
    m = _fitted(s, d, "mean", 24)
    delta, mean = m.found["delta"], float(m.found["beta"][0])
    y = _traits(s, d).where("trait = 'mean'").select("taxon", (F.col("y") - mean).alias("e"))
    u = keep_table(m.genetic_values())
    rest = y.join(u, "taxon").select("taxon", (F.col("e") - F.col("blup")).alias("z"))
    k = m.kin.select("i", "j", "value").unionByName(m.kin.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    kz = k.join(rest.withColumnRenamed("taxon", "j"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("z")).alias("kz"))
    gap = u.join(kz, u["taxon"] == kz["i"]).select("taxon", (F.abs(F.col("kz") - delta * F.col("blup")) < 1e-6 * (1 + delta)).alias("solved"))
    balance = rest.agg((F.abs(F.sum("z")) < 1e-6 * (1 + delta)).alias("balanced"))
    return gap.crossJoin(F.broadcast(balance)).select("taxon", "solved", "balanced")  # one row


QUERIES = {"m08_blocked_components": _components, "m08_blocked_solution": _residuals}
ORACLES = {
    "m08_blocked_solution": f"WITH {fx.CALLS} SELECT DISTINCT taxon, true AS solved, true AS balanced FROM calls WHERE taxon IN (SELECT c_custkey % 40 FROM customer)",
}
