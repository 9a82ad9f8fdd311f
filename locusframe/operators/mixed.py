"""Mixed models by restricted likelihood (M08): variance components, predictions and marker tests under a kinship matrix.

A sample matrix of up to ``most`` samples (more raise) is held as one array, 8 n^2 bytes, by each task that needs it: traits
and sites, which have no bound, are what Spark partitions. ``stats.variance_components`` serves any number of samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.distributions import f_tail
from locusframe.operators.relationship import _rounded, kinship
from locusframe.plans import fixture as fx


def matrix_of(m: DataFrame, most: int = 3000) -> tuple[list, np.ndarray]:
    """Sorted names and the dense array of a symmetric matrix ``i, j, value`` (i >= j); absent and null cells are 0."""
    names = sorted(r[0] for r in m.select("i").unionByName(m.select(F.col("j").alias("i"))).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"the matrix has over {most} samples")
    cells = m.where("value IS NOT NULL").select("i", "j", F.col("value").cast("double").alias("value")).toPandas()
    at = {t: k for k, t in enumerate(names)}
    x, y = cells["i"].map(at).to_numpy(dtype=np.int64), cells["j"].map(at).to_numpy(dtype=np.int64)
    out = np.zeros((len(names), len(names)))
    out[x, y] = out[y, x] = cells["value"].to_numpy()
    return names, out


def restricted_fit(y: np.ndarray, x: np.ndarray, k: np.ndarray, low: float = 1e-5, high: float = 1e5, regions: int = 100) -> dict:
    """Ratio ``delta`` of residual to genetic variance at the highest restricted likelihood, and the model it gives.

    The likelihood needs only the eigenvalues of ``k`` in the space that the fixed effects ``x`` leave. Its slope is evaluated on a
    grid of log(delta); every fall through zero is bisected, and the best of these points and the two ends wins. Ratios at which
    a variance would be negative are left out.
    """
    n = len(y)
    u, s, _ = np.linalg.svd(x, full_matrices=True)
    rank = int((s > 1e-10 * s[0]).sum()) if len(s) else 0
    free, left = u[:, rank:], n - rank
    if left < 2:
        return {"delta": None}
    lam, vec = np.linalg.eigh(free.T @ k @ free)
    e2 = (vec.T @ (free.T @ y)) ** 2
    if e2.sum() <= 1e-20 * max(1.0, float(y @ y)):
        return {"delta": None}

    def likelihood(log_d: float) -> float:
        v = lam + np.exp(log_d)
        return 0.5 * (left * (np.log(left / (2 * np.pi)) - 1 - np.log((e2 / v).sum())) - np.log(v).sum())

    def slope(log_d: float) -> float:
        v = lam + np.exp(log_d)
        return left * (e2 / v**2).sum() / (e2 / v).sum() - (1 / v).sum()

    grid = [g for g in np.linspace(np.log(low), np.log(high), regions + 1) if lam[0] + np.exp(g) > 1e-9]
    if not grid:
        return {"delta": None}
    slopes, best = [slope(g) for g in grid], [grid[0], grid[-1]]
    for a, b, sa, sb in zip(grid, grid[1:], slopes, slopes[1:], strict=False):
        if sa > 0 >= sb:
            for _ in range(50):
                mid = (a + b) / 2
                a, b = (mid, b) if slope(mid) > 0 else (a, mid)
            best.append((a + b) / 2)
    at = max(best, key=likelihood)
    delta = float(np.exp(at))
    genetic = float((e2 / (lam + delta)).sum() / left)
    hx = np.linalg.solve(k + delta * np.eye(n), np.column_stack([x, y]))
    normal = np.linalg.pinv(x.T @ hx[:, :-1])
    beta = normal @ (hx[:, :-1].T @ y)
    return {"delta": delta, "genetic": genetic, "residual": genetic * delta, "lnl": float(likelihood(at)), "beta": beta, "normal": normal, "weighted": hx[:, :-1], "scaled": hx[:, -1] - hx[:, :-1] @ beta}


def _rows(part: pd.DataFrame, at: dict, base: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the matrix, fixed effects and values of the samples with all of them."""
    place = part["taxon"].map(at)
    values = part[["y", *base]].to_numpy(dtype=float)
    good = place.notna().to_numpy() & np.isfinite(values).all(1)
    return place[good].to_numpy(dtype=np.int64), np.column_stack([np.ones(int(good.sum())), values[good, 1:]]), values[good, 0]


def mixed_model(kin: DataFrame, traits: DataFrame, base: list[str] | None = None, most: int = 3000) -> DataFrame:
    """One row for each trait of ``traits(trait, taxon, y, base columns)``: n, ``delta`` (residual over genetic variance), both
    variances, their genetic share, the restricted log-likelihood, and the fixed effects (mean first).

    Rows with a null or a sample that the matrix lacks are left out; a repeated sample is two observations of one sample. A trait
    without variance or freedom has null results.
    """
    base, (names, k) = base or [], matrix_of(kin, most)
    at = {t: i for i, t in enumerate(names)}
    kind = dict(traits.dtypes)["trait"]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        places, x, y = _rows(part, at, base)
        f = restricted_fit(y, x, k[np.ix_(places, places)]) if len(y) > 2 else {"delta": None}
        if f["delta"] is None:
            row = (part["trait"].iloc[0], len(y), None, None, None, None, None, None)
        else:
            row = (part["trait"].iloc[0], len(y), f["delta"], f["genetic"], f["residual"], 1 / (1 + f["delta"]), f["lnl"], [float(b) for b in f["beta"]])
        return pd.DataFrame([row], columns=["trait", "n", "delta", "genetic", "residual", "share", "lnl", "effects"])

    return traits.select("trait", "taxon", "y", *base).groupBy("trait").applyInPandas(fit, f"trait {kind}, n long, delta double, genetic double, residual double, share double, lnl double, effects array<double>")


def predictions(kin: DataFrame, traits: DataFrame, base: list[str] | None = None, most: int = 3000) -> DataFrame:
    """For each trait and sample of the matrix, observed or not: the genetic value (``blup``), the variance of its error
    (``pev``) and, with no base columns, the mean plus the genetic value (``predicted``; null with base columns)."""
    base, (names, k) = base or [], matrix_of(kin, most)
    at = {t: i for i, t in enumerate(names)}
    kinds = dict(traits.dtypes)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        columns = ["trait", "taxon", "blup", "pev", "predicted"]
        places, x, y = _rows(part, at, base)
        f = restricted_fit(y, x, k[np.ix_(places, places)]) if len(y) > 2 else {"delta": None}
        if f["delta"] is None:
            return pd.DataFrame({"trait": part["trait"].iloc[0], "taxon": names, "blup": None, "pev": None, "predicted": None})[columns]
        cov = k[:, places]
        u = cov @ f["scaled"]
        inside = np.linalg.solve(k[np.ix_(places, places)] + f["delta"] * np.eye(len(y)), cov.T)
        edge = cov @ f["weighted"]
        pev = f["genetic"] * (np.diag(k) - np.einsum("ij,ji->i", cov, inside) + np.einsum("ij,jk,ik->i", edge, f["normal"], edge))
        return pd.DataFrame({"trait": part["trait"].iloc[0], "taxon": names, "blup": u, "pev": pev, "predicted": None if base else u + f["beta"][0]})[columns]

    return traits.select("trait", "taxon", "y", *base).groupBy("trait").applyInPandas(fit, f"trait {kinds['trait']}, taxon {kinds['taxon']}, blup double, pev double, predicted double")


def mixed_association(calls: DataFrame, kin: DataFrame, traits: DataFrame, allele: Column, base: list[str] | None = None, dominance: bool = False, most: int = 3000) -> DataFrame:
    """F test of each site in the mixed model of one trait (``taxon, y``, base columns; a row for each sample), the ratio of variances fixed at that of the model without markers.

    Values and dosages are whitened by the Cholesky factor of K + delta I, then tested by least squares. An unknown dosage is
    the site's mean over the samples at hand. Rows ``site, n`` (samples with a known call), ``df, df_error, f, p``; f and p are
    null for a marker that adds nothing. Sites are independent rows: one aggregate gathers the cells of a site (at most ``most``).
    """
    base, (names, k) = base or [], matrix_of(kin, most)
    at = {t: i for i, t in enumerate(names)}
    part = traits.select("taxon", "y", *base).limit(most + 1).toPandas()
    if len(part) > most:
        raise ValueError(f"there are over {most} samples")
    places, x, y = _rows(part, at, base)
    f0 = restricted_fit(y, x, k[np.ix_(places, places)]) if len(y) > 2 else {"delta": None}
    if f0["delta"] is None:
        raise ValueError("the trait has no variance or too few samples")
    white = np.linalg.inv(np.linalg.cholesky(k[np.ix_(places, places)] + f0["delta"] * np.eye(len(y))))
    q, s, _ = np.linalg.svd(white @ x, full_matrices=False)
    q = q[:, s > 1e-10 * s[0]]
    r = white @ y
    r = r - q @ (q.T @ r)
    n, total = len(y), float(r @ r)
    spark = calls.sparkSession
    order = spark.createDataFrame([(names[p], i) for i, p in enumerate(places)], f"taxon {dict(calls.dtypes)['taxon']}, k int")
    dose = (F.col("a1") == allele).cast("double") + (F.col("a2") == allele).cast("double")
    cells = calls.select("taxon", "site", dose.alias("x"), (F.col("a1") != F.col("a2")).cast("double").alias("h")).where("x IS NOT NULL")
    grouped = cells.join(F.broadcast(order), "taxon").groupBy("site").agg(F.collect_list("k").alias("k"), F.collect_list("x").alias("x"), F.collect_list("h").alias("h"))

    def test(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                columns = []
                for values in (row.x, row.h) if dominance else (row.x,):
                    z = np.full(n, np.mean(values))
                    z[np.asarray(row.k)] = values
                    columns.append(white @ z)
                left, ss, df = r, 0.0, 0
                kept: list[np.ndarray] = []
                for z in columns:
                    size = float(z @ z)
                    z = z - q @ (q.T @ z)
                    for w in kept:
                        z = z - w * (w @ z)
                    norm = float(z @ z)
                    if norm > 1e-9 * size:
                        kept.append(z / np.sqrt(norm))
                        ss += float((kept[-1] @ left) ** 2)
                        df += 1
                dfe = n - q.shape[1] - df
                sse = total - ss
                tested = df > 0 and dfe > 0 and sse > 1e-12 * total
                f = ss / df / (sse / dfe) if tested else None
                out.append((row.site, len(row.k), df, dfe, f, float(f_tail(f, df, dfe)) if tested else None))
            yield pd.DataFrame(out, columns=["site", "n", "df", "df_error", "f", "p"])

    return grouped.mapInPandas(test, f"site {dict(calls.dtypes)['site']}, n long, df int, df_error long, f double, p double")


def _traits(s: SparkSession, d: str) -> DataFrame:
    p = fx.phenotypes(s, d).groupBy("taxon").agg((F.avg("y") / 1000).alias("mean"), (F.max("y") / 1000).alias("most"))
    return p.unpivot("taxon", ["mean", "most"], "trait", "y")


def _one(s: SparkSession, d: str) -> DataFrame:
    return _traits(s, d).where("trait = 'mean'").drop("trait")


QUERIES = {
    "m08_mixed_model": lambda s, d: mixed_model(kinship(fx.calls(s, d)), _traits(s, d)).drop("effects"),
    "m08_predictions": lambda s, d: _rounded(predictions(kinship(fx.calls(s, d)), _traits(s, d)), "blup", "pev", "predicted"),
    "m08_mixed_association": lambda s, d: _rounded(mixed_association(fx.calls(s, d), kinship(fx.calls(s, d)), _one(s, d), F.col("site") % 4), "f", "p"),
}
ORACLES: dict[str, str] = {}  # the likelihood has no SQL form; tests hold it against dense formulas
