"""Effects of several columns, given base models, fitted values and simulated tables.

As in ``stats``, sums of products are Spark aggregates; the small systems of each trait or
site are solved in numpy, inside tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.distributions import f_tail, log_gamma_udf
from locusframe.operators.relationship import _rounded
from locusframe.operators.stats import _solve, linear_model, normal_equations
from locusframe.plans import fixture as fx


def factor_effect(factor: Column, levels: list, restricted: bool = True) -> list[Column]:
    """Design columns of a factor. Restricted: one for each level but the last, which is -1 in all of them, so that
    coefficients sum to 0; else an indicator of each level. Null and levels not listed leave the row out."""
    known = factor.isin(list(levels))
    if not restricted:
        return [F.when(known, (factor == v).cast("double")) for v in levels]
    return [F.when(known, F.when(factor == v, 1.0).when(factor == levels[-1], -1.0).otherwise(0.0)) for v in levels[:-1]]


def nested_covariate(x: Column, factor: Column, levels: list) -> list[Column]:
    """A covariate with a slope of its own in each level."""
    return [F.when(factor.isin(list(levels)), F.when(factor == v, x.cast("double")).otherwise(F.when(x.isNotNull(), 0.0))) for v in levels]


def crossed(a: list[Column], b: list[Column]) -> list[Column]:
    """Products of the columns of two effects, the interaction."""
    return [x * y for x in a for y in b]


def effect_model(rows: DataFrame, by: list[str], y: str, effects: dict[str, list[Column]]) -> DataFrame:
    """One row for each group and effect, the mean first: freedom and sums of squares (incremental, marginal), F and p of
    the marginal test, coefficients by column (0 for a dependent one). F is null without error variance or freedom."""
    names = ["mean", *effects]
    eq = normal_equations(rows, by, y, [c for e in effects.values() for c in e])
    kinds = dict(eq.dtypes)
    groups, at = [[0]], 1
    for e in effects.values():
        groups.append(list(range(at, at + len(e))))
        at += len(e)

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                beta, seq, marg, sse, dfe = _solve(r.n, np.asarray(r.xx), np.asarray(r.xy), r.yy, groups)
                for i, name in enumerate(names):
                    tested = dfe > 0 and sse > 0 and marg[i][1] > 0
                    f = marg[i][0] / marg[i][1] / (sse / dfe) if tested else None
                    p = float(f_tail(f, marg[i][1], dfe)) if tested else None
                    out.append((*[getattr(r, c) for c in by], name, int(r.n), int(seq[i][1]), float(seq[i][0]), int(marg[i][1]), float(marg[i][0]), float(sse), int(dfe), f, p, [float(x) for x in beta[groups[i]]]))
            yield pd.DataFrame(out, columns=[*by, "term", "n", "df", "ss_incremental", "df_marginal", "ss_marginal", "ss_error", "df_error", "f", "p", "coefficients"])

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["term string, n long, df int, ss_incremental double, df_marginal int, ss_marginal double, ss_error double, df_error long, f double, p double, coefficients array<double>"])
    return eq.mapInPandas(solve, schema)


def fitted(rows: DataFrame, by: list[str], y: str, terms: dict[str, Column]) -> DataFrame:
    """``rows`` with ``predicted`` and ``residual`` of the model of their group; null where a term or y is missing.

    Groups are without null keys; the coefficients are one row for each group, joined to the rows by it.
    """
    b = linear_model(rows, by, y, terms).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("term", "coefficient"))).alias("_b"))
    value = F.col("_b")["mean"]
    for name, t in terms.items():
        value = value + F.col("_b")[name] * t
    return rows.join(b, by, "left").withColumn("predicted", value).withColumn("residual", F.col(y) - F.col("predicted")).drop("_b")


def association_given(calls: DataFrame, traits: DataFrame, allele: Column, base: list[Column], dominance: bool = False) -> DataFrame:
    """At every site the share of a trait's variance, left by a base model, that the marker explains.

    ``traits``: a row for each sample with ``y`` and the columns of ``base`` (covariates, ``factor_effect``). The marker is additive dosage,
    with ``dominance`` also an indicator of heterozygotes. Rows ``site, n, r2, df, df_error, f, p, additive, dominant``; r2, f and p are
    null for a marker that adds nothing to the base. One join and one aggregate of sums of products.
    """
    dose = (F.col("a1") == allele).cast("double") + (F.col("a2") == allele).cast("double")
    marker = [F.col("_x"), F.col("_d")] if dominance else [F.col("_x")]
    j = calls.select("taxon", "site", dose.alias("_x"), (F.col("a1") != F.col("a2")).cast("double").alias("_d")).join(traits, "taxon")
    eq = normal_equations(j, ["site"], "y", [*base, *marker])
    first = 1 + len(base)
    groups = [list(range(first)), list(range(first, first + len(marker)))]

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                beta, _, marg, sse, dfe = _solve(r.n, np.asarray(r.xx), np.asarray(r.xy), r.yy, groups)
                ss, df = marg[1]
                r2 = max(0.0, ss) / (ss + sse) if df > 0 and ss + sse > 0 else None
                tested = r2 is not None and dfe > 0 and r2 < 1 - 1e-12
                f = r2 / df / ((1 - r2) / dfe) if tested else None
                out.append((r.site, int(r.n), r2, int(df), int(dfe), f, float(f_tail(f, df, dfe)) if tested else None, float(beta[first]), float(beta[first + 1]) if dominance else None))
            yield pd.DataFrame(out, columns=["site", "n", "r2", "df", "df_error", "f", "p", "additive", "dominant"])

    return eq.mapInPandas(solve, f"site {dict(eq.dtypes)['site']}, n long, r2 double, df int, df_error long, f double, p double, additive double, dominant double")


def critical_r2(alpha: float, df: int, df_error: int) -> float:
    """The r2 that a marker needs for p = alpha."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        f = mid / df / ((1 - mid) / df_error) if mid < 1 else math.inf
        low, high = (mid, high) if float(f_tail(f, df, df_error)) > alpha else (low, mid)
    return (low + high) / 2


def ln_probability(rows: DataFrame, r: str, c: str, by: list[str] | None = None) -> DataFrame:
    """Logarithm of the probability of each group's table of two columns, its margins given."""
    by = by or []
    cells = rows.groupBy(*by, r, c).agg(F.count("*").alias("n"))
    part = lambda keys, sign: cells.groupBy(*by, *keys).agg(F.sum("n").alias("n")).select(*by, F.lit(sign).alias("s"), "n")
    every = part([r], 1).unionByName(part([c], 1)).unionByName(part([], -1)).unionByName(part([r, c], -1)).where("n IS NOT NULL")
    return every.withColumn("g", log_gamma_udf()(F.col("n") + 1.0)).groupBy(*by).agg(F.sum(F.col("s") * F.col("g")).alias("ln_p"))


def contingency_simulated(rows: DataFrame, r: str, c: str, reps: int = 10_000, seed: int = 1, most: int = 10_000) -> DataFrame:
    """Monte Carlo p of the chi-square of a table of two columns: the share of ``reps`` tables with the same margins, drawn at random,
    that reach its chi-square (the table itself counts as one).

    The table is aggregated first; only its margins leave Spark, ``most`` levels of a column at most (more raise). Each draw has a
    generator of its own, so that the result doesn't depend on the partitions. An empty table gives a null p.
    """
    spark = rows.sparkSession
    cells = rows.where(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(r, c).agg(F.count("*").alias("n"))
    side = lambda k: np.array([x["n"] for x in cells.groupBy(k).agg(F.sum("n").alias("n")).orderBy(k).limit(most + 1).collect()], dtype=np.int64)
    up, across = side(r), side(c)
    if max(len(up), len(across)) > most:
        raise ValueError(f"a column has over {most} levels")
    total = int(up.sum())
    if not total:
        return spark.createDataFrame([(None, 0, reps)], "p double, n long, reps int")
    e = F.col("rn") * F.col("cn") / total
    q = cells.join(cells.groupBy(r).agg(F.sum("n").alias("rn")), r).join(cells.groupBy(c).agg(F.sum("n").alias("cn")), c)
    observed = q.agg((F.sum((F.col("n") - e) * (F.col("n") - e) / e) + total - F.sum(e)).alias("x")).first()["x"]
    expected = np.outer(up, across) / total

    def draw(batches):
        for b in batches:
            hits = 0
            for k in b["id"]:
                rng, left, table = np.random.default_rng([seed, int(k)]), across.copy(), np.zeros((len(up), len(across)))
                for i, m in enumerate(up[:-1]):
                    table[i] = rng.multivariate_hypergeometric(left, m, method="marginals")
                    left = left - table[i].astype(np.int64)
                table[-1] = left
                hits += ((table - expected) ** 2 / expected).sum() >= observed * (1 - 1e-9)
            yield pd.DataFrame({"hits": [int(hits)]})

    return spark.range(reps).mapInPandas(draw, "hits long").agg(((F.sum("hits") + 1) / (reps + 1)).alias("p")).select("p", F.lit(total).cast("long").alias("n"), F.lit(reps).alias("reps"))


def _pieces(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 3).alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def _m02(s: SparkSession, d: str) -> DataFrame:
    m = effect_model(_pieces(s, d), ["l_returnflag"], "y", {"x": [F.col("x")], "k": factor_effect(F.col("k"), [0, 1, 2])})
    return m.where("term = 'k'").select("l_returnflag", "n", F.col("df_marginal").cast("long").alias("df"), "df_error", F.round("ss_error", 2).alias("ss_error"), F.round("f", 3).alias("f"))


def _fitted(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return fitted(o, ["l_returnflag"], "y", {"x": F.col("x")}).select("l_orderkey", "l_linenumber", F.round("predicted", 4).alias("predicted"), F.round("residual", 4).alias("residual"))


def _m06(s: SparkSession, d: str) -> DataFrame:
    t = fx.phenotypes(s, d).groupBy("taxon").agg((F.avg("y") / 1000).alias("y"), (F.max("y") / 1000).alias("z"))
    a = association_given(fx.calls(s, d), t, F.col("site") % 4, [F.col("z")])
    return _rounded(a.where("r2 IS NOT NULL AND n > 4").select("site", "n", "r2", "f"), "r2").withColumn("f", F.round("f", 4))


QUERIES = {
    "m01_fitted": _fitted,
    "m02_factor_effect": _m02,
    "m06_association_given": _m06,
    "m15_ln_probability": lambda s, d: ln_probability(fx.table(s, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("ln_p", 5).alias("ln_p")),
    "m15_contingency_simulated": lambda s, d: contingency_simulated(fx.table(s, d, "orders"), "o_orderstatus", "o_orderpriority", 2000),
}

_LG = "lgamma(CAST(n + 1 AS DOUBLE))"
ORACLES = {
    "m01_fitted": """WITH l AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), b AS (SELECT l_returnflag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(a + b * x, 4) AS predicted, round(y - (a + b * x), 4) AS residual FROM l JOIN b ON l.l_returnflag = b.l_returnflag""",
    "m02_factor_effect": """WITH l AS (SELECT l_returnflag, l_linenumber % 3 AS k, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
c AS (SELECT l_returnflag, count(*) AS n, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS sse FROM l GROUP BY 1),
w AS (SELECT l_returnflag, k, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy, regr_sxx(y, x) AS xx FROM l GROUP BY 1, 2),
e AS (SELECT l_returnflag, sum(yy) - sum(xy) * sum(xy) / sum(xx) AS sse FROM w GROUP BY 1)
SELECT c.l_returnflag, n, CAST(2 AS BIGINT) AS df, n - 4 AS df_error, round(e.sse, 2) AS ss_error, round((c.sse - e.sse) / 2 / (e.sse / (n - 4)), 3) AS f FROM c JOIN e ON c.l_returnflag = e.l_returnflag""",
    "m06_association_given": f"""WITH {fx.CALLS}, {fx.PHENO}, tr AS (SELECT taxon, avg(y) / 1000 AS y, max(y) / 1000 AS z FROM pheno GROUP BY 1),
x AS (SELECT site, (CASE WHEN a1 = site % 4 THEN 1.0 ELSE 0.0 END) + (CASE WHEN a2 = site % 4 THEN 1.0 ELSE 0.0 END) AS x, y, z FROM calls JOIN tr ON calls.taxon = tr.taxon WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
r AS (SELECT site, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM x GROUP BY 1 HAVING count(*) > 4 AND var_pop(x) > 1e-9),
q AS (SELECT site, n, pow(xy - xz * yz, 2) / ((1 - xz * xz) * (1 - yz * yz)) AS r2 FROM r)
SELECT site, n, round(r2, 6) AS r2, round(r2 * (n - 3) / (1 - r2), 4) AS f FROM q""",
    "m15_ln_probability": f"""WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT round((SELECT sum({_LG}) FROM (SELECT sum(n) AS n FROM c GROUP BY r)) + (SELECT sum({_LG}) FROM (SELECT sum(n) AS n FROM c GROUP BY k)) - (SELECT sum({_LG}) FROM (SELECT sum(n) AS n FROM c)) - (SELECT sum({_LG}) FROM c), 5) AS ln_p""",
}
