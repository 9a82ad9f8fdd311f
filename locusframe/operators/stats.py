"""Linear models, association and tests.

Sums of squares and cross products are Spark aggregates; only small systems of
equations (terms of a model, for each trait or site) are solved in numpy, inside tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.distributions import chi2_tail_even, exponential_cdf, f_tail, f_tail_udf, normal_pdf, pareto_cdf
from locusframe.operators.relationship import _CEN, _kin, _rounded, kinship
from locusframe.plans import fixture as fx


def normal_equations(rows: DataFrame, by: list[str], y: str, terms: list[Column]) -> DataFrame:
    """Of each group: n, the upper triangle of X'X (``xx``), X'y (``xy``), y'y; X has a first column of ones."""
    x = [F.lit(1.0), *terms]
    full = rows.where(F.col(y).isNotNull())
    for t in terms:
        full = full.where(t.isNotNull())
    xx = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return full.groupBy(*by).agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*[F.sum(t * F.col(y)) for t in x]).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))


def _solve(n: float, xx: np.ndarray, xy: np.ndarray, yy: float, groups: list[list[int]], tol: float = 1e-9) -> tuple:
    """Coefficients, incremental and marginal sums of squares with their freedom, residual sum and freedom.

    ``groups`` are the columns of each effect in order; dependent columns are left out."""
    k = sum(map(len, groups))
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = xx
    a = a + np.triu(a, 1).T

    def fit(parts: list[list[int]]) -> tuple[np.ndarray, float, int]:
        kept: list[int] = []
        for c in (c for part in parts for c in part):
            trial = kept + [c]
            s = a[np.ix_(trial, trial)]
            if s[-1, -1] > 0 and (len(trial) == 1 or s[-1, -1] - s[-1, :-1] @ np.linalg.solve(s[:-1, :-1], s[:-1, -1]) > tol * s[-1, -1]):
                kept = trial
        b = np.zeros(k)
        if kept:
            b[kept] = np.linalg.solve(a[np.ix_(kept, kept)], xy[kept])
        return b, float(b @ xy), len(kept)

    beta, ss, rank = fit(groups)
    steps = [(None, 0.0, 0), *[fit(groups[: i + 1]) for i in range(len(groups))]]
    seq = [(after[1] - before[1], after[2] - before[2]) for before, after in zip(steps, steps[1:], strict=False)]
    without = [fit(groups[:i] + groups[i + 1 :]) for i in range(len(groups))]
    marg = [(ss - w[1], rank - w[2]) for w in without]
    return beta, seq, marg, max(0.0, yy - ss), n - rank


def linear_model(rows: DataFrame, by: list[str], y: str, terms: dict[str, Column]) -> DataFrame:
    """One row for each group and term: coefficient, incremental and marginal sums of squares, F and p of the marginal test."""
    names = ["mean", *terms]
    eq = normal_equations(rows, by, y, list(terms.values()))
    kinds = dict(eq.dtypes)

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                beta, seq, marg, sse, dfe = _solve(r.n, np.asarray(r.xx), np.asarray(r.xy), r.yy, [[i] for i in range(len(names))])
                mse = sse / dfe if dfe > 0 else math.nan
                for i, name in enumerate(names):
                    f = marg[i][0] / mse if mse and mse > 0 else math.nan
                    out.append((*[getattr(r, c) for c in by], name, int(r.n), float(beta[i]), float(seq[i][0]), int(seq[i][1]), float(marg[i][0]), float(sse), int(dfe), float(f), float(f_tail(f, 1, dfe)) if f == f and dfe > 0 else math.nan))
            yield pd.DataFrame(out, columns=[*by, "term", "n", "coefficient", "ss_incremental", "df", "ss_marginal", "ss_error", "df_error", "f", "p"])

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["term string, n long, coefficient double, ss_incremental double, df int, ss_marginal double, ss_error double, df_error long, f double, p double"])
    return eq.mapInPandas(solve, schema)


def association(calls: DataFrame, traits: DataFrame, allele: Column, with_p: bool = True) -> DataFrame:
    """Squared correlation of additive dosage with the trait at every site (mean-only base model), F and p; F of a perfect fit is null.

    ``traits(taxon, y)`` with one value for each sample. One join and one aggregate with partial sums.
    """
    dose = (F.col("a1") == allele).cast("double") + (F.col("a2") == allele).cast("double")
    j = calls.join(traits, "taxon").select("site", dose.alias("x"), "y").where("x IS NOT NULL AND y IS NOT NULL")
    r = j.groupBy("site").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    r = r.where("n > 2").select("site", "n", F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")).alias("r2"), F.try_divide("c", "vx").alias("effect"))
    r = r.where("r2 IS NOT NULL AND NOT isnan(r2)").withColumn("f", F.when(F.col("r2") < 1 - 1e-12, F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2"))))
    return r.withColumn("p", f_tail_udf()(F.col("f"), F.lit(1), F.col("n") - 2)) if with_p else r


def nested_model(calls: DataFrame, observations: DataFrame) -> DataFrame:
    """Sums of squares of genotype and of samples within genotype at each site, from replicated observations (``taxon, y``).

    Observations shrink to (n, sum, sum of squares) of each sample before they meet the calls, so the join has one row for
    each cell. A site with one genotype has no test of it.
    """
    per = observations.where("y IS NOT NULL").groupBy("taxon").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    cells = calls.where("a1 IS NOT NULL AND a2 IS NOT NULL").join(per, "taxon").select("site", F.least("a1", "a2").alias("x"), F.greatest("a1", "a2").alias("y"), "n", "s", "q")
    g = cells.groupBy("site", "x", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("t"), F.count("*").alias("k"))
    t = g.groupBy("site").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("t").alias("t"), F.sum("k").alias("taxa"), F.count("*").alias("levels"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m"),
    )
    t = t.select(
        "site", (F.col("m") - F.col("s") * F.col("s") / F.col("n")).alias("ss_marker"), (F.col("levels") - 1).alias("df_marker"), (F.col("t") - F.col("m")).alias("ss_taxa"),
        (F.col("taxa") - F.col("levels")).alias("df_taxa"), (F.col("q") - F.col("t")).alias("ss_error"), (F.col("n") - F.col("taxa")).alias("df_error"),
    )
    return t.withColumn("f_marker", F.try_divide(F.col("ss_marker") * F.col("df_taxa"), F.col("ss_taxa") * F.col("df_marker")))


def variance_components(kin: DataFrame, traits: DataFrame) -> DataFrame:
    """M08, by moments: genetic and residual variance of a trait under a kinship matrix (``i, j, value``, i >= j).

    Products of centred trait values of different samples are regressed on their kinship; the slope is the genetic
    variance. One join each way and one aggregate, for any number of samples; no likelihood is maximised.
    """
    y = traits.where("y IS NOT NULL")
    c = y.crossJoin(F.broadcast(y.agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")))).select("taxon", (F.col("y") - F.col("m")).alias("e"), "v")  # one row of moments
    pairs = kin.where("i > j").join(c.select(F.col("taxon").alias("i"), F.col("e").alias("ei"), "v"), "i").join(c.select(F.col("taxon").alias("j"), F.col("e").alias("ej")), "j")
    p = F.col("ei") * F.col("ej")
    r = pairs.agg(F.count("*").alias("pairs"), F.try_divide(F.covar_pop("value", p), F.var_pop("value")).alias("genetic"), F.max("v").alias("total"))
    return r.select("pairs", "genetic", (F.col("total") - F.col("genetic")).alias("residual"), F.try_divide("genetic", "total").alias("share"))


def stepwise(calls: DataFrame, traits: DataFrame, allele: Column, enter: float = 1e-3, leave: float = 1e-3, steps: int | None = None) -> list[dict]:
    """Forward steps over all sites, with backward checks, until no site enters (or for ``steps`` steps, where given). A step is one pass: every
    site's partial F given the chosen ones. It also ends where a set of sites comes back.

    The chosen sites' dosages (one number for each sample and chosen site) are joined to the calls as columns.
    """
    dose = (F.col("a1") == allele).cast("double") + (F.col("a2") == allele).cast("double")
    x = calls.select("taxon", "site", dose.alias("x")).where("x IS NOT NULL")
    chosen: list[int] = []
    report: list[dict] = []
    seen: set[frozenset] = set()
    while steps is None or len([r for r in report if r["action"] == "add"]) < steps:
        if frozenset(chosen) in seen:
            break
        seen.add(frozenset(chosen))
        base = traits
        for s in chosen:
            base = base.join(x.where(F.col("site") == s).select("taxon", F.col("x").alias(f"m{s}")), "taxon")
        terms = {f"m{s}": F.col(f"m{s}") for s in chosen}
        table = linear_model(x.where(~F.col("site").isin(chosen)).join(base, "taxon") if chosen else x.join(base, "taxon"), ["site"], "y", {**terms, "x": F.col("x")})
        best = table.where("term = 'x' AND NOT isnan(p) AND df > 0").orderBy("p", "site").limit(1).collect()
        if not best or best[0]["p"] > enter:
            break
        chosen.append(best[0]["site"])
        report.append({"action": "add", "site": best[0]["site"], "f": best[0]["f"], "p": best[0]["p"]})
        if len(chosen) > 1:
            now = traits
            for s in chosen:
                now = now.join(x.where(F.col("site") == s).select("taxon", F.col("x").alias(f"m{s}")), "taxon")
            worst = linear_model(now.withColumn("g", F.lit(0)), ["g"], "y", {f"m{s}": F.col(f"m{s}") for s in chosen}).where("term <> 'mean'").orderBy(F.desc("p")).limit(1).collect()[0]
            if worst["p"] > leave:
                out = int(worst["term"][1:])
                chosen.remove(out)
                report.append({"action": "remove", "site": out, "f": worst["f"], "p": worst["p"]})
                if out == best[0]["site"]:
                    break
    return report


def stepwise_table(calls: DataFrame, traits: DataFrame, allele: Column, enter: float = 1e-3, leave: float = 1e-3, steps: int | None = None) -> DataFrame:
    """The analysis of variance of the model that ``stepwise`` ends with: ``term, ss, df, ms, f, p, rsq``.

    A row for each site in the order that they entered, with the sum of squares that it adds to those before it, then ``error`` and ``total``, over
    the samples with a value and calls at all sites of the model. A site that adds nothing has no degree of freedom.
    """
    chosen: list = []
    for r in stepwise(calls, traits, allele, enter, leave, steps):
        chosen = [*chosen, r["site"]] if r["action"] == "add" else [c for c in chosen if c != r["site"]]
    dose = (F.col("a1") == allele).cast("double") + (F.col("a2") == allele).cast("double")
    x = calls.select("taxon", "site", dose.alias("x")).where("x IS NOT NULL")
    rows = traits.select("taxon", F.col("y").cast("double").alias("y")).where("y IS NOT NULL")
    for s in chosen:
        rows = rows.join(x.where(F.col("site") == s).select("taxon", F.col("x").alias(f"m{s}")), "taxon")
    names = ["_one", *[f"m{s}" for s in chosen], "y"]
    rows = rows.withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    # sums of products around the means, so that large values don't cancel: a number for each pair of terms
    mean = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    around = {c: F.col(c) - (mean[c] or 0.0) if c != "_one" else F.col(c) for c in names}
    sums = rows.agg(*[F.sum(around[names[i]] * around[names[j]]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(names), len(names)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    n, total = int(gram[0, 0]), float(gram[-1, -1])
    left, out = gram[1:, 1:].copy(), []
    for k, s in enumerate(chosen):  # each term is swept out of those after it and of the trait
        size = left[k, k]
        added = 0.0
        if size > 1e-9 * gram[k + 1, k + 1]:
            added = left[k, -1] ** 2 / size
            left[k + 1 :, k + 1 :] -= np.outer(left[k + 1 :, k], left[k, k + 1 :]) / size
        out.append((str(s), float(added), int(size > 1e-9 * gram[k + 1, k + 1])))
    error, df_error = max(0.0, float(left[-1, -1])), n - 1 - sum(r[2] for r in out)
    table = []
    for term, ss, df in out:
        f = ss / (error / df_error) if df and df_error > 0 and error > 0 else None
        table.append((term, ss, df, ss if df else None, f, float(f_tail(f, df, df_error)) if f is not None else None, ss / total if total else None))
    table.append(("error", error, df_error, error / df_error if df_error > 0 else None, None, None, None))
    table.append(("total", total, n - 1, None, None, None, None))
    return calls.sparkSession.createDataFrame(table, "term string, ss double, df long, ms double, f double, p double, rsq double")


def fisher_exact(counts: DataFrame, by: list[str]) -> DataFrame:
    """Of each 2 x 2 table (``a, b, c, d``): its probability, left, right and two-tailed p."""

    @F.pandas_udf("point double, left double, right double, two double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        lf = lambda n: math.lgamma(n + 1)
        out = []
        for w, x, y, z in zip(a, b, c, d, strict=True):
            r1, r2, c1, n = w + x, y + z, w + y, w + x + y + z
            fixed = lf(r1) + lf(r2) + lf(c1) + lf(n - c1) - lf(n)
            k = range(max(0, c1 - r2), min(r1, c1) + 1)
            p = np.array([math.exp(fixed - lf(i) - lf(r1 - i) - lf(c1 - i) - lf(r2 - c1 + i)) for i in k])
            at = w - k[0]
            out.append((p[at], p[: at + 1].sum(), p[at:].sum(), min(1.0, p[p <= p[at] * (1 + 1e-7)].sum())))
        return pd.DataFrame(out, columns=["point", "left", "right", "two"])

    return counts.select(*by, "a", "b", "c", "d", test("a", "b", "c", "d").alias("t")).select(*by, "a", "b", "c", "d", "t.*")


def contingency(rows: DataFrame, r: str, c: str, by: list[str] | None = None) -> DataFrame:
    """Chi-square of independence of two columns, with its degrees of freedom, of each group."""
    by = by or []
    cells = rows.groupBy(*by, r, c).agg(F.count("*").alias("n"))
    g = lambda *k: Window.partitionBy(*by, *k)
    e = F.sum("n").over(g(r)) * F.sum("n").over(g(c)) / F.sum("n").over(g())
    q = cells.withColumn("e", e)
    # cells that never occur add their expectation: the expectations of a table sum to its n
    t = q.groupBy(*by).agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("seen"), (F.sum("n") - F.sum("e")).alias("unseen"), ((F.countDistinct(r) - 1) * (F.countDistinct(c) - 1)).alias("df"), F.sum("n").alias("n"))
    return t.select(*by, (F.col("seen") + F.col("unseen")).alias("chi2"), "df", "n")


def goodness_of_fit(counts: DataFrame, by: list[str], n: str, share: str) -> DataFrame:
    """Chi-square of counts against expected shares; ``low`` flags an expectation below five."""
    w = Window.partitionBy(*by)
    e = counts.withColumn("e", F.sum(n).over(w) * F.col(share) / F.sum(share).over(w))
    return e.groupBy(*by).agg(F.sum((F.col(n) - F.col("e")) * (F.col(n) - F.col("e")) / F.col("e")).alias("chi2"), (F.count("*") - 1).alias("df"), (F.min("e") < 5).alias("low"))


def likelihood_ratio(lnl0: Column, lnl1: Column) -> Column:
    """Twice the gain of log-likelihood."""
    return 2 * (lnl1 - lnl0)


def aic(lnl: Column, k: Column) -> Column:
    return lnl - k


def aicc(lnl: Column, k: Column, n: Column) -> Column:
    return lnl - k - k * (k + 1) / (n - k - 1)


def bic(lnl: Column, k: Column, n: Column) -> Column:
    return lnl - k / 2 * F.log(n)


def _traits(s: SparkSession, d: str) -> DataFrame:
    return fx.phenotypes(s, d).groupBy("taxon").agg(F.avg("y").alias("y"))


def _m01(s, d):
    o = fx.table(s, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    m = linear_model(o, ["g"], "y", {"x": F.col("x")}).groupBy("g").pivot("term", ["mean", "x"]).agg(F.first("coefficient").alias("b"), F.first("ss_error").alias("e"), F.first("n").alias("n"))
    return m.select("g", F.round("mean_b", 3).alias("intercept"), F.round("x_b", 4).alias("slope"), F.col("x_n").alias("n"), F.round(F.col("x_e") / F.col("x_n"), 0).alias("mean_error"))


def _counts(s, d):
    o = fx.table(s, d, "orders").select((F.col("o_custkey") % 25).alias("g"), (F.col("o_orderstatus") == "F").alias("f"), (F.col("o_totalprice") > 150000).alias("h"))
    return o.groupBy("g").agg(*[F.sum((cond).cast("long")).alias(k) for k, cond in (("a", F.col("f") & F.col("h")), ("b", F.col("f") & ~F.col("h")), ("c", ~F.col("f") & F.col("h")), ("d", ~F.col("f") & ~F.col("h")))])


def _m16(s, d):
    n = fx.table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return goodness_of_fit(n.withColumn("share", F.lit(0.2)), ["o_orderstatus"], "n", "share")


def _m17(s, d):
    t = fx.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.var_pop("l_quantity").alias("v"))
    ll = -F.col("n") / 2 * (F.log(2 * math.pi * F.col("v")) + 1)
    k = F.lit(2.0)
    return t.select("l_returnflag", F.round(ll, 4).alias("lnl"), F.round(aic(ll, k), 4).alias("aic"), F.round(aicc(ll, k, F.col("n")), 4).alias("aicc"), F.round(bic(ll, k, F.col("n")), 4).alias("bic"))


def _m18(s, d):
    from locusframe.operators.orders import permute

    p = permute(fx.table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_custkey", 5, ["c_mktsegment"])
    return p.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.countDistinct("c_custkey").alias("keys"))


def _x20(s, d):
    x = fx.table(s, d, "lineitem").select((F.col("l_quantity") / 5).alias("x")).distinct()
    c = F.col("x")
    return x.select("x", F.round(normal_pdf(c, 5, 2), 8).alias("normal"), F.round(exponential_cdf(c, 0.5), 8).alias("expo"), F.round(pareto_cdf(c, 2.0, 1.0), 8).alias("pareto"), F.round(chi2_tail_even(c, 6), 8).alias("chi2"))


QUERIES = {
    "m01_linear_model": _m01,
    "m06_association": lambda s, d: _rounded(association(fx.calls(s, d), _traits(s, d), F.col("site") % 4, with_p=False), "r2", "f").withColumn("effect", F.round("effect", 4)),
    "m05_nested_model": lambda s, d: _rounded(nested_model(fx.calls(s, d), fx.phenotypes(s, d).select("taxon", "y")), "f_marker").withColumns({c: F.round(F.col(c) / 1e6, 4) for c in ("ss_marker", "ss_taxa", "ss_error")}),
    "m07_association_p": lambda s, d: association(fx.calls(s, d), _traits(s, d), F.col("site") % 4).select("site", F.round("p", 5).alias("p")),
    "m08_variance_components": lambda s, d: variance_components(kinship(fx.calls(s, d)), _traits(s, d)).select("pairs", F.round("share", 6).alias("share"), F.round(F.col("genetic") / 1e6, 5).alias("genetic"), F.round(F.col("residual") / 1e6, 5).alias("residual")),
    "m14_fisher_exact": lambda s, d: _rounded(fisher_exact(_counts(s, d), ["g"]), "point", "left", "right", "two"),
    "m15_contingency": lambda s, d: _rounded(contingency(fx.table(s, d, "orders"), "o_orderstatus", "o_orderpriority"), "chi2"),
    "m16_goodness_of_fit": lambda s, d: _rounded(_m16(s, d), "chi2"),
    "m17_information_criteria": _m17,
    "m18_permutation": _m18,
    "x20_distributions": _x20,
}

_TR = f"{fx.PHENO}, tr AS (SELECT taxon, avg(y) AS y FROM pheno GROUP BY taxon)"
_AS = """x AS (SELECT site, (CASE WHEN a1 = site % 4 THEN 1.0 ELSE 0.0 END) + (CASE WHEN a2 = site % 4 THEN 1.0 ELSE 0.0 END) AS x, y FROM calls JOIN tr ON calls.taxon = tr.taxon WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
r AS (SELECT site, count(*) AS n, corr(x, y) * corr(x, y) AS r2, regr_slope(y, x) AS effect FROM x GROUP BY site HAVING count(*) > 2)"""
_LF = "lgamma(CAST({} + 1 AS DOUBLE))"
ORACLES = {
    "m01_linear_model": "SELECT l_returnflag AS g, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n, round((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / count(*), 0) AS mean_error FROM lineitem GROUP BY 1",
    "m06_association": f"WITH {fx.CALLS}, {_TR}, {_AS} SELECT site, n, round(r2, 6) AS r2, round(effect, 4) AS effect, CASE WHEN r2 < 1 - 1e-12 THEN round(r2 * (n - 2) / (1 - r2), 6) END AS f FROM r WHERE r2 IS NOT NULL AND NOT isnan(r2)",
    "m05_nested_model": f"""WITH {fx.CALLS}, {fx.PHENO}, o AS (SELECT site, least(a1, a2) * 10 + greatest(a1, a2) AS g, calls.taxon, y FROM calls JOIN pheno ON calls.taxon = pheno.taxon WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
w AS (SELECT *, avg(y) OVER (PARTITION BY site) AS ms, avg(y) OVER (PARTITION BY site, g) AS mg, avg(y) OVER (PARTITION BY site, taxon) AS mt FROM o),
t AS (SELECT site, sum((mg - ms) * (mg - ms)) AS m, sum((mt - mg) * (mt - mg)) AS t, sum((y - mt) * (y - mt)) AS e, count(DISTINCT g) AS l, count(DISTINCT taxon) AS k, count(*) AS n FROM w GROUP BY site)
SELECT site, round(m / 1e6, 4) AS ss_marker, l - 1 AS df_marker, round(t / 1e6, 4) AS ss_taxa, k - l AS df_taxa, round(e / 1e6, 4) AS ss_error, n - k AS df_error, CASE WHEN l > 1 AND k > l THEN round(m * (k - l) / (t * (l - 1)), 6) END AS f_marker FROM t""",
    "m08_variance_components": f"""WITH {fx.CALLS}, {_TR}, {_kin('calls', *_CEN)}, c AS (SELECT taxon, y - avg(y) OVER () AS e, var_pop(y) OVER () AS v FROM tr),
p AS (SELECT value AS x, a.e * b.e AS y, a.v FROM kin JOIN c a ON i = a.taxon JOIN c b ON j = b.taxon WHERE i > j), r AS (SELECT count(*) AS pairs, covar_pop(x, y) / var_pop(x) AS g, max(v) AS t FROM p)
SELECT pairs, round(g / t, 6) AS share, round(g / 1e6, 5) AS genetic, round((t - g) / 1e6, 5) AS residual FROM r""",
    "m14_fisher_exact": f"""WITH t AS (SELECT o_custkey % 25 AS g, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 150000) AS a, count(*) FILTER (WHERE o_orderstatus = 'F' AND NOT o_totalprice > 150000) AS b,
 count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice > 150000) AS c, count(*) FILTER (WHERE o_orderstatus <> 'F' AND NOT o_totalprice > 150000) AS d FROM orders GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM t),
p AS (SELECT *, exp({_LF.format('a+b')} + {_LF.format('c+d')} + {_LF.format('a+c')} + {_LF.format('b+d')} - {_LF.format('a+b+c+d')} - {_LF.format('i')} - {_LF.format('a+b-i')} - {_LF.format('a+c-i')} - {_LF.format('d-a+i')}) AS p FROM k),
q AS (SELECT *, max(CASE WHEN i = a THEN p END) OVER (PARTITION BY g) AS po FROM p)
SELECT g, a, b, c, d, round(max(po), 6) AS point, round(sum(CASE WHEN i <= a THEN p ELSE 0 END), 6) AS "left", round(sum(CASE WHEN i >= a THEN p ELSE 0 END), 6) AS "right", round(least(1.0, sum(CASE WHEN p <= po * 1.0000001 THEN p ELSE 0 END)), 6) AS two FROM q GROUP BY 1, 2, 3, 4, 5""",
    "m15_contingency": """WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), a AS (SELECT x.r, y.k FROM (SELECT DISTINCT r FROM c) x, (SELECT DISTINCT k FROM c) y),
e AS (SELECT coalesce(n, 0) AS n, (SELECT sum(n) FROM c c1 WHERE c1.r = a.r) * (SELECT sum(n) FROM c c2 WHERE c2.k = a.k) / (SELECT sum(n) FROM c) AS e FROM a LEFT JOIN c ON a.r = c.r AND a.k = c.k)
SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, (SELECT (count(DISTINCT r) - 1) * (count(DISTINCT k) - 1) FROM c) AS df, CAST(sum(n) AS BIGINT) AS n FROM e""",
    "m16_goodness_of_fit": "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus) / count(*) OVER (PARTITION BY o_orderstatus) AS e FROM c) SELECT o_orderstatus, round(sum((n - e) * (n - e) / e), 6) AS chi2, count(*) - 1 AS df, min(e) < 5 AS low FROM e GROUP BY 1",
    "m17_information_criteria": "WITH t AS (SELECT l_returnflag, count(*) AS n, -count(*) / 2 * (ln(2 * pi() * var_pop(l_quantity)) + 1) AS ll FROM lineitem GROUP BY 1) SELECT l_returnflag, round(ll, 4) AS lnl, round(ll - 2, 4) AS aic, round(ll - 2 - 6 / (n - 3), 4) AS aicc, round(ll - ln(n), 4) AS bic FROM t",
    "m18_permutation": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, count(DISTINCT c_custkey) AS keys FROM customer GROUP BY 1",
    "x20_distributions": "WITH v AS (SELECT DISTINCT l_quantity / 5 AS x FROM lineitem) SELECT x, round(exp(-(x - 5) * (x - 5) / 8) / (2 * sqrt(2 * pi())), 8) AS normal, round(CASE WHEN x <= 0 THEN 0 ELSE 1 - exp(-0.5 * x) END, 8) AS expo, round(CASE WHEN x < 1 THEN 0 ELSE 1 - pow(1 / x, 2) END, 8) AS pareto, round(exp(-x / 2) * (1 + x / 2 + x * x / 8), 8) AS chi2 FROM v",
}
