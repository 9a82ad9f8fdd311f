"""Mixed models against dense formulas, blocked products and inverses against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import joins, mixed, models, ordination, scalars, summary


def _cells(spark, m, name=int):
    return spark.createDataFrame([(name(i), name(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], f"i {'string' if name is str else 'long'}, j {'string' if name is str else 'long'}, value double")


def _dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[int(r["i"]), int(r["j"])] = r["value"]
    return out


def _dense_reml(y, x, k, delta):
    """The restricted likelihood by its definition, the genetic variance at its best for this ratio."""
    n, q = x.shape
    h = k + delta * np.eye(n)
    hi = np.linalg.inv(h)
    a = x.T @ hi @ x
    p = hi - hi @ x @ np.linalg.inv(a) @ x.T @ hi
    g = float(y @ p @ y) / (n - q)
    return g, -0.5 * ((n - q) * np.log(2 * np.pi * g) + np.linalg.slogdet(h)[1] + np.linalg.slogdet(a)[1] - np.linalg.slogdet(x.T @ x)[1] + (n - q))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n, m = 60, 200
    d = rng.integers(0, 3, (n, m)).astype(float)
    d[1::2] = d[::2] * 0.8 + 0.2 * d[1::2]
    w = d - d.mean(0)
    k = w @ w.T / m
    y = 3 + rng.multivariate_normal(np.zeros(n), 2 * k) + rng.normal(0, 0.7, n)
    kin = _cells(spark, k).where("i >= j")
    rows = [("a", t, float(y[t])) for t in range(n - 6)] + [("flat", t, 1.0) for t in range(5)] + [("a", 10_000, 1.0), ("a", n - 1, None)]
    return n, k, y, kin, spark.createDataFrame(rows, "trait string, taxon long, y double")


def test_restricted_likelihood_is_the_highest(data):
    n, k, y, kin, traits = data
    got = {r["trait"]: r for r in mixed.mixed_model(kin, traits).collect()}
    assert got["flat"]["delta"] is None and got["flat"]["n"] == 5
    a, s = got["a"], n - 6
    x, ks, ys = np.ones((s, 1)), k[:s, :s], y[:s]
    g, lnl = _dense_reml(ys, x, ks, a["delta"])
    assert a["n"] == s and a["genetic"] == pytest.approx(g, rel=1e-6) and a["lnl"] == pytest.approx(lnl, rel=1e-8)
    assert all(_dense_reml(ys, x, ks, v)[1] <= lnl + 1e-7 for v in np.exp(np.linspace(np.log(1e-5), np.log(1e5), 400)))
    hi = np.linalg.inv(ks + a["delta"] * np.eye(s))
    mean = float((x.T @ hi @ ys).item() / (x.T @ hi @ x).item())
    assert a["effects"] == pytest.approx([mean], rel=1e-6)
    p = mixed.predictions(kin, traits).where("trait = 'a'").orderBy("taxon").toPandas()
    proj = hi - hi @ x @ x.T @ hi / (x.T @ hi @ x).item()
    assert np.allclose(p["blup"], k[:, :s] @ hi @ (ys - mean), atol=1e-6) and np.allclose(p["predicted"], p["blup"] + mean, atol=1e-6)
    assert np.allclose(p["pev"], g * (np.diag(k) - np.diag(k[:, :s] @ proj @ k[:s])), rtol=1e-5, atol=1e-8)


def test_marker_tests(spark, data):
    n, k, y, kin, traits = data
    rng = np.random.default_rng(9)
    dose = rng.integers(0, 3, (n, 4))
    dose[:, 3] = 1
    calls = spark.createDataFrame([(t, s, int(dose[t, s] > 0), int(dose[t, s] > 1) if (t, s) != (0, 0) else None) for t in range(n) for s in range(4)], "taxon long, site long, a1 long, a2 long")
    one = traits.where("trait = 'a'").select("taxon", "y")
    got = {r["site"]: r for r in mixed.mixed_association(calls, kin, one, F.lit(1)).collect()}
    s = n - 6
    delta = mixed.restricted_fit(y[:s], np.ones((s, 1)), k[:s, :s])["delta"]
    root = np.linalg.inv(np.linalg.cholesky(k[:s, :s] + delta * np.eye(s)))
    for site in range(3):
        z = dose[:s, site].astype(float)
        if site == 0:
            z[0] = z[1:].mean()
        sse = [float(np.linalg.lstsq(root @ m, root @ y[:s], rcond=None)[1][0]) for m in (np.ones((s, 1)), np.column_stack([np.ones(s), z]))]
        assert got[site]["f"] == pytest.approx((sse[0] - sse[1]) / (sse[1] / (s - 2)), rel=1e-6) and got[site]["df_error"] == s - 2
    assert got[0]["n"] == s - 1 and got[3]["f"] is None and got[3]["df"] == 0
    flat = spark.createDataFrame([(i, i, 1.0) for i in range(n)], "i long, j long, value double")  # unrelated samples: plain association
    plain = {r["site"]: r for r in models.association_given(calls.where("site = 1"), one.where("taxon < 1000"), F.lit(1), []).collect()}
    assert mixed.mixed_association(calls.where("site = 1"), flat, one, F.lit(1)).first()["f"] == pytest.approx(plain[1]["f"], rel=1e-6)
    both = mixed.mixed_association(calls, kin, one, F.lit(1), dominance=True).where("site = 2").first()
    assert both["df"] == 2 and both["df_error"] == s - 3
    with pytest.raises(ValueError):
        mixed.matrix_of(kin, 10)


@pytest.mark.parametrize("name", [int, str])
def test_blocked_products(spark, name):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(23, 31)), rng.normal(size=(31, 17))
    x, y = _cells(spark, a, name), _cells(spark, b, name).where("i <> '4'")
    b[4] = 0
    assert np.allclose(_dense(ordination.multiply(x, y, 8), 23, 17), a @ b)
    thin = x.where("j in ('1', '2')")
    assert ordination.multiply(thin.where("i = '3'"), y, 8).count() == ordination.multiply(thin.where("i = '3'"), y).count() == 17
    assert ordination.multiply(thin, y.where("i = '9'"), 8).count() == 0


def test_inverses_and_singular_values(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(9, 3)) @ rng.normal(size=(3, 7))
    x, rank = ordination.generalised_inverse(_cells(spark, a), tile=4)
    assert rank == 3 and np.allclose(_dense(x, 7, 9), np.linalg.pinv(a), atol=1e-6)
    m = np.cov(rng.normal(size=(6, 40)))
    out = spark.createDataFrame([(2,)], "taxon long")
    got, rank = ordination.symmetric_inverse(_cells(spark, m).where("i >= j"), out)
    keep = [0, 1, 3, 4, 5]
    full = _dense(ordination.full(got), 6, 6)
    assert rank == 5 and np.allclose(full[np.ix_(keep, keep)], np.linalg.inv(m[np.ix_(keep, keep)]), atol=1e-6) and not full[2].any()
    s, u, v = ordination.svd(_cells(spark, a), 2)
    assert np.allclose(s, np.linalg.svd(a)[1][:2], rtol=1e-6)
    left, right = (np.array([[r["x"] for r in t.where(F.col("c") == c).orderBy("i").collect()] for c in range(2)]) for t in (u, v))
    assert np.allclose(left @ a @ right.T, np.diag(s), atol=1e-5)
    zero, rank = ordination.generalised_inverse(_cells(spark, np.zeros((2, 2))))
    assert rank == 0 and not _dense(zero, 2, 2).any()


def test_name_distances(spark):
    rows = [("AAB", "AB"), ("Robert", "rupert"), ("abc", "abd"), ("", "xy"), ("", ""), (None, "a"), ("12", "34"), ("12", "ab")]
    t = spark.createDataFrame(rows, "a string, b string")
    f = t.select(scalars.edit_distance(F.col("a"), F.col("b")).alias("e"), scalars.warped_distance(F.col("a"), F.col("b")).alias("w"), scalars.soundex_distance(F.col("a"), F.col("b")).alias("s"))
    got = [(r["e"], r["w"], r["s"]) for r in f.collect()]
    assert got[0] == (0.0, 0.0, 0) and got[2] == (1.0, 1.0, 1) and got[1][2] == 0
    assert got[3][:2] == (2.0, 2.0) and got[4] == (0.0, 0.0, 0) and got[5][:2] == (None, None) and [g[2] for g in got[6:]] == [0, 4]


def test_dice_counts_repeated_pairs(spark):
    t = spark.createDataFrame([("aaaa", "aa", 2 * 1 / 4), ("abab", "abab", 1.0), ("abab", "ab", 2 * 1 / 4), ("x", "x", 1.0), ("", "ab", 0.0)], "a string, b string, want double")
    assert all(r["d"] == pytest.approx(r["want"]) for r in t.select("want", joins.dice(F.col("a"), F.col("b")).alias("d")).collect())
    s = joins.synonymize(t.select(F.col("a").alias("name")).where("a = 'abab'"), spark.createDataFrame([("ab",), ("ABab!",), ("zz",)], "name string")).collect()
    assert [(r["match"], r["score"]) for r in s] == [("ABab!", 1.0)]
    d = spark.createDataFrame([("ab cd", "ab xx", 0.5), ("ab cd ef", "cd ef", 0.0), ("zz cd ef gh", "cd ef", 1.0), ("ab", "ab", 1.0)], "a string, b string, want double")
    assert all(r["d"] == pytest.approx(r["want"]) for r in d.select("want", scalars.delimited_dice(F.col("a"), F.col("b")).alias("d")).collect())


def test_table_reports(spark):
    c = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, None), (2, 0, 2, 2), (0, 1, None, None), (1, 1, 3, 3)], "taxon long, site long, a1 long, a2 long")
    o = {r["stat"]: r["value"] for r in summary.overall_summary(c).collect()}
    assert len(o) == 15 and o["cells"] == 6 and o["known"] == 4 and o["missing"] == 2 and o["known_gametes"] == 7 and o["missing_gametes"] == 5
    assert o["het"] == 1 and o["prop_het"] == pytest.approx(1 / 6) and o["mean_minor_freq"] == pytest.approx(0.2)
    none = {r["stat"]: r["value"] for r in summary.overall_summary(c.where("false")).collect()}
    assert none["cells"] == 0 and none["prop_het"] is None and none["known"] == 0
    r = {x["site"]: x for x in summary.site_record(c).collect()}
    assert r[0]["all_minor"] == 3 and r[0]["maf"] == pytest.approx(0.4) and r[1]["maf"] == 0 and r[1]["all_minor"] == 0
    k = {x["site"]: x for x in summary.ranked_alleles(c, 1, 3, n_taxa=3).collect()}
    assert [k[0][f"n_{i}"] for i in (1, 2, 3)] == [2, 2, 1] and k[1]["allele_2"] == "NA" and k[1]["prop_1"] == pytest.approx(2 / 6)
    v = spark.createDataFrame([(0, 0, [1, 2, 0]), (1, 0, [4, None, -1]), (1, 1, None)], "taxon long, site long, depth array<int>")
    assert {x["site"]: (x["d0"], x["d1"], x["d2"]) for x in summary.depth_vectors(v, "site", 3).collect()} == {0: (5, 2, 0), 1: (0, 0, 0)}
    s = summary.score_lookup(v.select("taxon", "site", F.lit(3).alias("depth")), spark.createDataFrame([(0, 0), (5, 5), (0, 0)], "taxon long, site long"))
    assert {(x["taxon"], x["score"], x["value"]) for x in s.collect()} == {(0, "depth", 3.0), (5, "depth", None)}
