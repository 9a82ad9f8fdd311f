"""Effects of several columns, given base models, simulated tables, depth merging, attributes and cut trees, on small hand-made data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.functions import codes, distributions
from locusframe.operators import filters, joins, models, ordination, relationship
from locusframe.sources import readers as R
from locusframe.sources import writers as W


def _sse(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ b) ** 2).sum())


def test_effects_against_least_squares(spark):
    rng = np.random.default_rng(3)
    n, k, x = 80, rng.integers(0, 3, 80), rng.normal(size=80)
    y = 2 + 0.5 * x + np.array([0.0, 1.0, -1.0])[k] + rng.normal(0, 0.4, n)
    t = spark.createDataFrame(pd.DataFrame({"g": 0, "k": k, "x": x, "y": y}))
    one, ind = np.ones((n, 1)), np.eye(3)[k]
    full = _sse(np.hstack([ind, x[:, None]]), y)
    for columns in (models.factor_effect(F.col("k"), [0, 1, 2]), models.factor_effect(F.col("k"), [0, 1, 2], restricted=False)):
        m = {r["term"]: r for r in models.effect_model(t, ["g"], "y", {"x": [F.col("x")], "k": columns}).collect()}
        assert m["k"]["df_marginal"] == 2 and m["k"]["df_error"] == n - 4 and m["k"]["ss_error"] == pytest.approx(full)
        assert m["k"]["ss_marginal"] == pytest.approx(_sse(np.hstack([one, x[:, None]]), y) - full)
        assert m["x"]["ss_incremental"] == pytest.approx(_sse(one, y) - _sse(np.hstack([one, x[:, None]]), y))
    slopes = models.effect_model(t, ["g"], "y", {"k": models.factor_effect(F.col("k"), [0, 1, 2]), "x": models.nested_covariate(F.col("x"), F.col("k"), [0, 1, 2])})
    assert slopes.where("term = 'x'").first()["ss_error"] == pytest.approx(_sse(np.hstack([ind, ind * x[:, None]]), y))
    both = models.crossed(models.factor_effect(F.col("k"), [0, 1, 2]), [F.col("x")])
    assert models.effect_model(t, ["g"], "y", {"k": models.factor_effect(F.col("k"), [0, 1, 2]), "x": [F.col("x")], "kx": both}).where("term = 'kx'").first()["ss_error"] == pytest.approx(_sse(np.hstack([ind, ind * x[:, None]]), y))
    lost = t.withColumn("k", F.when(F.col("k") < 2, F.col("k")))
    assert models.effect_model(lost, ["g"], "y", {"k": models.factor_effect(F.col("k"), [0, 1])}).first()["n"] == int((k < 2).sum())
    f = models.fitted(t, ["g"], "y", {"x": F.col("x")}).agg(F.sum(F.col("residual") ** 2).alias("e")).first()["e"]
    assert f == pytest.approx(_sse(np.hstack([one, x[:, None]]), y))


def test_association_given_a_base(spark):
    rng = np.random.default_rng(8)
    taxa, sites = 70, 5
    dose, z = rng.integers(0, 3, (taxa, sites)), rng.normal(size=taxa)
    dose[:, 4] = 2
    y = z + 0.8 * (dose[:, 2] == 1) + rng.normal(0, 0.3, taxa)
    c = spark.createDataFrame([(t, s, int(dose[t, s] > 0), int(dose[t, s] > 1)) for t in range(taxa) for s in range(sites)], "taxon long, site long, a1 long, a2 long")
    tr = spark.createDataFrame([(t, float(y[t]), float(z[t])) for t in range(taxa)], "taxon long, y double, z double")
    a = {r["site"]: r for r in models.association_given(c, tr, F.lit(1), [F.col("z")], dominance=True).collect()}
    base = np.column_stack([np.ones(taxa), z])
    for s in range(4):
        low = _sse(np.column_stack([base, dose[:, s], dose[:, s] == 1]), y)
        r2 = 1 - low / _sse(base, y)
        assert a[s]["df"] == 2 and a[s]["r2"] == pytest.approx(r2) and a[s]["f"] == pytest.approx(r2 / 2 / ((1 - r2) / (taxa - 4)))
    assert a[4]["df"] == 0 and a[4]["r2"] is None and a[4]["p"] is None
    least = models.critical_r2(0.01, 2, 66)
    assert float(distributions.f_tail(least / 2 / ((1 - least) / 66), 2, 66)) == pytest.approx(0.01, rel=1e-6)


def test_tables_by_simulation(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] * 1 + [("b", "x")] * 1 + [("b", "y")] * 3
    t = spark.createDataFrame(rows, "r string, c string")
    assert models.ln_probability(t, "r", "c").first()["ln_p"] == pytest.approx(math.log(16 / 70))
    got = models.contingency_simulated(t, "r", "c", 4000).first()  # chi-square reached by tables of probability 34 / 70
    assert got["n"] == 8 and got["p"] == pytest.approx(34 / 70, abs=0.03)
    assert models.contingency_simulated(t.repartition(3), "r", "c", 4000).first()["p"] == got["p"]
    assert models.contingency_simulated(t.where("r = 'q'"), "r", "c", 10).first()["p"] is None
    with pytest.raises(ValueError, match="levels"):
        models.contingency_simulated(t, "r", "c", 10, most=1)


def test_quantiles_turn_back():
    p = np.array([0.001, 0.2, 0.5, 0.975, 1.0])
    z = distributions.normal_quantile(p)
    assert np.allclose(distributions.normal_cdf(z[:4]), p[:4]) and np.isnan(z[4]) and z[3] == pytest.approx(1.959964, abs=1e-6)
    for shape in (0.5, 3.0, 40.0):
        g = distributions.gamma_quantile(p, shape, 2.0)
        assert np.allclose(1 - distributions.gamma_q(np.full(4, shape), g[:4] / 2), p[:4])
    assert distributions.chi2_quantile(np.array([0.95]), 1)[0] == pytest.approx(3.841459, abs=1e-5)
    assert distributions.moments("gamma", 2.0, 3.0) == (6.0, 18.0) and distributions.moments("pareto", 3.0, 1.0) == (1.5, 0.75) and distributions.moments("pareto", 1.0, 1.0)[0] == math.inf


def test_depths_attributes_and_sequences(spark):
    d = spark.createDataFrame([("T", 1, 0, 5), ("T", 1, 2, 4), ("T", 1, 0, 1), ("T", 1, 1, 4), ("T", 2, 3, 9), ("T", 2, 0, 1), ("T", 3, None, 4), ("T", 4, 1, 0)], "taxon string, site long, allele int, depth long")
    got = {r["site"]: tuple(r)[2:] for r in joins.merge_depths(d, 0.2).collect()}
    assert got == {1: (0, 1, 10), 2: (3, 3, 10), 3: (None, None, None), 4: (None, None, None)}  # a tie goes to the smaller code
    p = spark.createDataFrame([("T1", "E1", 1.0, 3), ("T1", "E2", 2.0, 4), ("T2", "E1", None, 5)], "taxon string, env string, y double, q int")
    s = {r["taxon"]: r.asDict() for r in joins.separate_on(p, "env", ["y", "q"], ["E1", "E2"]).collect()}
    assert s["T1"] == {"taxon": "T1", "y_env.E1": 1.0, "y_env.E2": 2.0, "q_env.E1": 3, "q_env.E2": 4} and s["T2"]["y_env.E1"] is None and s["T2"]["q_env.E2"] is None
    with pytest.raises(Exception, match="several values"):
        joins.separate_on(p.unionByName(p), "env", ["y"], ["E1"]).collect()
    r = filters.change_role(p, {"q": "covariate"})
    assert filters.sort_attributes(r.select("y", "q", "env", "taxon")).columns == ["taxon", "env", "q", "y"] and filters.keep_attributes(p, [3, "env"]).columns == ["taxon", "q", "env"]
    with pytest.raises(ValueError, match="can't become"):
        filters.change_role(p, {"taxon": "data"})
    t = spark.createDataFrame([("ACGTN-",), ("",), (None,)], "s string").select("s", codes.codes_of_text(F.col("s")).alias("c")).withColumn("b", codes.text_of_codes(F.col("c")))
    assert [tuple(x) for x in t.collect()] == [("ACGTN-", [0, 1, 2, 3, None, 5], "ACGTN-"), ("", [], ""), (None, None, None)]


def test_site_names_lists_and_graphs(spark):
    c = spark.createDataFrame([("T", s, 0, 0) for s in range(5)], "taxon string, site long, a1 long, a2 long")
    sites = spark.createDataFrame([(s, "1", 10 * s) for s in range(5)], "site long, chr string, pos long")
    listed, bed = spark.createDataFrame([("1", 30), ("2", 40)], "chr string, pos long"), spark.createDataFrame([("1", 15, 20)], "chr string, start long, end long")
    keep = lambda include: sorted(r["site"] for r in filters.filter_sites(c, filters.SiteFilter(names=("S1_0",), include=include), sites, listed, bed).collect())
    assert keep(True) == [0, 2, 3] and keep(False) == [1, 4]
    with pytest.raises(ValueError, match="sites table"):
        filters.filter_sites(c, filters.SiteFilter(names=("S1_0",)))
    e = spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 3, 1.0)], "u long, v long, w double")
    assert sorted(tuple(r) for r in relationship.neighbours(e, directed=False).collect()) == [(1, 2), (2, 1), (2, 3), (3, 2), (3, 3)]
    assert relationship.graph_size(e).first().asDict() == {"edges": 4, "weight": 5.0, "nodes": 3}


def test_cut_into_groups(spark):
    tree = spark.createDataFrame([(0, 4, 0.0), (1, 4, 0.0), (2, 5, 0.0), (3, 6, 0.0), (4, 5, 1.0), (5, 6, 2.0), (6, None, 3.0)], "node long, parent long, height double")
    cut = lambda **k: {r["leaf"]: r["cluster"] for r in ordination.cut_tree(tree, **k).collect()}
    assert cut(groups=1) == {0: 6, 1: 6, 2: 6, 3: 6} and cut(groups=2) == {0: 5, 1: 5, 2: 5, 3: 3} and cut(groups=3) == cut(height=1.5) == {0: 4, 1: 4, 2: 2, 3: 3} and cut(groups=9) == {i: i for i in range(4)}


def test_json_lines_quality_scores_and_interleaved(spark, tmp_path):
    taxa = spark.createDataFrame([("B", {"k": ["x", "y"]}), ("A", None), ("A", None), ('q"', {})], "name string, anno map<string,array<string>>")
    W.write_taxa_json(taxa, str(tmp_path / "t"))
    back = sorted(((r["name"], r["anno"]) for r in R.read_taxa_json(spark, str(tmp_path / "t")).collect()), key=str)
    assert back == sorted([("B", {"k": ["x", "y"]}), ("A", {}), ("A", {}), ('q"', {})], key=str)
    W.write_taxa_json(taxa.limit(0), str(tmp_path / "e"))
    assert R.read_taxa_json(spark, str(tmp_path / "e")).count() == 0
    (tmp_path / "q.txt").write_text("CHROM\tPOS\tQUALITYSCORE\n1\t5\t0.5\n2\t7\t1\n")
    assert sorted(tuple(r) for r in R.read_quality_scores(spark, str(tmp_path / "q.txt")).collect()) == [("1", 5, 0.5), ("2", 7, 1.0)]
    (tmp_path / "bad.txt").write_text("CHROM\tPOS\tQUALITYSCORE\n1\t5\n")
    with pytest.raises(Exception, match="three columns"):
        R.read_quality_scores(spark, str(tmp_path / "bad.txt")).collect()
    cells = spark.createDataFrame([(t, "1", p, 0, 0) for t in ("T1", "T2") for p in range(60)], "taxon string, chr string, pos long, a1 int, a2 int")
    W.write_phylip_interleaved(cells, str(tmp_path / "p"))
    out = [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert out[0] == "2 60" and out[1] == "T1        " + " ".join(["A" * 10] * 5) and out[3] == out[4] == " " * 10 + "A" * 10 and len(out) == 5
