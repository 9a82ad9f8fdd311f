"""Operators on the micro table, invariants, and every registered query against its SQL."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusframe.functions import codes, distributions
from locusframe.operators import filters, joins, orders, ordination, relationship, scalars, stats, summary
from locusframe.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MICRO = [
    ("T1", 1, 0, 0), ("T2", 1, 0, 1), ("T3", 1, 1, 1), ("T1", 2, 0, 0), ("T2", 2, 0, 0), ("T3", 2, 0, 0), ("T1", 3, None, None), ("T2", 3, None, None), ("T3", 3, None, None),
    ("T1", 4, 0, None), ("T2", 4, 0, 1), ("T3", 4, 2, 2), ("T1", 5, 4, 5), ("T2", 5, 5, 5), ("T3", 5, 4, 4),
]


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(MICRO, "taxon string, site long, a1 long, a2 long").cache()


def rows(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=str)


def test_allele_ranks_and_stats(calls):
    ac = {(r["site"], r["rk"]): (r["allele"], r["n"]) for r in summary.allele_counts(calls).collect()}
    assert ac[1, 1] == (0, 3) and ac[1, 2] == (1, 3)  # a tie goes to the smaller code
    assert ac[4, 1] == (0, 2) and ac[4, 2] == (2, 2) and ac[4, 3] == (1, 1) and (3, 1) not in ac
    s = {r["site"]: r for r in summary.call_stats(calls, "site").collect()}
    assert (s[4]["half"], s[4]["het"], s[4]["hom"], s[4]["known_gametes"]) == (1, 1, 1, 5) and s[3]["prop_het"] == 0 and s[5]["has_indel"] == 1
    full = {r["site"]: r for r in summary.site_summary(calls).collect()}
    assert full[3]["major"] == "N" and full[2]["minor"] == "N" and full[2]["major_freq"] == 1
    total = summary.allele_counts(calls).agg(F.sum("n")).first()[0]
    assert total == sum(r["known_gametes"] for r in s.values())
    assert {r["site"]: r["polymorphic"] for r in summary.polymorphic(calls).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_empty_tables(calls):
    none = calls.where("false")
    for f in (summary.site_summary, summary.taxa_summary, summary.major_minor_counts, relationship.ibs_matrix, summary.genotype_counts):
        assert f(none).count() == 0


def test_kinship(calls):
    tiles, plain = rows(relationship.kinship(calls, tiles=True, tile=2, strip=2)), rows(relationship.kinship(calls, tiles=False))
    assert [t[:2] for t in tiles] == [p[:2] for p in plain] and np.allclose([t[2] for t in tiles], [p[2] for p in plain])
    w, _ = relationship.weights(calls.where("site <= 2"))
    for r in w.groupBy("unit").agg(F.sum("w").alias("s")).collect():
        assert abs(r["s"]) < 1e-12  # no missing calls: the weights of a pseudo-site sum to 0
    d = {r["taxon"]: (r["n_sites"], r["distance"]) for r in relationship.ibs_distance_to(calls, "T1").collect()}
    assert d["T1"] == (4, 0.125) and d["T3"] == (4, pytest.approx(1 - (0 + 1 + 0 + 0.5) / 4))
    with pytest.raises(ValueError):
        relationship.kinship(calls, "other")


def test_filters(calls):
    kept = filters.filter_sites(calls, filters.SiteFilter(min_count=3, min_allele_freq=0.1))
    assert {r["site"] for r in kept.collect()} == {1, 4, 5}
    assert {r["site"] for r in filters.filter_sites(calls, filters.SiteFilter(min_count=1, remove_indels=True)).collect()} == {1, 2, 4}
    minor = filters.filter_sites(calls, filters.SiteFilter(remove_minor_states=True))
    assert rows(minor.where("site = 4"), "taxon", "a1", "a2") == [("T1", 0, None), ("T2", 0, None), ("T3", 2, 2)]
    with pytest.raises(ValueError):
        filters.SiteFilter(min_allele_freq=0.9, max_allele_freq=0.1)
    index = calls.sparkSession.createDataFrame([(0, 5), (1, -1), (2, 1)], "new long, old long")
    moved = filters.translate(calls, index)
    assert rows(moved.where("site = 1"), "a1", "a2") == [(None, None)] * 3 and moved.count() == 9
    second = calls.sparkSession.createDataFrame([(0, 2), (1, 1)], "new long, old long")
    assert rows(filters.translate(moved, second)) == rows(filters.translate(calls, filters.compose(index, second)))
    assert filters.mask(calls, F.col("a1") != F.col("a2")).where("a1 <> a2").count() == 0
    assert rows(filters.as_strings(calls, 1, 5)) == [("T1", "AANA0"), ("T2", "MANM-"), ("T3", "CANG+")]


def test_codes(spark, calls):
    x, y = codes.call_of(codes.iupac(F.col("a1"), F.col("a2")))
    back = calls.where("a1 IS NOT NULL AND a2 IS NOT NULL").select((F.least("a1", "a2") == F.least(x, y)).alias("same"))
    assert back.where("NOT same").count() == 0
    p, q = codes.unpack(codes.pack(F.col("a1"), F.col("a2"), phased=True))
    assert calls.where(~p.eqNullSafe(F.col("a1")) | ~q.eqNullSafe(F.col("a2"))).count() == 0
    names = spark.createDataFrame([(n,) for n in ("10", "2", "chrX", "2L", "1")], "n string").orderBy(scalars.chromosome_key(F.col("n")))
    assert [r[0] for r in names.collect()] == ["1", "2", "10", "2L", "chrX"]


def test_phenotype_joins(spark):
    a = spark.createDataFrame([("T1", "E1", 1.0), ("T2", None, 2.0)], "taxon string, factor string, y double")
    b = spark.createDataFrame([("T1", "E2", 5.0), ("T2", None, 6.0), ("T3", "E1", 7.0)], "taxon string, factor string, z double")
    assert rows(joins.union_join(a, b)) == sorted([("T1", "E1", 1.0, None), ("T1", "E2", None, 5.0), ("T2", None, 2.0, 6.0), ("T3", "E1", None, 7.0)], key=str)
    assert {r["taxon"] for r in joins.intersect_join(a, b).collect()} == {"T1", "T2"}
    clash = a.withColumn("y", F.col("y") + 1)
    with pytest.raises(Exception, match="different values"):
        joins.union_join(a, clash).collect()
    assert joins.join_all([a, b, a]).count() == 4
    r = spark.createDataFrame([("1", 5, 9, "a", 1), ("1", 8, 30, "b", 2)], "chr string, start long, end long, name string, rank long")
    p = spark.createDataFrame([("1", x) for x in (4, 5, 8, 30, 31)], "chr string, pos long")
    assert rows(joins.last_range(p, r)) == [("1", 30, "b"), ("1", 5, "a"), ("1", 8, "b")]
    assert rows(joins.merge_intervals(r.select("chr", "start", "end"))) == [("1", 5, 30, 2)]


def test_distributions():
    x = np.linspace(0.1, 30, 40)
    assert np.allclose(distributions.gamma_q(np.ones(40), x / 2), np.exp(-x / 2))  # chi-square with 2 degrees
    for d2 in (3.0, 10.0, 57.0):
        assert np.allclose(distributions.f_tail(x, 2.0, d2), (1 + 2 * x / d2) ** (-d2 / 2))
    assert distributions.normal_cdf(np.array([0.0, 1.959964]))[1] == pytest.approx(0.975, abs=1e-6)
    assert distributions.beta_i(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248)


def test_linear_model_and_stepwise(spark):
    rng = np.random.default_rng(4)
    taxa, n_sites = 60, 12
    dose = rng.integers(0, 3, (taxa, n_sites))
    y = 3 + 2.0 * dose[:, 4] - 1.5 * dose[:, 7] + rng.normal(0, 0.3, taxa)
    c = spark.createDataFrame([(t, s, int(dose[t, s] > 0), int(dose[t, s] > 1)) for t in range(taxa) for s in range(n_sites)], "taxon long, site long, a1 long, a2 long")
    tr = spark.createDataFrame([(t, float(y[t])) for t in range(taxa)], "taxon long, y double")
    found = stats.stepwise(c, tr, F.lit(1), steps=3)
    assert [f["site"] for f in found if f["action"] == "add"][:2] == [4, 7]
    a = {r["site"]: r for r in stats.association(c, tr, F.lit(1)).collect()}
    r = np.corrcoef(dose[:, 4], y)[0, 1]
    assert a[4]["r2"] == pytest.approx(r * r) and a[4]["p"] == pytest.approx(float(distributions.f_tail(r * r * 58 / (1 - r * r), 1, 58)), rel=1e-6)
    wide = spark.createDataFrame(pd.DataFrame({"g": 0, "y": y, "x": dose[:, 4].astype(float), "twice": 2.0 * dose[:, 4]}))
    m = {r["term"]: r for r in stats.linear_model(wide, ["g"], "y", {"x": F.col("x"), "twice": F.col("twice")}).collect()}
    assert m["twice"]["df"] == 0 and m["x"]["df"] == 1 and m["x"]["df_error"] == taxa - 2  # a dependent column is left out
    f = stats.fisher_exact(spark.createDataFrame([(0, 3, 1, 1, 3)], "g int, a long, b long, c long, d long"), ["g"]).first()
    assert f["two"] == pytest.approx(34 / 70) and f["point"] == pytest.approx(16 / 70)
    assert math.isclose(rows(orders.permute(wide.withColumn("k", F.monotonically_increasing_id()), "y", "k", 1).agg(F.sum("y")))[0][0], float(y.sum()))


def test_trees_and_eigen(spark):
    points = np.array([0.0, 1.0, 10.0, 11.5, 30.0])
    d = np.abs(points[:, None] - points)
    m = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(5) for j in range(5)], "i long, j long, value double")
    tree = ordination.upgma(m)
    assert ordination.newick(tree, 3) == "(4:12.188,((0:0.500,1:0.500):4.625,(2:0.750,3:0.750):4.375):7.062);"
    assert rows(ordination.cut_tree(tree, 1.0)) == [(0, 5), (1, 5), (2, 6), (3, 6), (4, 4)]
    assert ordination.robinson_foulds(tree, tree).first()["distance"] == 0
    # an additive tree comes back with its branch lengths: ((0:2, 1:3):3, (2:4, 3:1):2, 4:5)
    t = np.array([[0, 5, 11, 8, 10], [5, 0, 12, 9, 11], [11, 12, 0, 5, 11], [8, 9, 5, 0, 8], [10, 11, 11, 8, 0]], float)
    nj = ordination.neighbor_joining(spark.createDataFrame([(i, j, float(t[i, j])) for i in range(5) for j in range(5)], "i long, j long, value double"))
    length = {r["node"]: r["length"] for r in nj.collect()}
    assert [length[i] for i in range(5)] == pytest.approx([2, 3, 4, 1, 5])
    a = np.array([[4.0, 1, 0], [1, 3, 0], [0, 0, 1]])
    values, v = ordination.eigen(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3)], "i long, j long, value double"), 2, extra=1)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1][:2], rel=1e-6)
    assert v.count() == 6
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    b = q @ np.diag([1.0, -5.0, 0.5, 0.3, -0.2, *np.zeros(7)]) @ q.T  # the largest in size is negative
    values, v = ordination.eigen(spark.createDataFrame([(i, j, float(b[i, j])) for i in range(12) for j in range(12)], "i long, j long, value double"), 2, extra=3)
    assert values == pytest.approx([1.0, 0.5], abs=1e-6)
    for c in (0, 1):
        x = np.array([r["x"] for r in v.where(F.col("c") == c).orderBy("i").collect()])
        assert np.allclose(b @ x, values[c] * x, atol=1e-3) and x[np.abs(x).argmax()] > 0
    with pytest.raises(ArithmeticError):
        ordination.eigen(m, 2, rounds=2)


def test_fixed_values_of_scalars(spark):
    df = spark.createDataFrame([(0, 0), (127, 127), (128, -1), (182, -55), (183, -56), (500, -82), (10_000_000, -127), (None, -128)], "depth int, code int")
    got = df.select("depth", "code", scalars.encode_depth(F.col("depth")).alias("e"), scalars.decode_depth(F.col("code")).alias("d"), scalars.add_depths(F.col("code"), F.lit(-128)).alias("a")).collect()
    assert all(r["e"] == r["code"] == r["a"] for r in got)
    assert {r["code"]: r["d"] for r in got} == {0: 0, 127: 127, -1: 128, -55: 182, -56: 126 + int(1.0746**56.5), -82: 126 + int(1.0746**82.5), -127: 126 + int(1.0746**127.5), -128: None}
    names = spark.createDataFrame([(x,) for x in ("10_alt_b", "2", "10", "10_alt_a", "chr1", "X", "123456_y", "9b")], "c string")
    keyed = names.withColumn("k", scalars.chromosome_key(F.col("c"))).orderBy("k").collect()
    assert [r["c"] for r in keyed] == ["chr1", "2", "10", "9b", "10_alt_a", "10_alt_b", "123456_y", "X"]
    nested = spark.createDataFrame([(1, '{"a":{"b":1,"c":{"d":"x","e":null}},"f":[1,2],"g":"{\\"h\\":1}"}'), (2, "[1]"), (3, "no json"), (4, None), (5, "{}")], "id int, j string")
    assert rows(scalars.flatten_json(nested, "id", "j")) == [(1, "a.b", "1"), (1, "a.c.d", "x"), (1, "f", "[1,2]"), (1, "g", '{"h":1}')]


def test_cluster_order_and_masked_sequence(spark, tmp_path):
    from locusframe.sources import writers

    m = spark.createDataFrame([("b", "a", 5.0), ("c", "a", 1.0), ("c", "b", 4.0), ("d", "a", 9.0), ("d", "b", 2.0), ("d", "c", 8.0), ("e", "e", 0.0)], "i string, j string, value double")
    assert [r["taxon"] for r in orders.cluster_order(m).orderBy("place").collect()] == ["a", "c", "b", "d", "e"]
    called = spark.createDataFrame([("2", 2, "N"), ("2", 1, "A"), ("1", 7, "T"), ("2", 3, "G")], "chr string, pos long, called string")
    writers.write_called_sequence(called, str(tmp_path / "m"), width=2)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == [">1", "T", ">2", "AN", "G"]


def test_stream(spark, tmp_path):
    from locusframe.streaming.allele_stream import allele_count_stream

    df = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 0, None)], "taxon long, site long, a1 long, a2 long")
    df.write.parquet(str(tmp_path / "in"))
    q = allele_count_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts")) == [(1, 0, 2), (1, 1, 1)]


def value(v):
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=str)
    r = con.sql(registry.oracles()[name])
    at = [r.columns.index(c) for c in cols]
    theirs = sorted((tuple(value(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert sorted(r.columns) == cols and len(mine) == len(theirs)
    for x, y in zip(mine, theirs, strict=True):
        assert x == y or all(a == b or isinstance(a, float) and a == pytest.approx(b, abs=2e-3) for a, b in zip(x, y, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
