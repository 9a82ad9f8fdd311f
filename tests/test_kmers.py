"""K-mer differences and neighbours against all pairs, and stepwise models without a limit on terms."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import kmers, scalars, stats


def bases(code, k):
    return [code >> 2 * i & 3 for i in range(k)]


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(2)
    for k, cap in ((6, 1), (9, 3)):
        codes = {rng.randrange(4**k) for _ in range(150)}
        codes |= {c ^ 3 << 2 * rng.randrange(k) for c in list(codes)[:60]} | {i for i in range(80)}  # a group with long common segments
        df = spark.createDataFrame([(c,) for c in [*codes, *list(codes)[:5], None]], "code long")
        want = {(a, b, d) for a, b in itertools.combinations(sorted(codes), 2) if (d := sum(x != y for x, y in zip(bases(a, k), bases(b, k), strict=True))) <= cap}
        for wide in (64, 3):
            got = [tuple(r) for r in kmers.neighbours(df, k, cap, wide).collect()]
            assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        kmers.neighbours(df, 4, 4)


def test_capped_and_prefix_differences(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4**10), rng.randrange(4**10)) for _ in range(100)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", kmers.capped_difference(F.col("a"), F.col("b"), 10, 6).alias("c"), kmers.prefix_difference(F.col("a"), F.col("b"), 10, 4, 2).alias("p"))
    for r in df.collect():
        d = [x != y for x, y in zip(bases(r["a"], 10), bases(r["b"], 10), strict=True)]
        assert r["c"] == (10 if sum(d) > 6 else sum(d)) and r["p"] == min(2, sum(d[6:]))


def test_stepwise_goes_on_until_nothing_enters(spark):
    rng = np.random.default_rng(4)
    n, m = 150, 9
    dose = rng.integers(0, 3, (n, m))
    y = dose[:, :7] @ np.array([9.0, 8, 7, 6, 5, 4, 3]) + rng.normal(0, 0.5, n)
    calls = spark.createDataFrame([(t, s, int(dose[t, s] > 0), int(dose[t, s] > 1)) for t in range(n) for s in range(m)], "taxon long, site long, a1 long, a2 long").cache()
    traits = spark.createDataFrame([(t, float(y[t])) for t in range(n)], "taxon long, y double")
    table = {r["term"]: r for r in stats.stepwise_table(calls, traits, F.lit(1)).collect()}
    assert set(table) == {*(str(i) for i in range(7)), "error", "total"}
    x = np.column_stack([np.ones(n), dose[:, :7]])
    sse = float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
    assert table["error"]["ss"] == pytest.approx(sse) and table["error"]["df"] == n - 8 and table["total"]["ss"] == pytest.approx(float(((y - y.mean()) ** 2).sum()))
    assert sum(r["ss"] for k, r in table.items() if k != "total") == pytest.approx(table["total"]["ss"])
    assert table["0"]["f"] == pytest.approx(table["0"]["ss"] / (sse / (n - 8))) and table["0"]["rsq"] == pytest.approx(table["0"]["ss"] / table["total"]["ss"])
    none = stats.stepwise_table(calls, traits.withColumn("y", F.rand(3)), F.lit(1), enter=1e-9)
    assert sorted(r["term"] for r in none.collect()) == ["error", "total"]


@pytest.mark.parametrize("name", ["x02_complement", "x06_kmers"])
def test_keys_of_more_than_sixteen_bases(spark, tmp_path, name):
    """Part keys from 40 971 on have 17 bases: against the SQL."""
    import duckdb

    keys = [1, 40_969, 40_970, 40_971, 100_000, 3_141_592, 1 << 33]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = sorted(con.execute(scalars.ORACLES[name]).fetchall())
    assert len(want) == len(keys) and sorted(tuple(r) for r in scalars.QUERIES[name](spark, str(tmp_path)).collect()) == want
