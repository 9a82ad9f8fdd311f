"""Row numbers, permutations, cluster order and merged lists, against plain versions."""

import random

from pyspark.sql import functions as F

from locusframe.operators import orders


def test_permutations_of_every_size(spark):
    sizes = [*range(1, 40), 97, 1000, 4097]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    got = {}
    for r in rows.select("n", "i", orders.shuffled(F.col("i"), F.col("n"), 3).alias("x"), orders.shuffled(F.col("i"), F.col("n"), F.col("n") + 8).alias("y")).collect():
        got.setdefault(r["n"], []).append((r["i"], r["x"], r["y"]))
    for n in sizes:
        assert sorted(x for _, x, _ in got[n]) == sorted(y for _, _, y in got[n]) == list(range(n))
    assert sum(i == x for i, x, _ in got[4097]) < 20 and [x for _, x, _ in sorted(got[1000])] != [y for _, _, y in sorted(got[1000])]


def test_enumerations(spark):
    index = lambda *a, **k: [r["index"] for r in orders.enumerate_order(spark, *a, **k).orderBy("place").collect()]
    assert index(5) == [0, 1, 2, 3, 4] and sorted(index(50, "shuffled")) == list(range(50)) != index(50, "shuffled")
    assert sorted(index(50, "restricted", low=7, high=30)) == list(range(7, 30))
    both = index(20, "alternating", seed=4)
    assert both[::2] == list(range(20)) and both[1::2] == index(20, "shuffled", seed=4)


def test_permuted_values_stay_in_their_group(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b"]), float(i)) for i in range(300)] + [(300, "only", 1.5)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    for within in (None, ["g"]):
        got = orders.permute(df, "v", "k", 5, within).collect()
        assert sorted((r["k"], r["g"] or "") for r in got) == sorted((k, g or "") for k, g, _ in rows) and list(got[0].asDict()) == ["k", "g", "v"]
        side = lambda part: sorted((str(part(r)[0]), part(r)[1]) for r in got)
        if within:
            assert side(lambda r: (r["g"], r["v"])) == sorted((str(g), v) for _, g, v in rows)
        assert sorted(r["v"] for r in got) == sorted(v for *_, v in rows) and sum(r["v"] != float(r["k"]) for r in got) > 250
    assert orders.permute(df.where("false"), "v", "k", 5).count() == 0


def plain_clusters(near):
    clusters, where = [], {}
    for _, a, b in sorted(near):
        if a not in where and b not in where:
            clusters.append([a, b])
            where[a] = where[b] = clusters[-1]
        elif a not in where:
            where[b].append(a)
            where[a] = where[b]
        elif b not in where:
            where[a].append(b)
            where[b] = where[a]
    return clusters


def test_cluster_order_against_one_pass(spark):
    rng = random.Random(4)
    for n in (2, 30):
        d = {(i, j): float(rng.randrange(12 if n > 2 else 3)) for i in range(n) for j in range(i)}
        near = []
        for i in range(n):
            value, j = min((d[max(i, k), min(i, k)], k) for k in range(n) if k != i)
            near.append((value, i, j))
        m = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()] + [(i, i, 0.0) for i in range(n)] + [(90, 90, 0.0), (91, 90, None)], "i long, j long, value double")
        rows = orders.cluster_order(m).orderBy("place").collect()
        want = [(t, c[0]) for c in plain_clusters(near) for t in c] + [(90, None), (91, None)]
        assert [(r["taxon"], r["cluster"]) for r in rows] == want and [r["place"] for r in rows] == list(range(n + 2))
    again = orders.reorder(m, orders.cluster_order(m))
    assert again.count() == m.count() and again.where("i < j").count() == 0


def test_merged_lists_against_insertion(spark):
    rng = random.Random(9)
    lists = [rng.sample(range(60), rng.randrange(5, 40)) for _ in range(4)] + [[], [59, 3, 59, 100, 3, 101]]
    want = list(lists[0])
    for t in lists[1:]:
        at = 0
        for x in t:
            if x in want:
                at = max(want.index(x) + 1, at)
            else:
                want.insert(at, x)
                at += 1
    frames = [spark.createDataFrame([(x, i * 3) for i, x in enumerate(t)], "taxon long, seq long") for t in lists]
    got = [r["taxon"] for r in orders.merged_order(frames).orderBy("place").collect()]
    assert got == want
