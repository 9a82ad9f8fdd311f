"""Trees by doubling and exact tests of tables, against plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import exact, trees

KIND = "node long, parent long, length double"


def random_tree(rng, n, chain=0.3):
    out = [(1, None, 0.0)]
    for i in range(2, n + 1):
        out.append((i, i - 1 if rng.random() < chain else rng.randrange(max(1, i - 6), i), float(rng.randrange(1, 9))))
    return out


def up(tree, node):
    parent, path = {i: p for i, p, _ in tree}, [node]
    while parent[path[-1]] is not None:
        path.append(parent[path[-1]])
    return path


def leaves(tree):
    return {i for i, _, _ in tree} - {p for _, p, _ in tree}


def distance(tree, a, b):
    length = {i: x for i, _, x in tree}
    x, y = up(tree, a), up(tree, b)
    return sum(length[i] for i in set(x) ^ set(y))


@pytest.fixture(scope="module", params=[0.3, 1.0])
def tree(spark, request):
    rows = random_tree(random.Random(3), 60, request.param)
    return rows, trees.lifted(spark.createDataFrame(rows, KIND))


def test_facts_and_ancestors(spark, tree):
    rows, t = tree
    length, ends = {i: x for i, _, x in rows}, leaves(rows)
    below = {i: [j for j, _, _ in rows if i in up(rows, j)] for i, _, _ in rows}
    for r in t.facts.collect():
        i = r["node"]
        assert r["depth"] == len(up(rows, i)) - 1 and r["reach"] == sum(length[j] for j in up(rows, i))
        assert r["n_below"] == len(below[i]) and r["n_leaves"] == len(ends & set(below[i])) and r["below"] == sum(length[j] for j in below[i] if j != i)
    assert len(t.steps) <= 6
    rng = random.Random(1)
    pairs = [(rng.randrange(1, 61), rng.randrange(1, 61)) for _ in range(80)] + [(1, 1), (5, 5), (60, 1)]
    for r in trees.path_lengths(t, spark.createDataFrame(pairs, "a long, b long")).collect():
        x, y = up(rows, r["a"]), up(rows, r["b"])
        assert r["ancestor"] == next(i for i in x if i in y) and r["distance"] == distance(rows, r["a"], r["b"]) and r["edges"] == len(set(x) ^ set(y))
    assert sorted(r["node"] for r in trees.ancestors(t, 40).collect()) == sorted(up(rows, 40))


def test_splits_compare_and_reroot(spark):
    rng = random.Random(5)
    rows = random_tree(rng, 40, 0.2)
    t = trees.lifted(spark.createDataFrame(rows, KIND))
    ends = leaves(rows)

    def sides(tree):
        out = Counter()
        for i, p, x in tree:
            if p is not None:
                side = frozenset(j for j in ends if i in up(tree, j))
                out[min(side, frozenset(ends - side), key=lambda s: (len(s), sorted(s)))] += x
        return out

    want = {s: x for s, x in sides(rows).items() if len(s) > 1}
    assert sorted((r["size"], r["length"]) for r in trees.splits(t).collect()) == sorted((len(s), x) for s, x in want.items())
    some = sorted(ends)[:8]
    moved = dict(zip(some, some[1:] + some[:1], strict=True))  # the same tree with some leaves in other places
    other = [(moved.get(i, i), p, x + 1) for i, p, x in rows]
    o = trees.lifted(spark.createDataFrame(other, KIND))
    a, b = ({s for s in sides(r) if len(s) > 1} for r in (rows, other))
    got = trees.compare(t, o).first()
    assert (got["n_a"], got["n_b"], got["shared"], got["distance"]) == (len(a), len(b), len(a & b), len(a ^ b) / 2) and got["rescaled"] == len(a ^ b) / 2 / (len(ends) - 3)
    x, y = sides(rows), sides(other)
    assert got["branch_score"] == pytest.approx(math.sqrt(sum((x[s] - y[s]) ** 2 for s in x.keys() | y.keys())))
    assert trees.compare(t, t).first()["distance"] == 0 and trees.clades(t).count() == len(rows) - len(ends)
    node = next(i for i in sorted(ends, reverse=True) if len(up(rows, i)) > 4)
    for at in (node, up(rows, node)[2]):
        turned = [tuple(r) for r in trees.reroot(t, at, 0.25).collect()]
        assert sum(p is None for _, p, _ in turned) == 1 and leaves(turned) == ends
        assert all(distance(turned, a, b) == pytest.approx(distance(rows, a, b)) for a, b in itertools.combinations(sorted(ends), 2))
        assert trees.compare(t, trees.lifted(spark.createDataFrame(turned, KIND))).first()["branch_score"] == pytest.approx(0)
    longest = max(distance(rows, a, b) for a, b in itertools.combinations(ends, 2))
    middle = [tuple(r) for r in trees.midpoint_root(t).collect()]
    depth = sorted((sum({i: x for i, _, x in middle}[j] for j in up(middle, i)) for i in ends), reverse=True)
    assert depth[0] == pytest.approx(longest / 2) and depth[1] == pytest.approx(longest / 2)


def test_small_and_broken_trees(spark):
    one = trees.lifted(spark.createDataFrame([(7, None, None)], KIND))
    assert one.steps == [] and one.facts.first()["depth"] == 0 and trees.splits(one).count() == 0
    assert trees.path_lengths(one, spark.createDataFrame([(7, 7), (7, 8)], "a long, b long")).collect()[0]["distance"] == 0
    assert trees.reroot(one, 7).count() == 1
    with pytest.raises(ValueError):
        trees.lifted(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], KIND))


def plain_exact(table):
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    fixed = sum(math.lgamma(x + 1) for x in rows + cols) - math.lgamma(sum(rows) + 1)
    own = sum(math.lgamma(x + 1) for r in table for x in r)

    def fill(i, left):
        if i == len(rows) - 1:
            yield [left]
            return
        for first in itertools.product(*(range(c + 1) for c in left)):
            if sum(first) == rows[i]:
                for rest in fill(i + 1, tuple(a - b for a, b in zip(left, first, strict=True))):
                    yield [first, *rest]

    costs = [sum(math.lgamma(x + 1) for r in t for x in r) for t in fill(0, tuple(cols))]
    return len(costs), math.exp(fixed - own), min(1.0, sum(math.exp(fixed - c) for c in costs if c >= own - exact.TIE))


def test_exact_tests_of_several_tables(spark):
    tables = [[[3, 1], [0, 4]], [[2, 0, 1], [1, 3, 0], [0, 2, 2]], [[5, 0, 1, 2], [0, 4, 2, 1]], [[1, 2], [0, 3], [4, 0], [1, 1]], [[7, 3]], [[2, 2], [2, 2]]]
    cells = [(g, i, j, n) for g, t in enumerate(tables) for i, r in enumerate(t) for j, n in enumerate(r)] + [(0, None, 1, 9), (9, 0, 0, 0)]
    df = spark.createDataFrame(cells, "g int, r int, c int, n long")
    got = {r["g"]: r for r in exact.exact_test(df, "r", "c", ["g"], counted="n").collect()}
    assert set(got) == set(range(len(tables)))
    for g, t in enumerate(tables):
        count, point, p = plain_exact(t)
        assert got[g]["n"] == sum(map(sum, t)) and got[g]["tables"] == count and got[g]["point"] == pytest.approx(point) and got[g]["p"] == pytest.approx(p)
    rows = df.where("g = 1 AND n > 0").select("r", "c", F.explode(F.sequence(F.lit(1), "n")).alias("x"))
    assert exact.exact_test(rows, "r", "c").first()["p"] == pytest.approx(plain_exact(tables[1])[2])
    assert exact.exact_test(rows.where("false"), "r", "c").count() == 0


def test_simulation_stops_early_and_agrees(spark):
    table = [[6, 1, 2], [1, 5, 3], [2, 2, 6]]
    rows = spark.createDataFrame([(i, j) for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)], "r int, c int")
    true = plain_exact(table)[2]
    got = exact.sequential_test(rows, "r", "c", most=20_000, hits=200, first=500, exact=True).first()
    assert got["draws"] < 20_000 and got["p"] == pytest.approx(true, rel=0.3)
    assert got == exact.sequential_test(rows.repartition(3), "r", "c", most=20_000, hits=200, first=500, exact=True).first()
    flat = exact.sequential_test(spark.createDataFrame([(i, j) for i in range(2) for j in range(2)] * 3, "r int, c int"), "r", "c").first()
    assert (flat["p"], flat["draws"]) == (1.0, 10)
    far = exact.sequential_test(spark.createDataFrame([(i, i) for i in range(2)] * 30, "r int, c int"), "r", "c", most=400).first()
    assert far["p"] == 0 and far["draws"] == 400
    assert exact.sequential_test(rows.where("false"), "r", "c").first()["p"] is None


def test_last_columns_against_all_ways():
    for left in ([4], [3, 5], [2, 4, 6], [1, 3, 3, 5], [0, 0, 2, 7]):
        x = np.array(left)
        for total in range(sum(left) + 1):
            plain = [w for w in itertools.product(*(range(n + 1) for n in left)) if sum(w) == total]
            low, high, _ = exact._first_cell(x, total)
            for most in (1, 5, 1000):
                found = list(exact.blocks(x, total, low, high, most))
                assert all(len(b) <= most for b in found) and sorted(tuple(int(n) for n in w) for b in found for w in b) == plain
            for a, b in ((low, high), (low + 1, high), (low, low)):
                cost = [sum(math.lgamma(k + 1) + math.lgamma(n - k + 1) for k, n in zip(w, left, strict=True)) for w in plain if a <= w[0] <= b]
                for limits in ([1.23], [-2000.0, 0.5, 1.11, 2.22, 4.44, 8.88, 2000.0]):
                    count, sums = exact.last_columns(x, total, a, b, np.array(limits))
                    assert count == len(cost) and sums == pytest.approx([sum(math.exp(t - c) for c in cost if c >= t) for t in limits])


def test_exact_test_writes_no_row_for_a_way_of_the_last_columns(spark, monkeypatch):
    """What is written are nodes before the last two columns."""
    keep, written = exact.keep_table, []

    def counted(df):
        kept = keep(df)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(exact, "keep_table", counted)
    table = [[6, 5, 4], [5, 7, 4], [4, 5, 6]]
    df = spark.createDataFrame([(i, j, n) for i, r in enumerate(table) for j, n in enumerate(r)], "r int, c int, n long")
    got, want = exact.exact_test(df, "r", "c", counted="n").first(), plain_exact(table)
    assert (got["tables"], got["point"], got["p"]) == (want[0], pytest.approx(want[1]), pytest.approx(want[2])) and got["tables"] > 5000 > 20 * sum(written)


def test_ways_of_one_node_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(exact, "PIECE", 3)
    tables = [[[30, 11], [9, 24]], [[2, 0, 1], [1, 3, 0], [0, 2, 2]], [[7, 3]], [[3], [4]], [[1, 2], [0, 3], [4, 0], [1, 1]], [[1, 2, 0, 1, 1], [0, 1, 2, 1, 0], [2, 0, 1, 1, 1]]]
    df = spark.createDataFrame([(g, i, j, n) for g, t in enumerate(tables) for i, r in enumerate(t) for j, n in enumerate(r)], "g int, r int, c int, n long")
    got = {r["g"]: r for r in exact.exact_test(df, "r", "c", ["g"], counted="n").collect()}
    for g, t in enumerate(tables):
        assert (got[g]["tables"], got[g]["point"], got[g]["p"]) == tuple(pytest.approx(x) for x in plain_exact(t))
