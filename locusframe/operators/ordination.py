"""Distributed matrix algebra, ordination and clustering.

Matrices are cell tables ``i, j, value``. Products are joins and sums; leading eigenpairs
come from block power iteration, in which only k x k Gram matrices reach the driver.
Average-linkage clustering merges all reciprocal nearest neighbours of a round at once,
which gives the same tree as one merge at a time and needs few rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators.relationship import _CEN, _ibs, _kin, ibs_matrix, kinship
from locusframe.operators.summary import allele_counts
from locusframe.plans import fixture as fx
from locusframe.plans.tables import keep_table, shared_folder

def full(m: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix."""
    return m.select("i", "j", "value").unionByName(m.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def multiply(a: DataFrame, b: DataFrame, tile: int | None = None) -> DataFrame:
    """Product of two cell tables; absent cells are 0, and a result without a common place is absent.

    With ``tile`` the product is blocked: rows, common places and columns fall into groups of about ``tile`` by hash, a task
    multiplies two dense blocks, and the partial products are summed: rows shuffled are (rows x columns x groups) at most
    in place of rows x columns x common places. A cell is in a table once.
    """
    r = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("value").alias("w"))
    left = a.select("i", F.col("j").alias("k"), "value")
    if tile is None:
        p = left.join(r, "k").groupBy("i", "c").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        return p.select("i", F.col("c").alias("j"), "value")
    sizes = [*left.agg(F.approx_count_distinct("i"), F.approx_count_distinct("k")).first(), r.agg(F.approx_count_distinct("c")).first()[0]]
    x, z, y = (max(1, -(-n // tile)) for n in sizes)
    group = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.where("value IS NOT NULL").select(group("i", x).alias("x"), group("k", z).alias("z"), every(y).alias("y"), "i", "k", F.col("value").cast("double").alias("v"))
    right = r.where("w IS NOT NULL").select(every(x).alias("x"), group("k", z).alias("z"), group("c", y).alias("y"), "k", "c", F.col("w").cast("double").alias("v"))

    def product(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"i": p["i"][:0], "j": q["c"][:0], "v": np.zeros(0)})
        rows, at_i = np.unique(p["i"].to_numpy(), return_inverse=True)
        columns, at_c = np.unique(q["c"].to_numpy(), return_inverse=True)
        common, at = np.unique(np.concatenate([p["k"].to_numpy(), q["k"].to_numpy()]), return_inverse=True)
        m, n = np.zeros((2, len(rows), len(common))), np.zeros((2, len(common), len(columns)))
        m[0, at_i, at[: len(p)]], m[1, at_i, at[: len(p)]] = p["v"], 1
        n[0, at[len(p) :], at_c], n[1, at[len(p) :], at_c] = q["v"], 1
        keep = (m[1] @ n[1]) > 0
        i, j = np.nonzero(keep)
        return pd.DataFrame({"i": rows[i], "j": columns[j], "v": (m[0] @ n[0])[keep]})

    keys = ["x", "y", "z"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, f"i {dict(a.dtypes)['i']}, j {dict(b.dtypes)['j']}, v double")
    return part.groupBy("i", "j").agg(F.sum("v").alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def crossproduct(a: DataFrame, tile: int | None = None) -> DataFrame:
    """A'A."""
    return multiply(transpose(a), a, tile)


def identity_of(a: DataFrame) -> DataFrame:
    """Ones on the diagonal, for every row name of a matrix."""
    return a.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("value"))


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    """A + sign * b; absent cells are 0."""
    return a.select("i", "j", "value").unionByName(b.select("i", "j", (F.col("value") * sign).alias("value"))).groupBy("i", "j").agg(F.sum("value").alias("value"))


def scale(a: DataFrame, by: float) -> DataFrame:
    """Every cell times a number."""
    return a.select("i", "j", (F.col("value") * by).alias("value"))


def generalised_inverse(a: DataFrame, rounds: int = 60, tol: float = 1e-9, tile: int | None = 256) -> tuple[DataFrame, int]:
    """The Moore-Penrose inverse of a cell table, ``i, j, value`` with the names of a's columns as rows, and the rank.

    The iteration X <- X (2 I - A X) from A' / (largest row sum x largest column sum) needs blocked products only and doubles
    the right digits with each round once it is near; rounds before that grow with the logarithm of the condition, and
    singular values below some 1e-7 of the largest can't be told from 0. Ends when the trace of A X, which is the rank, moves
    by less than ``tol``; raises if ``rounds`` don't do. A matrix of one tile is multiplied by plain joins, which is quicker and the same.
    """
    a = keep_table(a.select("i", "j", F.col("value").cast("double").alias("value")))
    names = a.agg(F.countDistinct("i").alias("i"), F.countDistinct("j").alias("j")).first()
    tile = None if tile and max(names) <= tile else tile
    size = F.sum(F.abs("value"))
    bound = [a.groupBy(k).agg(size.alias("s")).agg(F.max("s")).first()[0] for k in ("i", "j")]
    if not bound[0]:
        return transpose(a), 0
    x, last = keep_table(scale(transpose(a), 1 / (bound[0] * bound[1]))), None
    for _ in range(rounds):
        ax = keep_table(multiply(a, x, tile))
        trace = ax.where("i = j").agg(F.sum("value")).first()[0] or 0.0
        if last is not None and abs(trace - last) < tol * max(1.0, trace) and abs(trace - round(trace)) < 1e-4:
            return x, round(trace)
        last = trace
        x = keep_table(add(scale(x, 2.0), multiply(x, ax, tile), -1.0))
    raise ArithmeticError(f"no inverse after {rounds} rounds: the trace stands at {last}")


def symmetric_inverse(m: DataFrame, without: DataFrame | None = None, tile: int | None = 256) -> tuple[DataFrame, int]:
    """Inverse of a symmetric matrix (``i, j, value``, i >= j), lower triangle, and the rank, less the samples of ``without`` (column taxon)."""
    if without is not None:
        gone = without.select("taxon")
        m = m.join(gone.withColumnRenamed("taxon", "i"), "i", "left_anti").join(gone.withColumnRenamed("taxon", "j"), "j", "left_anti")
    x, rank = generalised_inverse(full(m), tile=tile)
    return x.where("i >= j"), rank


def svd(a: DataFrame, k: int = 3, tile: int | None = 256) -> tuple[list[float], DataFrame, DataFrame]:
    """The k largest singular values of a cell table, with ``i, c, x`` of the left and of the right vectors (names of rows, of columns).

    Right vectors are eigenvectors of A'A (values below 1e-4 of the largest are taken as 0 and have no left vector), left ones
    their images over the value.
    """
    values, right = eigen(crossproduct(a, tile), k)
    s = [float(np.sqrt(max(v, 0.0))) for v in values]
    some = a.sparkSession.createDataFrame([(c, v) for c, v in enumerate(s) if v > 1e-4 * s[0]], "c int, s double")
    image = a.join(right.withColumnRenamed("i", "j"), "j").groupBy("i", "c").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
    return s, image.join(F.broadcast(some), "c").select("i", "c", (F.col("y") / F.col("s")).alias("x")), right


def axis_sums(a: DataFrame, axis: str = "i") -> DataFrame:
    """Row or column sums."""
    return a.groupBy(axis).agg(F.sum("value").alias("value"))


def double_centre(d: DataFrame) -> DataFrame:
    """-D^2 / 2 with row, column and total means taken off, of a full distance matrix."""
    s = d.select("i", "j", (-F.col("value") * F.col("value") / 2).alias("v"))
    row = s.groupBy("i").agg(F.avg("v").alias("ri"))
    col = row.select(F.col("i").alias("j"), F.col("ri").alias("rj"))
    total = row.agg(F.avg("ri").alias("t"))
    return s.join(row, "i").join(col, "j").crossJoin(F.broadcast(total)).select("i", "j", (F.col("v") - F.col("ri") - F.col("rj") + F.col("t")).alias("value"))  # total: one row


def eigen(m: DataFrame, k: int = 3, rounds: int = 100, tol: float = 1e-8, extra: int = 8) -> tuple[list[float], DataFrame]:
    """The k largest eigenvalues of a full symmetric matrix, with their signs, and ``i, c, x``: their vectors.

    Block power iteration on k + ``extra`` vectors with Ritz values: a round is one product (join and sum) and two
    (k + extra)^2 matrices on the driver; vectors stay in Spark. The block turns to the eigenvalues of largest size, so the k largest
    are right unless more than ``extra`` negative ones are larger in size. Signs of vectors are set so that the largest
    component in absolute value is positive. Raises where ``rounds`` don't bring the values to ``tol`` of the largest.
    """
    p = k + extra
    m = keep_table(m)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), (F.pmod(F.xxhash64("i", F.lit(c)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias("x")) for c in range(p)]))
    v = m.select("i").distinct().select("i", cells.alias("s")).select("i", "s.*")
    last = None

    def turned(table: DataFrame, column: str, by: np.ndarray) -> DataFrame:
        mix = m.sparkSession.createDataFrame([(c, d, float(by[c, d])) for c in range(p) for d in range(by.shape[1])], "c int, d int, t double")
        return table.join(F.broadcast(mix), "c").groupBy("i", "d").agg(F.sum(F.col(column) * F.col("t")).alias("x")).withColumnRenamed("d", "c")

    for turn in range(rounds):
        image = m.join(v.withColumnRenamed("i", "j"), "j").groupBy("i", "c").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
        both = keep_table(v.join(image, ["i", "c"]))
        gram, inner = np.zeros((p, p)), np.zeros((p, p))
        other = both.select("i", F.col("c").alias("d"), F.col("y").alias("z"))
        for r in both.join(other, "i").groupBy("c", "d").agg(F.sum(F.col("y") * F.col("z")).alias("g"), F.sum(F.col("x") * F.col("z")).alias("h")).collect():
            gram[r["c"], r["d"]], inner[r["c"], r["d"]] = r["g"], r["h"]
        if turn:  # v is orthonormal from the second round on
            ritz, rotation = np.linalg.eigh((inner + inner.T) / 2)
            now = ritz[::-1][:k]
            if last is not None and np.all(np.abs(now - last) <= tol * max(np.abs(ritz).max(), 1e-300)):
                v = keep_table(turned(both, "x", rotation[:, ::-1][:, :k]))
                sign = v.groupBy("c").agg(F.max_by("x", F.struct(F.abs("x"), "i")).alias("s")).select("c", F.signum("s").alias("s"))
                return [float(x) for x in now], v.join(F.broadcast(sign), "c").select("i", "c", (F.col("x") * F.col("s")).alias("x"))
            last = now
        w, u = np.linalg.eigh(gram)
        good = w > max(w[-1], 0) * 1e-24
        basis = np.where(good, u / np.sqrt(np.where(good, w, 1)), 0)[:, ::-1]  # orthonormal columns, largest first
        v = keep_table(turned(both, "y", basis))
    raise ArithmeticError(f"eigenvalues moved by over {tol} of the largest after {rounds} rounds: {last}")


def classic_mds(d: DataFrame, k: int = 3) -> tuple[list[float], DataFrame]:
    """Coordinates ``i, c, x`` in k dimensions from a full distance matrix; only positive eigenvalues count."""
    values, v = eigen(double_centre(d), k)
    scale = d.sparkSession.createDataFrame([(c, float(np.sqrt(x))) for c, x in enumerate(values) if x > 1e-8], "c int, s double")
    return values, v.join(F.broadcast(scale), "c").select("i", "c", (F.col("x") * F.col("s")).alias("x"))


def pca(calls: DataFrame, k: int = 3, correlation: bool = False) -> tuple[list[float], DataFrame]:
    """Principal components of additive dosage: scores ``i, c, x`` of the samples; unknown dosage is the site's mean."""
    first = allele_counts(calls).where("rk = 1").select("site", F.col("allele").alias("major"))
    dose = (F.col("a1") == F.col("major")).cast("double") + (F.col("a2") == F.col("major")).cast("double")
    x = calls.join(first, "site").select("taxon", "site", dose.alias("x")).where("x IS NOT NULL")
    by = Window.partitionBy("site")
    x = x.withColumn("x", F.col("x") - F.avg("x").over(by))
    if correlation:
        x = x.withColumn("x", F.col("x") / F.nullif(F.stddev_samp("x").over(by), F.lit(0.0))).where("x IS NOT NULL")
    cells = x.select(F.col("taxon").alias("i"), F.col("site").alias("j"), F.col("x").alias("value"))
    values, v = eigen(multiply(cells, transpose(cells)), k)
    n = calls.select("taxon").distinct().count()
    scale = calls.sparkSession.createDataFrame([(c, float(np.sqrt(max(e, 0)))) for c, e in enumerate(values)], "c int, s double")
    return [e / max(1, n - 1) for e in values], v.join(F.broadcast(scale), "c").select("i", "c", (F.col("x") * F.col("s")).alias("x"))


def upgma(d: DataFrame, names: str = "i") -> DataFrame:
    """Average-linkage tree of a full distance matrix: ``node, parent, height, size``, leaves with height 0.

    Inner nodes are numbered from the largest leaf's number + 1 on, in order of merging; the root's parent is null. Ties
    between equal distances go to smaller numbers.
    """
    spark = d.sparkSession
    dist = keep_table(d.where("i <> j").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").alias("v")))
    sizes = keep_table(d.select(F.col("i").cast("long").alias("node")).distinct().select("node", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("height")))
    top = sizes.agg(F.max("node").alias("m"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], "node long, parent long, height double, size long")
    fresh, done = top["m"] + 1, []
    left = top["n"]
    while left > 1:
        pair = F.struct(F.round("v", 12).alias("v"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        near = dist.groupBy("i").agg(F.min(pair).alias("p")).select("i", "p.*")
        both = near.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("v").alias("v")).where("k = 2")
        merged = keep_table(both.select("a", "b", "v", (F.row_number().over(Window.orderBy("v", "a")) - 1 + fresh).cast("long").alias("new")))  # at most half the clusters
        many = merged.count()
        where = merged.select(F.col("a").alias("node"), "new", "v").unionByName(merged.select(F.col("b").alias("node"), "new", "v"))
        done.append(sizes.join(where, "node").select("node", F.col("new").alias("parent"), "height", "size"))
        mapped = sizes.join(where, "node", "left").select("node", F.coalesce("new", "node").alias("to"), "size")
        left_, right_ = mapped.select(F.col("node").alias("i"), F.col("to").alias("ti"), F.col("size").alias("si")), mapped.select(F.col("node").alias("j"), F.col("to").alias("tj"), F.col("size").alias("sj"))
        w = F.col("si") * F.col("sj")
        moved = dist.join(left_, "i").join(right_, "j").where("ti <> tj").groupBy("ti", "tj").agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))
        grown = mapped.groupBy("to").agg(F.sum("size").alias("size")).join(merged.select(F.col("new").alias("to"), (F.col("v") / 2).alias("h")), "to", "left")
        old = sizes.select(F.col("node").alias("to"), F.col("height").alias("oh"))
        sizes = keep_table(grown.join(old, "to", "left").select(F.col("to").alias("node"), "size", F.coalesce("h", "oh").alias("height")))
        dist = keep_table(moved.select(F.col("ti").alias("i"), F.col("tj").alias("j"), "v"))
        done[-1] = keep_table(done[-1])
        fresh += many
        left -= many
        if not many:
            raise ValueError("the matrix is not complete: some clusters have no distance")
    tree = sizes.select("node", F.lit(None).cast("long").alias("parent"), "height", "size")
    for t in done:
        tree = tree.unionByName(t)
    return tree


def neighbor_joining(d: DataFrame) -> DataFrame:
    """Unrooted tree of a full distance matrix by neighbour joining: ``node, parent, length``; the last node has no parent.

    A round is one aggregate that finds the pair (ties to smaller numbers) and one that makes the distances to the new node;
    only the chosen pair reaches the driver. Rounds are as many as samples less three.
    """
    spark = d.sparkSession
    dist = keep_table(d.where("i <> j").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").alias("v")))
    names = [r["i"] for r in dist.select("i").distinct().orderBy("i").collect()]
    if len(names) < 3:
        raise ValueError("neighbour joining needs three samples")
    fresh, n, edges = names[-1] + 1, len(names), []
    while n > 3:
        r = dist.groupBy("i").agg(F.sum("v").alias("ri"))
        q = dist.where("i < j").join(r, "i").join(r.select(F.col("i").alias("j"), F.col("ri").alias("rj")), "j")
        best = q.agg(F.min(F.struct(F.round((n - 2) * F.col("v") - F.col("ri") - F.col("rj"), 10).alias("q"), "i", "j", "v", "ri", "rj")).alias("b")).first()["b"]
        a, b, v = best["i"], best["j"], best["v"]
        la = v / 2 + (best["ri"] - best["rj"]) / (2 * (n - 2))
        edges += [(a, fresh, la), (b, fresh, v - la)]
        near = dist.where(F.col("i").isin(a, b) & ~F.col("j").isin(a, b)).groupBy("j").agg(((F.sum("v") - v) / 2).alias("v"))
        rest = dist.where(~F.col("i").isin(a, b) & ~F.col("j").isin(a, b))
        to = near.select(F.lit(fresh).cast("long").alias("i"), "j", "v")
        dist = keep_table(rest.unionByName(to).unionByName(to.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).coalesce(4))
        fresh, n = fresh + 1, n - 1
    last = {(r["i"], r["j"]): r["v"] for r in dist.collect()}  # three nodes
    x, y, z = sorted({i for i, _ in last})
    edges += [(x, fresh, (last[x, y] + last[x, z] - last[y, z]) / 2), (y, fresh, (last[x, y] + last[y, z] - last[x, z]) / 2), (z, fresh, (last[x, z] + last[y, z] - last[x, y]) / 2), (fresh, None, 0.0)]
    return spark.createDataFrame(edges, "node long, parent long, length double")


def cut_tree(tree: DataFrame, height: float | None = None, groups: int | None = None) -> DataFrame:
    """``leaf, cluster``: the highest ancestor of each leaf at or below a height, or after the ``groups`` - 1 highest nodes are opened.

    Of nodes of one height those with larger numbers are opened first (parents have larger numbers than their children)."""
    if (height is None) == (groups is None):
        raise ValueError("give a height or a number of groups")
    inner = tree.where("height > 0")
    shut = inner.where(F.col("height") <= height) if groups is None else inner.join(inner.orderBy(F.desc("height"), F.desc("node")).limit(groups - 1).select("node"), "node", "left_anti")
    shut = keep_table(shut.select(F.col("node").alias("to"), F.col("parent").alias("next")))
    up = tree.select(F.col("node").alias("leaf"), F.col("node").alias("at"), "parent").where(F.col("height") == 0)
    while True:
        step = keep_table(up.join(shut, up["parent"] == shut["to"], "left").select("leaf", F.coalesce("to", "at").alias("at"), F.when(F.col("to").isNotNull(), F.col("next")).alias("parent"), F.col("to").isNotNull().alias("moved")))
        if not step.where("moved").head(1):
            return step.select("leaf", F.col("at").alias("cluster"))
        up = step.select("leaf", "at", "parent")


def clades(tree: DataFrame) -> DataFrame:
    """The sorted leaf set of each inner node, by repeated parent steps from the leaves."""
    up = tree.where("height = 0").select(F.col("node").alias("leaf"), F.col("parent").alias("at"))
    parents = tree.select(F.col("node").alias("at"), F.col("parent").alias("next"))
    found = []
    while up.where("at IS NOT NULL").head(1):
        found.append(up.where("at IS NOT NULL"))
        up = keep_table(up.where("at IS NOT NULL").join(parents, "at").select("leaf", F.col("next").alias("at")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(F.col("at").alias("node")).agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))


def robinson_foulds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the number of clades that only one of two trees over the same leaves has."""
    x, y = (clades(t).select("leaves").distinct() for t in (a, b))
    only = x.exceptAll(y).unionByName(y.exceptAll(x))
    return only.agg((F.count("*") / 2).alias("distance"))


def newick(tree: DataFrame, digits: int = 6) -> str:
    """The tree's text. A report: the tree's rows reach the driver."""
    rows = {r["node"]: r for r in tree.collect()}
    below: dict[int, list[int]] = {}
    for r in rows.values():
        if r["parent"] is not None:
            below.setdefault(r["parent"], []).append(r["node"])

    def text(root: int) -> str:
        out, stack = {}, [(root, False)]
        while stack:
            node, ready = stack.pop()
            if ready or node not in below:
                length = "" if rows[node]["parent"] is None else f":{rows[rows[node]['parent']]['height'] - rows[node]['height']:.{digits}f}"
                out[node] = (f"({','.join(out[c] for c in sorted(below[node]))})" if node in below else str(node)) + length
            else:
                stack.append((node, True))
                stack += [(c, False) for c in below[node]]
        return out[root]

    return text(next(r["node"] for r in rows.values() if r["parent"] is None)) + ";"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 40).alias("i"), (F.col("l_partkey") % 50).alias("j")).agg(F.sum("l_quantity").alias("value"))


def _distance(s: SparkSession, d: str) -> DataFrame:
    return full(ibs_matrix(fx.calls(s, d)).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("value")).alias("value")))


def _eigen_check(s: SparkSession, d: str) -> DataFrame:
    """Trace, sum of squares and share of the leading eigenvalues of the kinship matrix."""
    k = keep_table(full(kinship(fx.calls(s, d))))
    values, v = eigen(k, 3)
    # residual of the first pair: |K x - l x|^2
    x = v.where("c = 0").select(F.col("i").alias("j"), "x")
    image = k.join(x, "j").groupBy("i").agg(F.sum(F.col("value") * F.col("x")).alias("y")).join(v.where("c = 0").select("i", "x"), "i")
    res = image.agg(F.sum((F.col("y") - values[0] * F.col("x")) * (F.col("y") - values[0] * F.col("x"))).alias("r"))
    return k.where("i = j").agg(F.round(F.sum("value"), 6).alias("trace")).crossJoin(res.select((F.col("r") < 1e-6 * values[0] ** 2).alias("converged")))


def _svd_check(s: SparkSession, d: str) -> DataFrame:
    """Sum of squared cells, and whether the leading triples reproduce their part: u'Av = s for each."""
    a = keep_table(_cells(s, d).withColumn("value", F.col("value") / 100))
    values, u, v = svd(a, 2)
    r = a.join(u.withColumnRenamed("x", "u"), "i").join(v.select(F.col("i").alias("j"), "c", F.col("x").alias("v")), ["j", "c"])
    r = r.groupBy("c").agg(F.sum(F.col("u") * F.col("value") * F.col("v")).alias("s"))
    r = r.select(*[F.max(F.when(F.col("c") == c, F.abs(F.col("s") - x) < 1e-6 * values[0])).alias(f"right{c}") for c, x in enumerate(values)])
    return a.agg(F.round(F.sum(F.col("value") * F.col("value")), 4).alias("squares")).crossJoin(r)  # one row each


def _ridged(s: SparkSession, d: str) -> DataFrame:
    """Kinship with 0.5 added to the diagonal, less every seventh sample."""
    return kinship(fx.calls(s, d)).select("i", "j", (F.col("value") + F.when(F.col("i") == F.col("j"), 0.5).otherwise(0.0)).alias("value"))


def _inverse_check(s: SparkSession, d: str) -> DataFrame:
    """The inverse times the matrix, rounded: the identity over the samples left."""
    m = keep_table(_ridged(s, d))
    x, _ = symmetric_inverse(m, m.select(F.col("i").alias("taxon")).distinct().where("taxon % 7 = 0"))
    p = multiply(full(x), full(m.where("i % 7 <> 0 AND j % 7 <> 0")), 256)
    return p.select("i", "j", F.abs(F.round("value", 5)).alias("value"))


QUERIES = {
    "m10_double_centre": lambda s, d: double_centre(_distance(s, d)).select("i", "j", F.round("value", 6).alias("value")),
    "m10_classic_mds": lambda s, d: classic_mds(_distance(s, d), 2)[1],
    "m09_pca": lambda s, d: pca(fx.calls(s, d), 2)[1],
    "m11_eigen": _eigen_check,
    "m12_crossproduct": lambda s, d: crossproduct(_cells(s, d)).select("i", "j", F.round("value", 4).alias("value")),
    "m12_crossproduct_tiles": lambda s, d: crossproduct(_cells(s, d), tile=16).select("i", "j", F.round("value", 4).alias("value")),
    "m11_svd": _svd_check,
    "m13_symmetric_inverse": _inverse_check,
    "m12_row_sums": lambda s, d: axis_sums(_cells(s, d)).select("i", F.round("value", 4).alias("value")),
    "m19_upgma": lambda s, d: upgma(_distance(s, d)),
    "m19_neighbor_joining": lambda s, d: neighbor_joining(_distance(s, d)),
    "m20_cut_tree_groups": lambda s, d: cut_tree(upgma(_distance(s, d)), groups=5),
    "m20_cut_tree": lambda s, d: cut_tree(upgma(_distance(s, d)), 0.2),
}

_D = """d AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE value END AS value FROM (SELECT i, j, value FROM ibs UNION ALL SELECT j, i, value FROM ibs WHERE i <> j) x)"""
_C = "c AS (SELECT l_suppkey % 40 AS i, l_partkey % 50 AS j, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
ORACLES = {
    "m10_double_centre": f"""WITH {fx.CALLS}, {_ibs('calls')}, {_D}, s AS (SELECT i, j, -value * value / 2 AS v FROM d), r AS (SELECT i, avg(v) AS r FROM s GROUP BY i), t AS (SELECT avg(r) AS t FROM r)
SELECT s.i, s.j, round(v - a.r - b.r + t, 6) AS value FROM s JOIN r a ON s.i = a.i JOIN r b ON s.j = b.i, t""",
    "m11_eigen": f"WITH {fx.CALLS}, {_kin('calls', *_CEN)} SELECT round(sum(value), 6) AS trace, true AS converged FROM kin WHERE i = j",
    "m12_crossproduct": f"WITH {_C} SELECT a.j AS i, b.j AS j, round(sum(a.value * b.value), 4) AS value FROM c a JOIN c b ON a.i = b.i GROUP BY 1, 2",
    "m12_crossproduct_tiles": f"WITH {_C} SELECT a.j AS i, b.j AS j, round(sum(a.value * b.value), 4) AS value FROM c a JOIN c b ON a.i = b.i GROUP BY 1, 2",
    "m11_svd": f"WITH {_C} SELECT round(sum(value / 100 * value / 100), 4) AS squares, true AS right0, true AS right1 FROM c",
    "m13_symmetric_inverse": f"WITH {fx.CALLS}, t AS (SELECT DISTINCT taxon FROM calls WHERE taxon % 7 <> 0) SELECT a.taxon AS i, b.taxon AS j, CAST(a.taxon = b.taxon AS DOUBLE) AS value FROM t a, t b",
    "m12_row_sums": f"WITH {_C} SELECT i, round(sum(value), 4) AS value FROM c GROUP BY i",
}
