"""Exact tests of contingency tables of any size (M15), as a network over margins; Monte Carlo tests that stop early.

Columns are placed one after another, down to the last two. A node is what is left of the row totals, sorted, since equal leftovers in
another order have the same ways on; its paths are grouped by the sum of ln n! of the cells placed so far, rounded to 1e-9, with
their number. A stage is one expansion of all nodes in tasks and one aggregate, so nodes are spread over the cluster. The last two
columns of a node leave no further choice than the ways to fill one of them: these are summed where they are made, in blocks, by all
paths of the node at once, and not written. Ways of one node are dealt to tasks by ranges of their first cell. The p
value sums the probability of all tables that are no likelier than the table at hand.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.relationship import _rounded
from locusframe.plans import fixture as fx
from locusframe.plans.tables import keep_table

#: Relative gap below which two probabilities count as equal.
TIE = 1e-7


#: Ways in an array at a time, and about how many a task gets in one piece of a node.
BLOCK, PIECE = 1 << 18, 1 << 20


def ways(left: np.ndarray, total: int, first: tuple[int, int] | None = None) -> np.ndarray:
    """All ways to take ``total`` from the leftovers, a row for each; with ``first`` those whose first number is within it."""
    after = np.concatenate((np.cumsum(left[::-1])[::-1][1:], [0]))
    rows, rest = np.zeros((1, 0), np.int64), np.array([total], np.int64)
    for i, (cap, later) in enumerate(zip(left, after, strict=True)):
        low, high = np.maximum(0, rest - later), np.minimum(cap, rest)
        if first and not i:
            low, high = np.maximum(low, first[0]), np.minimum(high, first[1])
        many = np.maximum(high - low + 1, 0)
        at = np.repeat(np.arange(len(rest)), many)
        value = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        rows, rest = np.column_stack([rows[at], value]), rest[at] - value
    return rows


def _first_cell(left: np.ndarray, total: int) -> tuple[int, int, int]:
    """Least and greatest first number of the ways, and a bound of the ways of each."""
    return max(0, total - int(left[1:].sum())), min(int(left[0]), total), math.prod(min(int(x), total) + 1 for x in left[1:-1])


def blocks(left: np.ndarray, total: int, low: int, high: int, most: int = BLOCK) -> Iterator[np.ndarray]:
    """The ways whose first number is from ``low`` to ``high``, in arrays of at most ``most`` rows."""
    each = _first_cell(left, total)[2]
    if each <= most:
        step = most // each
        for a in range(low, high + 1, step):
            yield ways(left, total, (a, min(high, a + step - 1)))
        return
    for a in range(low, high + 1):
        under, over, _ = _first_cell(left[1:], total - a)
        for part in blocks(left[1:], total - a, under, over, most):
            yield np.column_stack([np.full(len(part), a), part])


@functools.cache
def _small_log_factorials() -> np.ndarray:
    return np.array([math.lgamma(i + 1) for i in range(1 << 16)])


def log_factorials(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers."""
    table = _small_log_factorials()
    return table[n] if not len(n) or n.max() < len(table) else np.fromiter(map(math.lgamma, (n + 1.0).tolist()), float, len(n))


def last_columns(left: np.ndarray, total: int, low: int, high: int, limits: np.ndarray) -> tuple[int, np.ndarray]:
    """Of the ways to take ``total`` from the leftovers (first number from ``low`` to ``high``): their number, and for each of ``limits`` the
    sum of exp(limit - cost) over those that cost at least that limit; the cost is the sum of ln n! of what is taken and what stays."""
    whole, count, sums = int(left.sum()), 0, np.zeros(len(limits))
    floor = [max(0, total - (whole - int(x))) for x in left]
    floor[0] = max(floor[0], low)
    if len(left) == 2:  # the second number goes with the first
        floor[1] = max(floor[1], total - high)
    top = [min(int(x), total - (low if i else 0)) for i, x in enumerate(left)]
    top[0] = min(top[0], high)
    costs = []
    for x, a, b in zip(left, floor, top, strict=True):
        k = np.arange(a, max(a, b + 1))
        costs.append(log_factorials(k) + log_factorials(x - k))
    for part in blocks(left, total, low, high):
        if not len(part):
            continue
        count += len(part)
        cost = sum(c[part[:, i] - a] for i, (c, a) in enumerate(zip(costs, floor, strict=True)))
        if len(limits) < 5:
            for i, t in enumerate(limits):
                sums[i] += np.exp(t - cost[cost >= t]).sum()
            continue
        cost = np.sort(cost)
        tail = np.append(np.logaddexp.accumulate(-cost[::-1])[::-1], -np.inf)  # logarithms of the sums from each place to the end
        sums += np.exp(limits + tail[np.searchsorted(cost, limits)])
    return count, sums


def _tables(rows: DataFrame, r: str, c: str, by: list[str]) -> DataFrame:
    """Of each group: sorted totals of both sides, the shorter one as ``rows``, the number of cases and the sum of ln n! of its cells."""
    cells = rows.where(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(*by, r, c).agg(F.count("*").alias("n"))
    return _tables_of(keep_table(cells), r, c, by)  # the rows are read once


def _tables_of(cells: DataFrame, r: str, c: str, by: list[str]) -> DataFrame:
    cells = cells.where("n > 0")
    lg = log_factorial()
    side = lambda k, name: cells.groupBy(*by, k).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sort_array(F.collect_list("n")).alias(name))  # noqa: E731  a number for each level
    own = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(lg(F.col("n"))).alias("own"))
    a, b = side(r, "a"), side(c, "b")
    both = own.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)) if not by else own.join(a, by).join(b, by)  # without groups: one row each
    short = F.size("a") <= F.size("b")
    return both.select(*by, "n", "own", F.when(short, F.col("a")).otherwise(F.col("b")).alias("rows"), F.when(short, F.col("b")).otherwise(F.col("a")).alias("columns"))


def log_factorial():
    @F.pandas_udf("double")
    def lf(n: pd.Series) -> pd.Series:
        return n.map(lambda x: math.lgamma(x + 1))

    return lf


def exact_test(rows: DataFrame, r: str, c: str, by: list[str] | None = None, counted: str | None = None) -> DataFrame:
    """``by, n, tables, point, p``: the exact test of each group's table of two columns, of any number of levels.

    ``tables`` is the number of tables with its margins, ``point`` the probability of the one at hand. With ``counted`` the rows are cells with
    that column as their number. Nulls are left out; a group without cases has no row. The work grows with the number of different leftovers.
    """
    by = by or []
    if counted:
        cells = rows.where(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(*by, r, c).agg(F.sum(counted).cast("long").alias("n"))
        tables = keep_table(_tables_of(cells, r, c, by).withColumn("_g", F.monotonically_increasing_id()))
    else:
        tables = keep_table(_tables(rows, r, c, by).withColumn("_g", F.monotonically_increasing_id()))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few rows, much work: one task for each core at least
    steps = (tables.agg(F.max(F.size("columns"))).first()[0] or 0) - 2
    # the largest columns first: fewest ways are left open
    order = tables.select("_g", F.reverse("columns").alias("columns"))
    nodes = keep_table(tables.select("_g", F.col("rows").alias("left"), F.lit(0).cast("long").alias("past"), F.lit(1.0).alias("many")))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, left, past, many, total in zip(batch["_g"], batch["left"], batch["past"], batch["many"], batch["total"], strict=True):
                left = np.asarray(left, np.int64)
                for part in blocks(left, int(total), *_first_cell(left, int(total))[:2]):
                    state = np.sort(left - part, axis=1)
                    cost = past + np.rint(log_factorials(part.ravel()).reshape(part.shape).sum(1) * 1e9).astype(np.int64)
                    key, at = np.unique(np.column_stack([state, cost]), axis=0, return_inverse=True)
                    number = np.bincount(at.ravel(), minlength=len(key)) * many
                    yield pd.DataFrame({"_g": g, "left": list(key[:, :-1]), "past": key[:, -1], "many": number})

    for k in range(steps):
        now = nodes.join(order, "_g")
        open_ = F.size("columns") > k + 2
        done = now.where(~open_).select("_g", "left", "past", "many")
        ahead = now.where(open_).select("_g", "left", "past", "many", F.get("columns", F.lit(k)).alias("total")).repartition(tasks)
        ahead = ahead.mapInPandas(expand, "_g long, left array<long>, past long, many double")
        nodes = keep_table(done.unionByName(ahead).groupBy("_g", "left", "past").agg(F.sum("many").alias("many")))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ranges of the first cell of each node, of some PIECE ways each at most."""
        for batch in batches:
            at, low, high = [], [], []
            for i, (left, total) in enumerate(zip(batch["left"], batch["total"], strict=True)):
                a, b, each = _first_cell(np.asarray(left, np.int64), int(total))
                for x in range(a, b + 1, max(1, PIECE // each)):
                    at.append(i)
                    low.append(x)
                    high.append(min(b, x + max(1, PIECE // each) - 1))
                    if len(at) == 10_000:
                        yield batch.iloc[at].assign(low=low, high=high)
                        at, low, high = [], [], []
            if at:
                yield batch.iloc[at].assign(low=low, high=high)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [tuple(x) for x in batch["left"]]
            key = list(zip(batch["_g"], left, batch["low"], strict=True))
            edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    r, many = batch.iloc[a], batch["many"].to_numpy()[a:b]
                    limits = r["own"] - TIE - batch["past"].to_numpy()[a:b] / 1e9
                    count, sums = last_columns(np.array(left[a], np.int64), int(r["total"]), int(r["low"]), int(r["high"]), limits)
                    yield pd.DataFrame({"_g": [r["_g"]], "tables": [count * many.sum()], "extreme": [float(many @ sums)]})

    last = order.join(tables.select("_g", "own"), "_g").select("_g", "own", F.get("columns", F.greatest(F.size("columns") - 2, F.lit(0))).alias("total"))
    kind = "_g long, left array<long>, past long, many double, own double, total long"
    ways_on = nodes.join(last, "_g").select("_g", "left", "past", "many", "own", "total").mapInPandas(pieces, kind + ", low long, high long")
    sums = ways_on.repartition(tasks, "_g", "left", "low").sortWithinPartitions("_g", "left", "low", "past").mapInPandas(finish, "_g long, tables double, extreme double")
    lg = log_factorial()
    margins = tables.select("_g", "n", F.explode(F.concat("rows", "columns")).alias("m")).groupBy("_g", "n").agg(F.sum(lg(F.col("m"))).alias("fixed"))
    margins = margins.select("_g", (F.col("fixed") - lg(F.col("n"))).alias("fixed"))
    found = sums.groupBy("_g").agg(F.sum("tables").alias("tables"), F.sum("extreme").alias("extreme"))
    ends = tables.select("_g", *by, "n", "own").join(margins, "_g").join(found, "_g").withColumn("point", F.exp(F.col("fixed") - F.col("own")))
    # what is as likely as the table at hand has this limit, whatever its path
    return ends.select(*by, "n", "tables", "point", F.least(F.lit(1.0), F.col("point") * math.exp(TIE) * F.col("extreme")).alias("p"))


def sequential_test(rows: DataFrame, r: str, c: str, most: int = 100_000, hits: int = 10, first: int = 200, exact: bool = False, seed: int = 1) -> DataFrame:
    """``p, n, draws``: Monte Carlo test of one table that stops at the draw that is the ``hits``-th to reach it.

    Draws with its margins come in rounds of doubling size, each draw from a generator of its own, so the result doesn't depend on partitions.
    p is ``hits`` over the draws made, or the share that reached it of all ``most`` draws. A draw reaches it by its chi-square, or with
    ``exact`` by being no likelier. Margins (a number for each level) reach the driver. An empty table gives a null p.
    """
    spark = rows.sparkSession
    cells = keep_table(rows.where(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(r, c).agg(F.count("*").alias("n")))
    side = lambda k: np.array([x["n"] for x in cells.groupBy(k).agg(F.sum("n").alias("n")).orderBy(k).collect()], np.int64)
    up, across = side(r), side(c)
    total = int(up.sum())
    if not total:
        return spark.createDataFrame([(None, 0, 0)], "p double, n long, draws long")
    expected = np.outer(up, across) / total
    table = np.array([math.lgamma(i + 1) for i in range(int(min(up.max(), across.max())) + 1)])
    if exact:
        observed = cells.agg(F.sum(log_factorial()(F.col("n"))).alias("x")).first()["x"] - TIE
    else:
        e = F.col("rn") * F.col("cn") / total
        q = cells.join(cells.groupBy(r).agg(F.sum("n").alias("rn")), r).join(cells.groupBy(c).agg(F.sum("n").alias("cn")), c)
        observed = q.agg((F.sum((F.col("n") - e) * (F.col("n") - e) / e) + total - F.sum(e)).alias("x")).first()["x"] * (1 - 1e-9)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reached = []
            for k in b["id"]:
                rng, left, t = np.random.default_rng([seed, int(k)]), across.copy(), np.zeros((len(up), len(across)), np.int64)
                for i, m in enumerate(up[:-1]):
                    t[i] = rng.multivariate_hypergeometric(left, m, method="marginals")
                    left = left - t[i]
                t[-1] = left
                if (table[t].sum() if exact else ((t - expected) ** 2 / expected).sum()) >= observed:
                    reached.append(int(k))
            yield pd.DataFrame({"id": np.array(reached, np.int64)})

    made, seen, size = 0, 0, first
    while made < most:
        size = min(size, most - made)
        found = sorted(x["id"] for x in spark.range(made, made + size).mapInPandas(draw, "id long").orderBy("id").limit(hits - seen).collect())  # at most ``hits``
        if seen + len(found) >= hits:
            draws = found[hits - seen - 1] + 1
            return spark.createDataFrame([(hits / draws, total, draws)], "p double, n long, draws long")
        seen, made, size = seen + len(found), made + size, 2 * size
    return spark.createDataFrame([(seen / made, total, made)], "p double, n long, draws long")


def _two_by_two(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").select((F.col("o_custkey") % 25).alias("g"), (F.col("o_orderstatus") == "F").alias("f"), (F.col("o_totalprice") > 150000).alias("h"))
    return _rounded(exact_test(o, "f", "h", ["g"]), "point", "p").withColumn("tables", F.col("tables").cast("long"))


def _wide(s: SparkSession, d: str) -> DataFrame:
    c = fx.table(s, d, "supplier").select((F.col("s_suppkey") % 3).alias("r"), F.when(F.col("s_nationkey") < 9, 0).when(F.col("s_nationkey") < 16, 1).otherwise(2).alias("c")).groupBy("r", "c").agg(F.count("*").alias("n"))
    return _rounded(exact_test(c.withColumn("n", F.ceil(F.sqrt("n"))), "r", "c", counted="n"), "point", "p").withColumn("tables", F.col("tables").cast("long"))


QUERIES = {"m15_exact_two_by_two": _two_by_two, "m15_exact_three_by_three": _wide}

_F = "lgamma(CAST({} + 1 AS DOUBLE))"
ORACLES = {
    "m15_exact_two_by_two": f"""WITH t AS (SELECT o_custkey % 25 AS g, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 150000) AS a, count(*) FILTER (WHERE o_orderstatus = 'F' AND NOT o_totalprice > 150000) AS b,
 count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice > 150000) AS c, count(*) FILTER (WHERE o_orderstatus <> 'F' AND NOT o_totalprice > 150000) AS d FROM orders GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM t),
p AS (SELECT *, exp({_F.format('a+b')} + {_F.format('c+d')} + {_F.format('a+c')} + {_F.format('b+d')} - {_F.format('a+b+c+d')} - {_F.format('i')} - {_F.format('a+b-i')} - {_F.format('a+c-i')} - {_F.format('d-a+i')}) AS p FROM k),
q AS (SELECT *, max(CASE WHEN i = a THEN p END) OVER (PARTITION BY g) AS po FROM p)
SELECT g, a + b + c + d AS n, count(*) AS tables, round(max(po), 6) AS point, round(least(1.0, sum(CASE WHEN p <= po * 1.0000001 THEN p ELSE 0 END)), 6) AS p FROM q GROUP BY g, a, b, c, d""",
    "m15_exact_three_by_three": f"""WITH x AS (SELECT s_suppkey % 3 AS r, CASE WHEN s_nationkey < 9 THEN 0 WHEN s_nationkey < 16 THEN 1 ELSE 2 END AS c, CAST(ceil(sqrt(count(*))) AS BIGINT) AS n FROM supplier GROUP BY 1, 2),
m AS (SELECT sum(n)::BIGINT AS n, sum(CASE WHEN r = 0 THEN n ELSE 0 END)::BIGINT AS r0, sum(CASE WHEN r = 1 THEN n ELSE 0 END)::BIGINT AS r1, sum(CASE WHEN r = 2 THEN n ELSE 0 END)::BIGINT AS r2,
 sum(CASE WHEN c = 0 THEN n ELSE 0 END)::BIGINT AS c0, sum(CASE WHEN c = 1 THEN n ELSE 0 END)::BIGINT AS c1, sum(CASE WHEN c = 2 THEN n ELSE 0 END)::BIGINT AS c2, sum({_F.format('n')}) AS own FROM x),
a AS (SELECT *, unnest(range(0, least(r0, c0) + 1)) AS t00 FROM m), b AS (SELECT *, unnest(range(0, least(r0 - t00, c1) + 1)) AS t01 FROM a), c AS (SELECT *, unnest(range(0, least(r1, c0 - t00) + 1)) AS t10 FROM b),
d AS (SELECT *, unnest(range(0, least(r1 - t10, c1 - t01) + 1)) AS t11 FROM c),
e AS (SELECT *, r0 - t00 - t01 AS t02, r1 - t10 - t11 AS t12, c0 - t00 - t10 AS t20, c1 - t01 - t11 AS t21, c2 - (r0 - t00 - t01) - (r1 - t10 - t11) AS t22 FROM d),
f AS (SELECT *, {' + '.join(_F.format(f't{i}{j}') for i in range(3) for j in range(3))} AS s, {' + '.join(_F.format(x) for x in ('r0', 'r1', 'r2', 'c0', 'c1', 'c2'))} - {_F.format('n')} AS fixed FROM e WHERE t02 >= 0 AND t12 >= 0 AND t22 >= 0 AND t20 >= 0 AND t21 >= 0)
SELECT n, count(*) AS tables, round(max(exp(fixed - own)), 6) AS point, round(least(1.0, sum(CASE WHEN s >= own - 1e-7 THEN exp(fixed - s) ELSE 0 END)), 6) AS p FROM f GROUP BY n""",
}
