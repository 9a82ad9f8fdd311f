"""Rooted trees as edge tables: depths, clades, ancestors, distances, splits and rerooting.

A tree has rows ``node, parent, length`` (the root's parent is null, its length not used). Nothing walks the tree node by
node: steps to the 1st, 2nd, 4th, ... ancestor are found by doubling, and what is below a node is summed along
the same steps (what is less than 2^k steps below, then the same of the nodes exactly 2^k below), so a tree of height h takes
log2(h) joins, chains included. A leaf set is named by the exclusive or of its leaves' 128-bit hashes, so clades and splits of trees
of any size compare by equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.plans import fixture as fx
from locusframe.plans.tables import keep_table


@dataclass
class Lifted:
    """A tree with its steps: ``steps[k]`` has ``node, up`` (2^k-th ancestor), for the nodes that have one."""

    tree: DataFrame
    steps: list[DataFrame]
    facts: DataFrame


def lifted(tree: DataFrame) -> Lifted:
    """Steps of a tree, and ``facts``: ``node, parent, length, depth`` (edges to the root), ``reach`` (length to the root), ``n_leaves, h1, h2``
    (the clade's name), ``n_below`` (nodes, itself included), ``below`` (edge length below it). Null lengths are 0."""
    base = tree.select("node", "parent", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"))
    inner = base.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    leaf = F.col("_inner").isNull()
    text = F.col("node").cast("string")
    name = lambda seed: F.when(leaf, F.xxhash64(F.lit(seed), text)).otherwise(F.lit(0).cast("long"))
    rooted = F.col("parent").isNull()
    state = keep_table(base.join(inner, "node", "left").select(
        "node", "parent", "length", F.col("parent").alias("up"), F.when(rooted, 0).otherwise(1).cast("long").alias("depth"), F.when(rooted, 0.0).otherwise(F.col("length")).alias("reach"),
        leaf.cast("long").alias("n_leaves"), name(1).alias("h1"), name(2).alias("h2"), F.lit(1).cast("long").alias("n_below"), F.lit(0.0).alias("below"), F.when(rooted, 0.0).otherwise(F.col("length")).alias("edges"),
    ))
    steps = []
    while state.where("up IS NOT NULL").head(1):
        if len(steps) > 60:
            raise ValueError("the edges have a cycle")
        steps.append(state.where("up IS NOT NULL").select("node", "up"))
        low = state.where("up IS NOT NULL").groupBy("up").agg(
            F.sum("n_leaves").alias("a_leaves"), F.bit_xor("h1").alias("a1"), F.bit_xor("h2").alias("a2"), F.sum("n_below").alias("a_below"), F.sum("edges").alias("a_edges"),
        )
        far = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("reach").alias("r"))
        now = state.join(far, "up", "left").join(low.withColumnRenamed("up", "node"), "node", "left")
        plus = lambda c, a: (F.col(c) + F.coalesce(F.col(a), F.lit(0))).alias(c)
        state = keep_table(now.select(
            "node", "parent", "length", F.col("next").alias("up"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), (F.col("reach") + F.coalesce("r", F.lit(0.0))).alias("reach"),
            plus("n_leaves", "a_leaves"), F.col("h1").bitwiseXOR(F.coalesce("a1", F.lit(0).cast("long"))).alias("h1"), F.col("h2").bitwiseXOR(F.coalesce("a2", F.lit(0).cast("long"))).alias("h2"),
            plus("n_below", "a_below"), F.lit(0.0).alias("below"), plus("edges", "a_edges"),
        ))
    facts = state.withColumn("below", F.col("edges") - F.when(F.col("parent").isNull(), 0.0).otherwise(F.col("length"))).drop("up", "edges")
    return Lifted(base, steps, facts)


def common_ancestors(t: Lifted, pairs: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with ``ancestor``, their deepest common one. The deeper node is lifted to the other's depth, then both as long as they differ."""
    d = t.facts.select("node", "depth")
    p = pairs.select("a", "b").distinct().join(d.select(F.col("node").alias("a"), F.col("depth").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("depth").alias("db")), "b")
    p = p.select("a", "b", F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("da") - F.col("db")).alias("gap"))
    for k in range(len(t.steps) - 1, -1, -1):
        p = p.join(t.steps[k].select(F.col("node").alias("x"), "up"), "x", "left")
        p = keep_table(p.select("a", "b", F.when(F.col("gap").bitwiseAND(F.lit(1 << k)) != 0, F.col("up")).otherwise(F.col("x")).alias("x"), "y", "gap"))
    for k in range(len(t.steps) - 1, -1, -1):
        s = t.steps[k]
        p = p.join(s.select(F.col("node").alias("x"), F.col("up").alias("ux")), "x", "left").join(s.select(F.col("node").alias("y"), F.col("up").alias("uy")), "y", "left")
        go = F.col("ux").isNotNull() & (F.col("x") != F.col("y")) & (F.col("ux") != F.col("uy"))
        p = keep_table(p.select("a", "b", F.when(go, F.col("ux")).otherwise(F.col("x")).alias("x"), F.when(go, F.col("uy")).otherwise(F.col("y")).alias("y")))
    up = t.tree.select(F.col("node").alias("x"), "parent")
    return p.join(up, "x").select("a", "b", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("parent")).alias("ancestor"))


def path_lengths(t: Lifted, pairs: DataFrame) -> DataFrame:
    """``a, b, ancestor, edges, distance`` along the tree."""
    f = t.facts.select("node", "depth", "reach")
    p = common_ancestors(t, pairs)
    for c in ("a", "b", "ancestor"):
        p = p.join(f.select(F.col("node").alias(c), F.col("depth").alias(f"d_{c}"), F.col("reach").alias(f"r_{c}")), c)
    return p.select("a", "b", "ancestor", (F.col("d_a") + F.col("d_b") - 2 * F.col("d_ancestor")).alias("edges"), (F.col("r_a") + F.col("r_b") - 2 * F.col("r_ancestor")).alias("distance"))


def splits(t: Lifted, trivial: bool = False) -> DataFrame:
    """``s1, s2, size, length``: the two-part divisions of the leaves that edges make, named alike from either side, each once (lengths of the root's two
    edges add up). Without ``trivial`` those that cut off one leaf or none are left out."""
    total = t.facts.where("parent IS NULL").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"), F.sum("n_leaves").alias("all"))
    e = t.facts.where("parent IS NOT NULL AND n_leaves > 0").crossJoin(F.broadcast(total))  # one row
    o1, o2 = F.col("h1").bitwiseXOR(F.col("t1")), F.col("h2").bitwiseXOR(F.col("t2"))
    own = (F.col("h1") < o1) | ((F.col("h1") == o1) & (F.col("h2") <= o2))
    named = e.select(F.when(own, F.col("h1")).otherwise(o1).alias("s1"), F.when(own, F.col("h2")).otherwise(o2).alias("s2"), F.least("n_leaves", F.col("all") - F.col("n_leaves")).alias("size"), "length")
    named = named if trivial else named.where("size > 1")
    return named.groupBy("s1", "s2").agg(F.min("size").alias("size"), F.sum("length").alias("length"))


def clades(t: Lifted) -> DataFrame:
    """``node, n_leaves, h1, h2`` of the inner nodes: equal names are equal leaf sets."""
    return t.facts.where("n_below > 1").select("node", "n_leaves", "h1", "h2")


def compare(a: Lifted, b: Lifted) -> DataFrame:
    """One row: splits of each tree over the same leaves and of both, Robinson-Foulds ``distance`` (half of those that only one has), ``rescaled`` by its
    largest value (leaves - 3; null below four leaves), and the ``branch_score``: the root of the sum of squared differences of lengths over all splits."""
    x, y = splits(a), splits(b)
    same = x.join(y.select("s1", "s2"), ["s1", "s2"]).agg(F.count("*").alias("shared"))
    every = splits(a, True).select("s1", "s2", F.col("length").alias("x")).join(splits(b, True).select("s1", "s2", F.col("length").alias("y")), ["s1", "s2"], "full_outer")
    score = every.agg(F.sqrt(F.sum((F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) ** 2)).alias("branch_score"))
    leaves = a.facts.where("parent IS NULL").agg(F.sum("n_leaves").alias("leaves"))
    one = x.agg(F.count("*").alias("n_a")).crossJoin(y.agg(F.count("*").alias("n_b"))).crossJoin(same).crossJoin(score).crossJoin(leaves)  # one row each
    distance = (F.col("n_a") + F.col("n_b") - 2 * F.col("shared")) / 2
    return one.select("leaves", "n_a", "n_b", "shared", distance.alias("distance"), F.when(F.col("leaves") > 3, distance / (F.col("leaves") - 3)).alias("rescaled"), "branch_score")


def ancestors(t: Lifted, node) -> DataFrame:
    """All ancestors of one node, itself included, as ``node``: its first 2^k found in k joins."""
    found = t.tree.where(F.col("node") == F.lit(node)).select("node")
    for s in t.steps:
        found = keep_table(found.unionByName(found.join(s, "node").select(F.col("up").alias("node"))).distinct())
    return found


def reroot(t: Lifted, node, share: float = 0.5, name=None) -> DataFrame:
    """The tree with its root on the edge above ``node``, ``share`` of that edge on the node's side: a new node ``name`` (default: one more than the largest) is the
    root. Edges between the old root and there turn round; an old root left with one edge below it goes, and its edges become one."""
    edge = t.tree.where(F.col("node") == F.lit(node)).first()
    if edge is None or edge["parent"] is None:
        return t.tree
    name = t.tree.agg(F.max("node")).first()[0] + 1 if name is None else name
    kind = dict(t.tree.dtypes)["node"]
    path = ancestors(t, node).where(F.col("node") != F.lit(node)).withColumn("_on", F.lit(True))  # nodes whose edges turn round
    spark = t.tree.sparkSession
    turned = t.tree.join(path, "node").where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.col("node").alias("parent"), "length")
    rest = t.tree.join(path, "node", "left_anti").where(F.col("node") != F.lit(node))
    top = spark.createDataFrame([(name, None, 0.0), (node, name, edge["length"] * share), (edge["parent"], name, edge["length"] * (1 - share))], f"node {kind}, parent {kind}, length double")
    whole = keep_table(top.unionByName(turned).unionByName(rest))
    old = t.tree.where("parent IS NULL").first()["node"]
    below = whole.where(F.col("parent") == F.lit(old)).limit(2).collect()
    if len(below) != 1:
        return whole
    own = whole.where(F.col("node") == F.lit(old)).first()
    only = F.col("node") == F.lit(below[0]["node"])
    kept = whole.where(F.col("node") != F.lit(old))
    return kept.select("node", F.when(only, F.lit(own["parent"]).cast(kind)).otherwise(F.col("parent")).alias("parent"), F.when(only, F.col("length") + own["length"]).otherwise(F.col("length")).alias("length"))


def farthest(t: Lifted, start) -> tuple:
    """The leaf farthest from ``start`` along the tree, the smallest of equals, and its distance. Distances come from the common ancestors with one node, which are on its own path."""
    on = t.facts.join(ancestors(t, start), "node").select("node", "depth", "reach")
    near = t.facts.where(F.col("node") == F.lit(start)).first()["reach"]
    # the deepest ancestor-or-self on the path: carried down by doubling steps towards it
    state = t.tree.select("node", "parent").join(on.select("node", F.lit(True).alias("hit")), "node", "left")
    state = keep_table(state.select("node", F.when(F.col("hit"), F.col("node")).otherwise(F.col("parent")).alias("at")))
    for _ in t.steps:
        step = state.select(F.col("node").alias("at"), F.col("at").alias("next"))
        state = keep_table(state.join(step, "at").select("node", F.col("next").alias("at")))
    leaves = t.facts.where("n_below = 1").select("node", "reach").join(state, "node").join(on.select(F.col("node").alias("at"), F.col("reach").alias("top")), "at")
    d = leaves.select("node", (F.col("reach") + F.lit(near) - 2 * F.col("top")).alias("distance"))
    best = d.agg(F.max_by(F.struct("node", "distance"), F.struct(F.round("distance", 9), -F.col("node"))).alias("b")).first()["b"]
    return best["node"], best["distance"]


def midpoint(t: Lifted) -> tuple:
    """Where the middle of the longest path between leaves lies: the node below that edge and the share of the edge on its side, with both leaves and their distance."""
    first = t.facts.where("n_below = 1").agg(F.min("node")).first()[0]
    a, _ = farthest(t, first)
    b, length = farthest(t, a)
    top = {r["node"]: r["reach"] for r in t.facts.where(F.col("node").isin(a, b)).select("node", "reach").collect()}
    deep = a if top[a] >= top[b] else b
    want = top[deep] - length / 2  # the middle lies on the path of the deeper leaf at this distance from the root
    path = t.facts.join(ancestors(t, deep), "node").where((F.col("parent").isNotNull()) & (F.col("reach") - F.col("length") <= want + 1e-12) & (F.col("reach") >= want - 1e-12))
    edge = path.orderBy(F.desc("depth")).select("node", "length", "reach").first()
    share = (edge["reach"] - want) / edge["length"] if edge["length"] else 0.5
    return edge["node"], min(1.0, max(0.0, share)), a, b, length


def midpoint_root(t: Lifted) -> DataFrame:
    """The tree with its root in the middle of the longest path between leaves."""
    node, share, *_ = midpoint(t)
    return reroot(t, node, share)


def _tree(s: SparkSession, d: str) -> DataFrame:
    c, k = fx.table(s, d, "customer"), F.col("c_custkey")
    parent = F.when(k == 1, F.lit(None)).when(k % 7 == 2, k - 1).otherwise(F.floor(k / 2))
    return c.where(k > 0).select(k.alias("node"), parent.cast("long").alias("parent"), (1 + k * 37 % 11).cast("double").alias("length"))


def _tips(s: SparkSession, d: str, plain: bool) -> DataFrame:
    """Customers as tips (minus their key) of the inner nodes of ``_tree``, or of a plain binary tree with half as many."""
    c, k = fx.table(s, d, "customer").where("c_custkey > 0"), F.col("c_custkey")
    low = F.greatest(F.floor(k / 2), F.lit(1)).cast("long")
    tips = c.select((-k).alias("node"), (low if plain else k).alias("parent"), F.lit(1.0).alias("length"))
    inner = _tree(s, d)
    if plain:
        inner = c.select(low.alias("node")).distinct().select("node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("long")).alias("parent"), F.lit(1.0).alias("length"))
    return inner.unionByName(tips)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").where("o_orderkey % 5 = 1")
    n = fx.table(s, d, "customer").agg(F.max("c_custkey").alias("n"))
    return o.crossJoin(F.broadcast(n)).select((1 + F.col("o_orderkey") * 31 % F.col("n")).alias("a"), (1 + F.col("o_orderkey") * 17 % F.col("n")).alias("b"))  # one row


QUERIES = {
    "m21_tree_depths": lambda s, d: lifted(_tree(s, d)).facts.select("node", "depth", "reach", "n_leaves", "n_below", "below"),
    "m21_path_lengths": lambda s, d: path_lengths(lifted(_tree(s, d)), _pairs(s, d)),
    "m21_compare_trees": lambda s, d: compare(lifted(_tips(s, d, False)), lifted(_tips(s, d, True))).select("leaves", "n_a", "n_b", "shared", "distance", F.round("rescaled", 8).alias("rescaled")),
    "m21_reroot": lambda s, d: lifted(reroot(lifted(_tree(s, d)), 37)).facts.where("n_below = 1").select("node", "reach"),
}

_T = """n AS (SELECT c_custkey AS node, CASE WHEN c_custkey = 1 THEN NULL WHEN c_custkey % 7 = 2 THEN c_custkey - 1 ELSE c_custkey // 2 END AS parent, CAST(1 + c_custkey * 37 % 11 AS DOUBLE) AS length FROM customer WHERE c_custkey > 0)"""
_UP = "up AS (SELECT node AS x, node AS at_, parent, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS r FROM n UNION ALL SELECT x, n.node, n.parent, k + 1, r + m.length FROM up JOIN n m ON m.node = up.at_ JOIN n ON n.node = up.parent)"
_LEAF = "SELECT node FROM {n} WHERE node NOT IN (SELECT parent FROM {n} WHERE parent IS NOT NULL)"
ORACLES = {
    "m21_tree_depths": f"""WITH RECURSIVE {_T}, {_UP}, lf AS ({_LEAF.format(n='n')}), d AS (SELECT x, max(k) AS depth, max(r) AS reach FROM up GROUP BY x),
b AS (SELECT at_ AS node, count(*) AS n_below, count(lf.node) AS n_leaves, sum(CASE WHEN up.x <> at_ THEN n.length ELSE 0 END) AS below FROM up JOIN n ON n.node = up.x LEFT JOIN lf ON lf.node = up.x GROUP BY at_)
SELECT node, depth, reach, n_leaves, n_below, below FROM d JOIN b ON d.x = b.node""",
    "m21_path_lengths": f"""WITH RECURSIVE {_T}, {_UP}, p AS (SELECT DISTINCT 1 + o_orderkey * 31 % (SELECT max(c_custkey) FROM customer) AS a, 1 + o_orderkey * 17 % (SELECT max(c_custkey) FROM customer) AS b FROM orders WHERE o_orderkey % 5 = 1)
SELECT a, b, u.at_ AS ancestor, u.k + v.k AS edges, u.r + v.r AS distance FROM p JOIN up u ON u.x = a JOIN up v ON v.x = b AND v.at_ = u.at_ QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY u.k) = 1""",
    "m21_compare_trees": f"""WITH RECURSIVE {_T.replace("n AS", "a0 AS", 1)},
n AS MATERIALIZED (SELECT 1 AS t, node, parent FROM a0 UNION ALL SELECT 1, -c_custkey, c_custkey FROM customer WHERE c_custkey > 0 UNION ALL SELECT 2, -c_custkey, greatest(c_custkey // 2, 1) FROM customer WHERE c_custkey > 0
  UNION ALL SELECT DISTINCT 2, k, CASE WHEN k > 1 THEN k // 2 END FROM (SELECT greatest(c_custkey // 2, 1) AS k FROM customer WHERE c_custkey > 0)),
lf AS (SELECT t, node FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.t = b.t AND b.parent = a.node)),
up AS (SELECT lf.t, lf.node AS x, lf.node AS at_ FROM lf UNION ALL SELECT up.t, x, n.parent FROM up JOIN n ON n.t = up.t AND n.node = up.at_ WHERE n.parent IS NOT NULL),
c AS (SELECT t, at_, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS s, count(*) AS k FROM up WHERE at_ <> 1 GROUP BY t, at_), al AS (SELECT t, count(*) AS k FROM lf GROUP BY t),
o AS (SELECT c.t, s, c.k, (SELECT string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) FROM lf WHERE lf.t = c.t AND node NOT IN (SELECT x FROM up WHERE up.t = c.t AND up.at_ = c.at_)) AS other, al.k - c.k AS ok FROM c JOIN al ON al.t = c.t),
sp AS (SELECT DISTINCT t, least(s, other) AS s FROM o WHERE k > 1 AND ok > 1)
SELECT leaves, n_a, n_b, shared, (n_a + n_b - 2 * shared) / 2 AS distance, round((n_a + n_b - 2 * shared) / 2 / (leaves - 3), 8) AS rescaled
FROM (SELECT k AS leaves FROM al WHERE t = 1), (SELECT count(*) FILTER (WHERE t = 1) AS n_a, count(*) FILTER (WHERE t = 2) AS n_b FROM sp), (SELECT count(*) AS shared FROM sp a JOIN sp b ON a.s = b.s WHERE a.t = 1 AND b.t = 2)""",
    "m21_reroot": f"""WITH RECURSIVE {_T}, {_UP}, lf AS ({_LEAF.format(n='n')}), v AS (SELECT at_, k, r FROM up WHERE x = 37),
p AS (SELECT lf.node, u.at_, u.r + v.r AS distance, u.at_ = 37 AS inside FROM lf JOIN up u ON u.x = lf.node JOIN v ON v.at_ = u.at_ QUALIFY row_number() OVER (PARTITION BY lf.node ORDER BY u.k) = 1)
SELECT node, distance + CASE WHEN inside THEN 0.5 ELSE -0.5 END * (SELECT length FROM n WHERE node = 37) AS reach FROM p""",
}
