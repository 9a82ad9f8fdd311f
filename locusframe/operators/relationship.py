"""Sample-by-sample matrices: kinship, identity by state, matrix arithmetic.

A symmetric matrix is a DataFrame ``i, j, value`` with i >= j. Unknown calls are dropped
before any pair is made, so a pair's row count is the number of sites both know.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators.summary import _rounded, allele_counts
from locusframe.plans import fixture as fx

METHODS = ("centered_ibs", "normalized_ibs", "dominance_centered", "dominance_centered_observed", "dominance_normalized")


def pseudo_sites(calls: DataFrame) -> DataFrame:
    """``site, allele, p``: every allele of a site but its last by rank, with its frequency among known alleles."""
    ac = allele_counts(calls)
    last = F.max("rk").over(Window.partitionBy("site"))
    return ac.withColumn("last", last).where("rk < last").select("site", "allele", (F.col("n") / F.col("total")).alias("p"))


def weights(calls: DataFrame, method: str = "centered_ibs") -> tuple[DataFrame, DataFrame]:
    """``taxon, unit, w`` (known calls only) and one row ``d``, with value(i, j) = sum w_i w_j / d."""
    some = calls.where("a1 IS NOT NULL OR a2 IS NOT NULL")
    if method in ("centered_ibs", "normalized_ibs"):
        ps = pseudo_sites(calls)
        count = F.coalesce((F.col("a1") == F.col("allele")).cast("int"), F.lit(0)) + F.coalesce((F.col("a2") == F.col("allele")).cast("int"), F.lit(0))
        var = 2 * F.col("p") * (1 - F.col("p"))
        w = count - 2 * F.col("p") if method == "centered_ibs" else (count - 2 * F.col("p")) / F.sqrt(var)
        rows = some.join(ps, "site").select("taxon", F.struct("site", "allele").alias("unit"), w.alias("w"))
        return rows, ps.agg((F.sum(var) if method == "centered_ibs" else F.count("*").cast("double")).alias("d"))
    ac = allele_counts(calls)
    first = ac.where("rk = 1").select("site", (F.col("n") / F.col("total")).alias("p"), (1 - F.col("n") / F.col("total")).alias("q"))
    het = F.coalesce((F.col("a1") != F.col("a2")).cast("int"), F.lit(0))
    rate = calls.where("a1 IS NOT NULL AND a2 IS NOT NULL").groupBy("site").agg(F.avg((F.col("a1") != F.col("a2")).cast("int")).alias("h"))
    site = first.join(rate, "site", "left").withColumn("e", F.col("h") if method == "dominance_centered_observed" else 2 * F.col("p") * F.col("q"))
    site = site.where("e > 0 AND e < 1").select("site", "e")
    var = F.col("e") * (1 - F.col("e"))
    w = (het - F.col("e")) / (F.sqrt(var) if method == "dominance_normalized" else F.lit(1.0))
    rows = some.join(site, "site").select("taxon", F.struct("site", F.lit(0).cast("long").alias("allele")).alias("unit"), w.alias("w"))
    return rows, site.agg((F.count("*").cast("double") if method == "dominance_normalized" else F.sum(var)).alias("d"))


def kinship(calls: DataFrame, method: str = "centered_ibs", tiles: bool | None = None, tile: int = 512, strip: int = 4096, few: int = 256) -> DataFrame:
    """``i, j, value``, diagonal included.

    With ``tiles`` the product is blocked: samples in groups of ``tile``, sites in strips of about ``strip``; a task
    multiplies two dense blocks, and the partial tiles are summed. Rows made are samples^2 x strips, not samples^2 x
    units. Without, the join and the sum are plain SQL, for few samples. Left open, one aggregate counts the samples, and
    up to ``few`` of them go by SQL; both ways give the same matrix.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    w, d = weights(calls, method)
    d = F.broadcast(d)  # one row
    if tiles is not False:
        size = calls.agg(F.approx_count_distinct("taxon").alias("taxa"), F.approx_count_distinct("site").alias("sites")).first()
        tiles = tiles or size["taxa"] > few
    if not tiles:
        y = w.select(F.col("taxon").alias("j"), "unit", F.col("w").alias("wj"))
        pairs = w.select(F.col("taxon").alias("i"), "unit", "w").join(y, "unit").where("i >= j")
        return pairs.groupBy("i", "j").agg(F.sum(F.col("w") * F.col("wj")).alias("s")).crossJoin(d).select("i", "j", F.try_divide("s", "d").alias("value"))
    strips = max(1, -(-size["sites"] // strip))
    groups = max(1, -(-size["taxa"] // tile))
    placed = w.withColumn("g", F.pmod(F.xxhash64("taxon"), F.lit(groups)).cast("int")).withColumn("s", F.pmod(F.xxhash64("unit.site"), F.lit(strips)).cast("int"))
    # a sample's block meets every other block once: replicate by the partner group, the larger group first
    spread = placed.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread = spread.select("s", F.greatest("g", "h").alias("x"), F.least("g", "h").alias("y"), "g", "taxon", F.col("unit.site").alias("site"), F.col("unit.allele").alias("allele"), "w")

    def multiply(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        unit = part.groupby(["site", "allele"], sort=False).ngroup().to_numpy()
        n = unit.max() + 1

        def dense(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            name, at = np.unique(part["taxon"].to_numpy()[rows], return_inverse=True)
            m = np.zeros((len(name), n))
            m[at, unit[rows]] = part["w"].to_numpy()[rows]
            return name, m

        g = part["g"].to_numpy()
        a, left = dense(g == key[1])
        b, right = dense(g == key[2]) if key[1] != key[2] else (a, left)
        s = left @ right.T
        i, j = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
        keep = i >= j if key[1] == key[2] else np.ones(len(i), bool)
        return pd.DataFrame({"i": np.maximum(i, j)[keep], "j": np.minimum(i, j)[keep], "v": s.ravel()[keep]})

    kind = dict(calls.dtypes)["taxon"]
    part = spread.groupBy("s", "x", "y").applyInPandas(multiply, f"i {kind}, j {kind}, v double")
    return part.groupBy("i", "j").agg(F.sum("v").alias("v")).crossJoin(d).select("i", "j", F.try_divide("v", "d").alias("value"))


def _similarity(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """1 for equal homozygotes, a half for a shared allele with a heterozygote, else 0; a half-known call is homozygous."""
    x1, x2, y1, y2 = F.coalesce(a1, a2), F.coalesce(a2, a1), F.coalesce(b1, b2), F.coalesce(b2, b1)
    share = (x1 == y1) | (x1 == y2) | (x2 == y1) | (x2 == y2)
    return F.when(~share, 0.0).when((x1 == x2) & (y1 == y2), 1.0).otherwise(0.5)


def ibs_distance_to(calls: DataFrame, taxon: int, min_sites: int = 1) -> DataFrame:
    """Distance of every sample to one: one minus the mean similarity over sites both know; null below ``min_sites``.

    The one sample's calls are a filter of the same scan; its join side has a row for each site.
    """
    some = calls.where("a1 IS NOT NULL OR a2 IS NOT NULL")
    one = some.where(F.col("taxon") == taxon).select("site", F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    j = some.join(one, "site").groupBy("taxon").agg(F.count("*").alias("n_sites"), F.avg(_similarity(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"))).alias("s"))
    return j.select("taxon", "n_sites", F.when(F.col("n_sites") >= min_sites, 1 - F.col("s")).alias("distance"))


def ibs_matrix(calls: DataFrame) -> DataFrame:
    """Identity-by-state distances of all pairs, ``i, j, value, n``."""
    some = calls.where("a1 IS NOT NULL OR a2 IS NOT NULL")
    y = some.select(F.col("taxon").alias("j"), "site", F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    pairs = some.withColumnRenamed("taxon", "i").join(y, "site").where("i >= j")
    return pairs.groupBy("i", "j").agg((1 - F.avg(_similarity(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")))).alias("value"), F.count("*").alias("n"))


def ibs_bits(calls: DataFrame, taxon_a: int, taxon_b: int) -> DataFrame:
    """Identity from presence bits of major and minor allele: (same + het / 2) / (same + diff + het)."""
    rank = allele_counts(calls).where("rk <= 2").groupBy("site").agg(F.max(F.when(F.col("rk") == 1, F.col("allele"))).alias("ma"), F.max(F.when(F.col("rk") == 2, F.col("allele"))).alias("mi"))
    has = lambda x, k: F.coalesce((F.col(x + "1") == F.col(k)), F.lit(False)) | F.coalesce((F.col(x + "2") == F.col(k)), F.lit(False))
    a = calls.where(F.col("taxon") == taxon_a).select("site", "a1", "a2")
    b = calls.where(F.col("taxon") == taxon_b).select("site", F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    j = a.join(b, "site").join(rank, "site")
    same = (has("a", "ma") & has("b", "ma")) | (has("a", "mi") & has("b", "mi"))
    diff = (has("a", "ma") & has("b", "mi")) | (has("a", "mi") & has("b", "ma"))
    t = j.agg(F.sum(same.cast("long")).alias("same"), F.sum(diff.cast("long")).alias("diff"), F.sum((same & diff).cast("long")).alias("het"))
    return t.withColumn("distance", 1 - F.try_divide(F.col("same") + F.floor(F.col("het") / 2), F.col("same") + F.col("diff") + F.col("het")))


def mean_distance(m: DataFrame) -> DataFrame:
    """Mean of the values off the diagonal."""
    return m.where("i > j AND value IS NOT NULL AND NOT isnan(value)").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def compare(m1: DataFrame, m2: DataFrame, weighted: bool = False) -> DataFrame:
    """Sums of squared and of absolute differences over both triangles; weights are 1 / value^2 of the first."""
    j = m1.where("i > j").join(m2.select("i", "j", F.col("value").alias("other")), ["i", "j"])
    d = F.col("value") - F.col("other")
    w = F.when(F.col("value") != 0, 1 / (F.col("value") * F.col("value"))).otherwise(0.0) if weighted else F.lit(1.0)
    return j.agg((2 * F.sum(w * d * d)).alias("squared"), (2 * F.sum(F.abs(d))).alias("absolute"))


def hadamard(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """Products of equal cells."""
    return m1.join(m2.select("i", "j", F.col("value").alias("other")), ["i", "j"]).select("i", "j", (F.col("value") * F.col("other")).alias("value"))


def keep_taxa(m: DataFrame, taxa: DataFrame) -> DataFrame:
    """the matrix over the samples in ``taxa`` (column taxon)."""
    return m.join(taxa.select(F.col("taxon").alias("i")), "i", "left_semi").join(taxa.select(F.col("taxon").alias("j")), "j", "left_semi").select("i", "j", *[c for c in m.columns if c not in ("i", "j")])


def closest(m: DataFrame) -> DataFrame:
    """Of each sample the other one at the smallest distance, ties to the smaller name."""
    both = m.where("i <> j AND value IS NOT NULL").select("i", "j", "value")
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy("i").agg(F.min(F.struct("value", "j")).alias("x")).select(F.col("i").alias("taxon"), F.col("x.j").alias("closest"), F.col("x.value").alias("distance"))


def hybrid_calls(calls: DataFrame, crosses: DataFrame) -> DataFrame:
    """Call of each cross (``child, mother, father``): one allele of each parent where both are homozygous, else unknown."""
    m = calls.select(F.col("taxon").alias("mother"), "site", F.when(F.col("a1") == F.col("a2"), F.col("a1")).alias("x"))
    f = calls.select(F.col("taxon").alias("father"), "site", F.when(F.col("a1") == F.col("a2"), F.col("a1")).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return crosses.join(m, "mother").join(f, ["father", "site"]).select("child", "site", F.when(both, F.least("x", "y")).alias("a1"), F.when(both, F.greatest("x", "y")).alias("a2"))


def difference_calls(calls: DataFrame, crosses: DataFrame) -> DataFrame:
    """The other parent of a hybrid: homozygous for the allele that a homozygous parent (``mother``) doesn't explain."""
    h = calls.select(F.col("taxon").alias("child"), "site", F.col("a1").alias("h1"), F.col("a2").alias("h2"))
    m = calls.select(F.col("taxon").alias("mother"), "site", F.when(F.col("a1") == F.col("a2"), F.col("a1")).alias("x"))
    other = F.when(F.col("h1") == F.col("x"), F.col("h2")).when(F.col("h2") == F.col("x"), F.col("h1"))
    return crosses.join(h, "child").join(m, ["mother", "site"]).select("child", "mother", "site", other.alias("a1"), other.alias("a2"))


def degrees(edges: DataFrame) -> DataFrame:
    """Of each node of a weighted directed graph: out and in degree, weighted too."""
    e = edges.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("n"), F.col("w").alias("ow"), F.lit(0.0).alias("nw"))
    e = e.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("n"), F.lit(0.0).alias("ow"), F.col("w").alias("nw")))
    return e.groupBy("node").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("n").cast("long").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("nw").alias("in_weight"))


def neighbours(edges: DataFrame, directed: bool = True) -> DataFrame:
    """``node, neighbour`` without repeats: successors, or both ends of an undirected graph. A loop is its own neighbour."""
    e = edges.select(F.col("u").alias("node"), F.col("v").alias("neighbour"))
    return (e if directed else e.unionByName(e.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour")))).distinct()


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, sum of weights."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().agg(F.count("*").alias("nodes"))
    return edges.agg(F.count("*").alias("edges"), F.sum("w").alias("weight")).crossJoin(nodes)  # one row each


def _crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("taxon")
    return fx.calls(spark, sf_dir).select("taxon").distinct().select((1000 + t).alias("child"), t.alias("mother"), ((t * 7 + 3) % 40).alias("father"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("u"), (F.col("l_partkey") % 40).alias("v"), "l_quantity").groupBy("u", "v").agg(F.sum("l_quantity").alias("w"))


def _k(method: str):
    return lambda s, d: _rounded(kinship(fx.calls3(s, d), method), "value")


def _two(s, d):
    c = fx.calls(s, d)
    return kinship(c), ibs_matrix(c).select("i", "j", "value")


QUERIES = {
    "a17_mean_distance": lambda s, d: _rounded(mean_distance(ibs_matrix(fx.calls(s, d))), "mean"),
    "a18_compare_matrices": lambda s, d: _rounded(compare(*_two(s, d)), "squared", "absolute"),
    "a19_hadamard": lambda s, d: _rounded(hadamard(*_two(s, d)), "value"),
    "a20_kinship_centered_ibs": _k("centered_ibs"),
    "a20_kinship_centered_ibs_tiles": lambda s, d: _rounded(kinship(fx.calls3(s, d), tiles=True), "value"),
    "a21_ibs_one_by_all": lambda s, d: _rounded(ibs_distance_to(fx.calls3(s, d), 1, 10), "distance"),
    "a21_ibs_matrix": lambda s, d: _rounded(ibs_matrix(fx.calls3(s, d)), "value"),
    "a22_ibs_bits": lambda s, d: _rounded(ibs_bits(fx.calls(s, d), 1, 2), "distance"),
    "a23_kinship_normalized_ibs": _k("normalized_ibs"),
    "a23_kinship_dominance_centered": _k("dominance_centered"),
    "a23_kinship_dominance_observed": _k("dominance_centered_observed"),
    "a23_kinship_dominance_normalized": _k("dominance_normalized"),
    "a25_graph_degrees": lambda s, d: _rounded(degrees(_edges(s, d)), "out_weight", "in_weight"),
    "a25_neighbours": lambda s, d: neighbours(_edges(s, d).where("w > 30"), directed=False),
    "a25_graph_size": lambda s, d: _rounded(graph_size(_edges(s, d)), "weight"),
    "f20_distance_keep_taxa": lambda s, d: _rounded(keep_taxa(ibs_matrix(fx.calls(s, d)), fx.calls(s, d).where("taxon % 3 = 1").select("taxon").distinct()), "value"),
    "t06_closest": lambda s, d: _rounded(closest(ibs_matrix(fx.calls(s, d)).withColumn("value", F.round("value", 9))), "distance"),
    "j09_hybrid": lambda s, d: hybrid_calls(fx.calls(s, d), _crosses(s, d)),
    "j09_difference": lambda s, d: difference_calls(fx.calls(s, d), _crosses(s, d).select((F.col("mother") * 3 % 40).alias("child"), "mother")),
}

_SIM = """CASE WHEN NOT (coalesce(x.a1,x.a2)=coalesce(y.a1,y.a2) OR coalesce(x.a1,x.a2)=coalesce(y.a2,y.a1) OR coalesce(x.a2,x.a1)=coalesce(y.a1,y.a2) OR coalesce(x.a2,x.a1)=coalesce(y.a2,y.a1)) THEN 0.0
  WHEN coalesce(x.a1,x.a2)=coalesce(x.a2,x.a1) AND coalesce(y.a1,y.a2)=coalesce(y.a2,y.a1) THEN 1.0 ELSE 0.5 END"""


def _ibs(src: str) -> str:
    return f"""ibs AS (SELECT x.taxon AS i, y.taxon AS j, 1 - avg({_SIM}) AS value, count(*) AS n FROM {src} x JOIN {src} y ON x.site = y.site AND x.taxon >= y.taxon
  WHERE (x.a1 IS NOT NULL OR x.a2 IS NOT NULL) AND (y.a1 IS NOT NULL OR y.a2 IS NOT NULL) GROUP BY 1, 2)"""


def _kin(src: str, w: str, d: str) -> str:
    return f"""ac AS (SELECT site, allele, count(*) AS n FROM (SELECT site, a1 AS allele FROM {src} UNION ALL SELECT site, a2 FROM {src}) t WHERE allele IS NOT NULL GROUP BY 1, 2),
ps AS (SELECT site, allele, n / total AS p FROM (SELECT *, sum(n) OVER (PARTITION BY site) AS total, row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS rk,
  count(*) OVER (PARTITION BY site) AS k FROM ac) WHERE rk < k),
w AS (SELECT taxon, c.site, allele, {w} AS w FROM {src} c JOIN ps ON c.site = ps.site WHERE a1 IS NOT NULL OR a2 IS NOT NULL),
kin AS (SELECT x.taxon AS i, y.taxon AS j, sum(x.w * y.w) / (SELECT {d} FROM ps) AS value FROM w x JOIN w y ON x.site = y.site AND x.allele = y.allele AND x.taxon >= y.taxon GROUP BY 1, 2)"""


_CNT = "(CASE WHEN a1 = allele THEN 1 ELSE 0 END + CASE WHEN a2 = allele THEN 1 ELSE 0 END)"
_CEN = (f"{_CNT} - 2 * p", "sum(2 * p * (1 - p))")
_NOR = (f"({_CNT} - 2 * p) / sqrt(2 * p * (1 - p))", "count(*)")


def _dom(e: str, w: str, d: str) -> str:
    return f"""WITH {fx.CALLS3}, ac AS (SELECT site, allele, count(*) AS n FROM (SELECT site, a1 AS allele FROM calls3 UNION ALL SELECT site, a2 FROM calls3) t WHERE allele IS NOT NULL GROUP BY 1, 2),
f AS (SELECT site, max(n) / sum(n) AS p FROM ac GROUP BY site),
h AS (SELECT site, avg(CASE WHEN a1 <> a2 THEN 1.0 ELSE 0.0 END) AS h FROM calls3 WHERE a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY site),
s AS (SELECT * FROM (SELECT f.site, {e} AS e FROM f LEFT JOIN h ON f.site = h.site) x WHERE e > 0 AND e < 1),
w AS (SELECT taxon, c.site, (CASE WHEN a1 <> a2 THEN 1 ELSE 0 END - e){w} AS w FROM calls3 c JOIN s ON c.site = s.site WHERE a1 IS NOT NULL OR a2 IS NOT NULL)
SELECT x.taxon AS i, y.taxon AS j, round(sum(x.w * y.w) / (SELECT {d} FROM s), 6) AS value FROM w x JOIN w y ON x.site = y.site AND x.taxon >= y.taxon GROUP BY 1, 2"""


_EDGES = "e AS (SELECT l_suppkey % 40 AS u, l_partkey % 40 AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)"
_TWO = f"WITH {fx.CALLS}, {_kin('calls', *_CEN)}, {_ibs('calls')}"
_CROSS = "cr AS (SELECT DISTINCT 1000 + taxon AS child, taxon AS mother, (taxon * 7 + 3) % 40 AS father FROM calls)"
ORACLES = {
    "a17_mean_distance": f"WITH {fx.CALLS}, {_ibs('calls')} SELECT round(avg(value), 6) AS mean, count(*) AS n FROM ibs WHERE i > j",
    "a18_compare_matrices": f"{_TWO} SELECT round(2 * sum((k.value - b.value) * (k.value - b.value)), 6) AS squared, round(2 * sum(abs(k.value - b.value)), 6) AS absolute FROM kin k JOIN ibs b ON k.i = b.i AND k.j = b.j WHERE k.i > k.j",
    "a19_hadamard": f"{_TWO} SELECT k.i, k.j, round(k.value * b.value, 6) AS value FROM kin k JOIN ibs b ON k.i = b.i AND k.j = b.j",
    "a20_kinship_centered_ibs": f"WITH {fx.CALLS3}, {_kin('calls3', *_CEN)} SELECT i, j, round(value, 6) AS value FROM kin",
    "a20_kinship_centered_ibs_tiles": f"WITH {fx.CALLS3}, {_kin('calls3', *_CEN)} SELECT i, j, round(value, 6) AS value FROM kin",
    "a21_ibs_one_by_all": f"WITH {fx.CALLS3} SELECT x.taxon, count(*) AS n_sites, CASE WHEN count(*) >= 10 THEN round(1 - avg({_SIM}), 6) END AS distance FROM calls3 x JOIN calls3 y ON x.site = y.site AND y.taxon = 1 WHERE (x.a1 IS NOT NULL OR x.a2 IS NOT NULL) AND (y.a1 IS NOT NULL OR y.a2 IS NOT NULL) GROUP BY 1",
    "a21_ibs_matrix": f"WITH {fx.CALLS3}, {_ibs('calls3')} SELECT i, j, round(value, 6) AS value, n FROM ibs",
    "a22_ibs_bits": f"""WITH {fx.CALLS}, ac AS (SELECT site, allele, count(*) AS n FROM (SELECT site, a1 AS allele FROM calls UNION ALL SELECT site, a2 FROM calls) t WHERE allele IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS rk FROM ac), m AS (SELECT site, max(CASE WHEN rk=1 THEN allele END) AS ma, max(CASE WHEN rk=2 THEN allele END) AS mi FROM r GROUP BY 1),
j AS (SELECT coalesce(a.a1 = ma OR a.a2 = ma, false) AS aj, coalesce(a.a1 = mi OR a.a2 = mi, false) AS an, coalesce(b.a1 = ma OR b.a2 = ma, false) AS bj, coalesce(b.a1 = mi OR b.a2 = mi, false) AS bn
 FROM calls a JOIN calls b ON a.site = b.site AND a.taxon = 1 AND b.taxon = 2 JOIN m ON m.site = a.site),
k AS (SELECT (aj AND bj) OR (an AND bn) AS s, (aj AND bn) OR (an AND bj) AS d FROM j), t AS (SELECT count(*) FILTER (WHERE s) AS same, count(*) FILTER (WHERE d) AS diff, count(*) FILTER (WHERE s AND d) AS het FROM k)
SELECT same, diff, het, round(1 - (same + floor(het / 2)) / (same + diff + het), 6) AS distance FROM t""",
    "a23_kinship_normalized_ibs": f"WITH {fx.CALLS3}, {_kin('calls3', *_NOR)} SELECT i, j, round(value, 6) AS value FROM kin",
    "a23_kinship_dominance_centered": _dom("2 * p * (1 - p)", "", "sum(e * (1 - e))"),
    "a23_kinship_dominance_observed": _dom("h", "", "sum(e * (1 - e))"),
    "a23_kinship_dominance_normalized": _dom("2 * p * (1 - p)", " / sqrt(e * (1 - e))", "count(*)"),
    "a25_graph_degrees": f"""WITH {_EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(n) AS BIGINT) AS in_degree, round(sum(ow), 6) AS out_weight, round(sum(nw), 6) AS in_weight FROM (
 SELECT u AS node, 1 AS o, 0 AS n, w AS ow, 0.0 AS nw FROM e UNION ALL SELECT v, 0, 1, 0.0, w FROM e) t GROUP BY node""",
    "a25_neighbours": f"WITH {_EDGES} SELECT u AS node, v AS neighbour FROM e WHERE w > 30 UNION SELECT v, u FROM e WHERE w > 30",
    "a25_graph_size": f"WITH {_EDGES} SELECT count(*) AS edges, round(sum(w), 6) AS weight, (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS nodes FROM e",
    "f20_distance_keep_taxa": f"WITH {fx.CALLS}, {_ibs('calls')} SELECT i, j, round(value, 6) AS value, n FROM ibs WHERE i % 3 = 1 AND j % 3 = 1",
    "t06_closest": f"""WITH {fx.CALLS}, {_ibs('calls')}, b AS (SELECT i, j, round(value, 9) AS v FROM ibs WHERE i <> j UNION ALL SELECT j, i, round(value, 9) FROM ibs WHERE i <> j)
SELECT taxon, closest, round(v, 6) AS distance FROM (SELECT i AS taxon, j AS closest, v, row_number() OVER (PARTITION BY i ORDER BY v, j) AS rn FROM b) x WHERE rn = 1""",
    "j09_hybrid": f"""WITH {fx.CALLS}, {_CROSS}, h AS (SELECT taxon, site, CASE WHEN a1 = a2 THEN a1 END AS x FROM calls)
SELECT child, m.site, CASE WHEN m.x IS NOT NULL AND f.x IS NOT NULL THEN least(m.x, f.x) END AS a1, CASE WHEN m.x IS NOT NULL AND f.x IS NOT NULL THEN greatest(m.x, f.x) END AS a2
FROM cr JOIN h m ON m.taxon = mother JOIN h f ON f.taxon = father AND f.site = m.site""",
    "j09_difference": f"""WITH {fx.CALLS}, cr AS (SELECT DISTINCT taxon * 3 % 40 AS child, taxon AS mother FROM calls),
j AS (SELECT child, mother, c.site, CASE WHEN c.a1 = CASE WHEN m.a1 = m.a2 THEN m.a1 END THEN c.a2 WHEN c.a2 = CASE WHEN m.a1 = m.a2 THEN m.a1 END THEN c.a1 END AS o FROM cr JOIN calls c ON c.taxon = child JOIN calls m ON m.taxon = mother AND m.site = c.site)
SELECT child, mother, site, o AS a1, o AS a2 FROM j""",
}
