"""Phenotype joins, set operations, range joins, islands and synonym matching (J01-J12, U01-U10, S21, K19 islands)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.operators import sweep
from locusframe.plans import fixture as fx


def union_join(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("taxon", "factor"), check: bool = True) -> DataFrame:
    """Full outer join on sample and shared factors (null-safe); a shared value column takes either side's value, and
    two different values for one observation raise while the query runs."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    l, r = left.alias("l"), right.alias("r")
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    j = l.join(r, cond, "full_outer")
    out = [F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in on]
    for c in shared:
        value = F.coalesce(f"l.{c}", f"r.{c}")
        if check:
            clash = F.col(f"l.{c}").isNotNull() & F.col(f"r.{c}").isNotNull() & (F.col(f"l.{c}") != F.col(f"r.{c}"))
            value = F.when(clash, F.raise_error(F.lit(f"different values of {c} for one observation"))).otherwise(value)
        out.append(value.alias(c))
    out += [F.col(f"l.{c}") for c in left.columns if c not in on and c not in shared] + [F.col(f"r.{c}") for c in right.columns if c not in on and c not in shared]
    return j.select(*out)


def intersect_join(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("taxon", "factor")) -> DataFrame:
    """Like union_join, over samples that both sides have."""
    both = left.select("taxon").intersect(right.select("taxon"))
    return union_join(left, right, on).join(both, "taxon", "left_semi")


def join_all(tables: list[DataFrame], how=union_join, **options) -> DataFrame:
    """Left fold of a join over several phenotype tables."""
    return reduce(lambda a, b: how(a, b, **options), tables)


def genotype_phenotype(pheno: DataFrame, calls: DataFrame) -> DataFrame:
    """Every observation with the calls of its sample; one row of unknown calls for a sample without any."""
    return pheno.join(calls, "taxon", "left")


def merged_calls(tables: list[DataFrame]) -> DataFrame:
    """Cells of several call tables; the first table that has the cell gives the call."""
    rows = reduce(DataFrame.unionByName, [t.select("taxon", "site", "a1", "a2", F.lit(i).alias("k")) for i, t in enumerate(tables)])
    return rows.groupBy("taxon", "site").agg(F.min_by(F.struct("a1", "a2"), "k").alias("c")).select("taxon", "site", "c.a1", "c.a2")


def merge_duplicates(calls: DataFrame) -> DataFrame:
    """Duplicate cells of a sample become one: the two alleles most often called, ties to smaller codes; one allele makes
    it homozygous, none unknown."""
    a = calls.select("taxon", "site", F.explode(F.array("a1", "a2")).alias("a")).where("a IS NOT NULL").groupBy("taxon", "site", "a").agg(F.count("*").alias("n"))
    r = a.withColumn("rk", F.row_number().over(Window.partitionBy("taxon", "site").orderBy(F.desc("n"), "a")))
    best = r.where("rk <= 2").groupBy("taxon", "site").agg(F.min("a").alias("a1"), F.max("a").alias("a2"))
    return calls.select("taxon", "site").distinct().join(best, ["taxon", "site"], "left")


def merge_depths(depths: DataFrame, least_share: float = 0.0) -> DataFrame:
    """J05 where depths are known (``taxon, site, allele, depth``, with repeated samples): depths are summed, then called. The two
    alleles of greatest depth, ties to smaller codes; the second counts from a share of ``least_share`` of both and where it was seen at all."""
    d = depths.where("allele IS NOT NULL").groupBy("taxon", "site", "allele").agg(F.sum(F.greatest("depth", F.lit(0))).alias("depth")).where("depth > 0")
    two = d.groupBy("taxon", "site").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("allele").alias("a")))), 1, 2).alias("t"))  # an element for each allele code
    first, second = F.col("t")[0], F.get("t", F.lit(1))
    het = second.isNotNull() & (second["d"] <= least_share * (first["d"] + second["d"]))
    a = F.when(het, second["a"]).otherwise(first["a"])
    called = two.select("taxon", "site", F.least(first["a"], a).alias("a1"), F.greatest(first["a"], a).alias("a2"), (-F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["d"])).alias("depth"))
    return depths.select("taxon", "site").distinct().join(called, ["taxon", "site"], "left")


def range_join(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Points (``chr, pos``) with every closed range (``chr, start, end``) that holds them.

    Ranges are spread over bins of ``width``, so the join is an equi-join on (chr, bin) with the exact test after it. Choose
    a width near the usual range length: a range makes (length / width + 1) rows.
    """
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    hit = points.withColumn("_bin", F.floor(F.col("pos") / width)).join(binned, ["chr", "_bin"])
    return hit.where(F.col("pos").between(F.col("start"), F.col("end"))).drop("_bin")


def last_range(points: DataFrame, ranges: DataFrame, order: str = "rank") -> DataFrame:
    """Name of the range of each point that is in one; of overlapping ranges the one put last. A sweep, for ranges of any length."""
    found = sweep.covering(points, ranges, order, ["name"])
    return found.where("hit IS NOT NULL").select(*points.columns, "hit.name")


def overlay(reference: DataFrame, blocks: DataFrame) -> DataFrame:
    """Called base of each reference position (``chr, pos, base``) under block records (``chr, start, end, alt, depth, masked``):
    the alternate where there is one, the reference base in a reference block, N where masked, without depth or uncovered. The block
    that starts last counts. ``gvcf.overlay`` reads whole records."""
    b = sweep.covering(reference, blocks, "start", ["alt", "depth", "masked"])
    called = F.when(F.col("hit").isNull() | F.col("hit.masked") | (F.col("hit.depth") == 0), "N").otherwise(F.coalesce("hit.alt", "base"))
    return b.select("chr", "pos", "base", called.alias("called"))


def common_taxa(lists: list[DataFrame]) -> DataFrame:
    """U01."""
    return reduce(DataFrame.intersect, [t.select("taxon") for t in lists])


def all_taxa(lists: list[DataFrame]) -> DataFrame:
    """The union, each with its place in the merged order (first list first)."""
    rows = reduce(DataFrame.unionByName, [t.select("taxon", F.lit(i).alias("k")) for i, t in enumerate(lists)])
    return rows.groupBy("taxon").agg(F.min("k").alias("first_list"), F.count("*").cast("long").alias("n_lists"))


def same_taxa(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes, common, and whether both hold the same samples."""
    j = a.select("taxon", F.lit(1).alias("x")).distinct().join(b.select("taxon", F.lit(1).alias("y")).distinct(), "taxon", "full_outer")
    return j.agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count(F.col("x") + F.col("y")).alias("common"), F.count("*").alias("n_all")).withColumn("same", F.col("common") == F.col("n_all"))


def concatenate(tables: list[DataFrame]) -> DataFrame:
    """Rows of phenotype tables under each other by attribute name, missing ones null, columns sorted after the sample."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.select("taxon", *sorted(c for c in out.columns if c != "taxon"))


def combine_calls(tables: list[DataFrame]) -> DataFrame:
    """Sites of several tables after each other; a table's sites are shifted past those before it."""
    shift, parts = F.lit(0).cast("long"), []
    offsets = [t.agg((F.coalesce(F.max("site"), F.lit(-1)) + 1).alias("o")) for t in tables[:-1]]
    base = None
    for i, t in enumerate(tables):
        rows = t.select("taxon", "site", "a1", "a2")
        if i:
            o = offsets[i - 1]
            base = o if base is None else base.crossJoin(o.withColumnRenamed("o", "p")).select((F.col("o") + F.col("p")).alias("o"))
            rows = rows.crossJoin(F.broadcast(base)).withColumn("site", F.col("site") + F.col("o")).drop("o")  # one row
        parts.append(rows.withColumn("site", F.col("site") + shift))
    return reduce(DataFrame.unionByName, parts)


def pivot_on(pheno: DataFrame, factor: str = "factor", value: str = "y", levels: list[str] | None = None) -> DataFrame:
    """One column for each factor level (mean over replicates); give the levels to save a pass that finds them."""
    return pheno.groupBy("taxon").pivot(factor, levels).agg(F.avg(value))


def separate_on(pheno: DataFrame, factor: str, values: list[str], levels: list[str], keys: tuple[str, ...] = ("taxon",)) -> DataFrame:
    """Each value column becomes one for each level of a factor, ``value_factor.level``, in rows by the other attributes ``keys``;
    two values for one of them raise while the query runs."""
    out = []
    for v in values:
        for level in levels:
            mine = F.when(F.col(factor) == level, F.col(v))
            out.append(F.when(F.count(mine) > 1, F.raise_error(F.lit(f"several values of {v} at {factor} {level}"))).otherwise(F.max(mine)).alias(f"{v}_{factor}.{level}"))
    return pheno.groupBy(*keys).agg(*out)


def long_to_wide(rows: DataFrame, key: str, variable: str, value: str, order: str, levels: list[str]) -> DataFrame:
    """(sample, variable, value) rows to one row for each sample; the first value by ``order`` wins."""
    return rows.groupBy(key).agg(*[F.min_by(F.when(F.col(variable) == v, F.col(value)), F.when(F.col(variable) == v, F.col(order))).alias(v) for v in levels])


def merge_annotations(taxa: DataFrame) -> DataFrame:
    """Annotation lists of equal names put together, each value once, sorted."""
    return taxa.groupBy("name").agg(F.array_sort(F.collect_set("value")).alias("vals"))


def merge_intervals(ranges: DataFrame, gap: int = 0, by: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Overlapping or close ranges of a key as one, by gaps and islands over range partitions, so that no key has to fit into a task."""
    rows = sweep.dealt(ranges.select(*by, "start", "end", F.monotonically_increasing_id().alias("_no")), *by, "start", "end", "_no")
    order = [*by, "start", "end", "_no"]
    reach = sweep.earlier(rows, list(by), order, reach=("max", F.col("end")))
    fresh = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), 1).otherwise(0)
    marked = sweep.earlier(reach.withColumn("new", fresh), list(by), order, island=("sum", F.col("new"))).withColumn("island", F.col("island") + F.col("new"))
    return marked.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]", "")


def letter_pairs(s: Column) -> Column:
    """The letter pairs of a text in order, repeats included; a text of one letter or none is one pair."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))


def dice(a: Column, b: Column) -> Column:
    """Dice share of letter pairs, a pair counted as often as both texts have it."""
    x, y = letter_pairs(a), letter_pairs(b)
    many = lambda s, p: F.size(F.filter(s, lambda q: q == p))
    common = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda t, p: t + F.least(many(x, p), many(y, p)))
    return 2 * common / (F.size(x) + F.size(y))


def synonymize(names: DataFrame, reference: DataFrame, least: float = 0.0) -> DataFrame:
    """Best reference names of each name (ties kept), with Dice score and rank.

    Candidates share a letter pair, by an equi-join on (pair, occurrence), so no cross join is made: names without a common pair
    have a score of 0. The k-th occurrence of a pair in one name meets the k-th in the other, so a row of the join is a common pair.
    """
    def pairs(df: DataFrame, as_: str) -> DataFrame:
        d = df.select(F.col("name").alias(as_), letter_pairs(clean_name(F.col("name"))).alias("p")).distinct()
        d = d.select(as_, F.size("p").alias("n_" + as_), F.explode("p").alias("gram")).groupBy(as_, "n_" + as_, "gram").agg(F.count("*").alias("m"))
        return d.select(as_, "n_" + as_, "gram", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("nth"))

    a, b = pairs(names, "query"), pairs(reference, "match")
    common = a.join(b, ["gram", "nth"]).groupBy("query", "match", "n_query", "n_match").agg(F.count("*").alias("k"))
    scored = common.select("query", "match", (2 * F.col("k") / (F.col("n_query") + F.col("n_match"))).alias("score")).where(F.col("score") > least)
    return scored.withColumn("rk", F.rank().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)))).cast("long")).where("rk = 1")


def _p(s, d):
    return fx.table(s, d, "customer").groupBy((F.col("c_custkey") % 40).alias("taxon"), F.col("c_mktsegment").alias("factor")).agg(F.round(F.avg("c_acctbal"), 4).alias("y"))


def _q(s, d):
    return fx.table(s, d, "supplier").groupBy((F.col("s_suppkey") % 60).alias("taxon"), F.when(F.col("s_nationkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("factor")).agg(F.round(F.avg("s_acctbal"), 4).alias("z"))


def _ranges(s, d):
    p = F.col("p_partkey")
    start = (p * 53 % 15000).alias("start")
    return fx.table(s, d, "part").select((1 + p % 5).cast("string").alias("chr"), start, (p * 53 % 15000 + F.col("p_size")).alias("end"), F.col("p_brand").alias("name"), p.alias("rank"))


def _blocks(s, d):
    return _ranges(s, d).select("chr", "start", "end", F.when(F.col("rank") % 3 == 0, "T").alias("alt"), (F.col("rank") % 4).alias("depth"), (F.col("rank") % 11 == 0).alias("masked"))


def _reference(s, d):
    return fx.sites(s, d).select("chr", "pos", F.when(F.col("site") % 2 == 0, "A").otherwise("C").alias("base"))


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _s21(s, d):
    o = fx.table(s, d, "orders").select((F.col("o_custkey") % 40).alias("taxon"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return long_to_wide(o, "taxon", "o_orderpriority", "o_totalprice", "o_orderkey", _LEVELS).select("taxon", *[F.round(F.col(f"`{v}`"), 4).alias(f"v{i}") for i, v in enumerate(_LEVELS)])


def _dup(s, d):
    c = fx.calls(s, d)
    return c.select((F.col("taxon") % 10).alias("taxon"), "site", "a1", "a2")


def _depths(s, d):
    li = fx.table(s, d, "lineitem")
    return li.select((F.col("l_suppkey") % 40).alias("taxon"), (F.col("l_partkey") % 400).alias("site"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") % 4).alias("allele"), F.col("l_quantity").cast("long").alias("depth"))


def _names(s, d):
    return fx.table(s, d, "part").select(F.concat(F.upper("p_brand"), F.lit(" "), F.substring("p_type", 1, 6)).alias("name")), fx.table(s, d, "part").select("p_brand").distinct().withColumnRenamed("p_brand", "name")


QUERIES = {
    "j01_union_join": lambda s, d: union_join(_p(s, d), _q(s, d)),
    "j02_intersect_join": lambda s, d: intersect_join(_p(s, d), _q(s, d)),
    "j03_genotype_phenotype": lambda s, d: genotype_phenotype(_q(s, d), fx.calls(s, d).where("site < 20")),
    "j04_merged_calls": lambda s, d: merged_calls([fx.calls(s, d).where("taxon % 2 = 0"), fx.calls3(s, d)]),
    "j05_merge_duplicates": lambda s, d: merge_duplicates(_dup(s, d)),
    "j05_merge_depths": lambda s, d: merge_depths(_depths(s, d), 0.2),
    "u06_separate_on": lambda s, d: separate_on(_p(s, d), "factor", ["y"], _SEGMENTS).select("taxon", *[F.round(F.col(f"`y_factor.{c}`"), 4).alias(c.lower()) for c in _SEGMENTS]),
    "j07_position_in_range": lambda s, d: last_range(fx.sites(s, d), _ranges(s, d)),
    "j08_overlay": lambda s, d: overlay(_reference(s, d), _blocks(s, d)),
    "j10_synonymize": lambda s, d: synonymize(*_names(s, d)).select("query", "match", F.round("score", 6).alias("score"), "rk"),
    "u01_common_taxa": lambda s, d: common_taxa([_p(s, d), _q(s, d), fx.calls(s, d)]),
    "u02_all_taxa": lambda s, d: all_taxa([x.select("taxon").distinct() for x in (_p(s, d), _q(s, d))]),
    "u03_same_taxa": lambda s, d: same_taxa(_p(s, d), _q(s, d)),
    "u04_concatenate": lambda s, d: concatenate([_p(s, d), _q(s, d)]),
    "u05_combine_calls": lambda s, d: combine_calls([fx.calls(s, d), fx.calls3(s, d)]),
    "u06_pivot_on_factor": lambda s, d: pivot_on(_p(s, d), levels=_SEGMENTS).select("taxon", *[F.round(c, 4).alias(c.lower()) for c in _SEGMENTS]),
    "u07_merge_annotations": lambda s, d: merge_annotations(fx.table(s, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 20).alias("value"))).select("name", F.array_join(F.transform("vals", lambda x: x.cast("string")), ";").alias("vals")),
    "u10_merge_intervals": lambda s, d: merge_intervals(_ranges(s, d), 1),
    "s21_phenotype_from_rows": _s21,
}

_P = "p AS (SELECT c_custkey % 40 AS taxon, c_mktsegment AS factor, round(avg(c_acctbal), 4) AS y FROM customer GROUP BY 1, 2)"
_Q = "q AS (SELECT s_suppkey % 60 AS taxon, CASE WHEN s_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS factor, round(avg(s_acctbal), 4) AS z FROM supplier GROUP BY 1, 2)"
_R = "rg AS (SELECT CAST(1 + p_partkey % 5 AS VARCHAR) AS chr, p_partkey * 53 % 15000 AS \"start\", p_partkey * 53 % 15000 + p_size AS \"end\", p_brand AS name, p_partkey AS rank FROM part)"
_UJ = "SELECT coalesce(p.taxon, q.taxon) AS taxon, coalesce(p.factor, q.factor) AS factor, y, z FROM p FULL JOIN q ON p.taxon = q.taxon AND p.factor IS NOT DISTINCT FROM q.factor"
ORACLES = {
    "j01_union_join": f"WITH {_P}, {_Q} {_UJ}",
    "j02_intersect_join": f"WITH {_P}, {_Q} SELECT * FROM ({_UJ}) WHERE taxon IN (SELECT taxon FROM p) AND taxon IN (SELECT taxon FROM q)",
    "j03_genotype_phenotype": f"WITH {_Q}, {fx.CALLS} SELECT q.taxon, factor, z, site, a1, a2 FROM q LEFT JOIN (SELECT * FROM calls WHERE site < 20) c ON q.taxon = c.taxon",
    "j04_merged_calls": f"WITH {fx.CALLS}, {fx.CALLS3} SELECT taxon, site, a1, a2 FROM calls WHERE taxon % 2 = 0 UNION ALL SELECT taxon, site, a1, a2 FROM calls3 WHERE taxon % 2 = 1",
    "j05_merge_duplicates": f"""WITH {fx.CALLS}, d AS (SELECT taxon % 10 AS taxon, site, a1, a2 FROM calls), a AS (SELECT taxon, site, a, count(*) AS n FROM (SELECT taxon, site, a1 AS a FROM d UNION ALL SELECT taxon, site, a2 FROM d) t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY taxon, site ORDER BY n DESC, a) AS rk FROM a), b AS (SELECT taxon, site, min(a) AS a1, max(a) AS a2 FROM r WHERE rk <= 2 GROUP BY 1, 2)
SELECT k.taxon, k.site, b.a1, b.a2 FROM (SELECT DISTINCT taxon, site FROM d) k LEFT JOIN b ON k.taxon = b.taxon AND k.site = b.site""",
    "j05_merge_depths": """WITH l AS (SELECT l_suppkey % 40 AS taxon, l_partkey % 400 AS site, CASE WHEN l_linenumber < 7 THEN l_linenumber % 4 END AS allele, CAST(l_quantity AS BIGINT) AS depth FROM lineitem),
s AS (SELECT taxon, site, allele, CAST(sum(depth) AS BIGINT) AS n FROM l WHERE allele IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY taxon, site ORDER BY n DESC, allele) AS rk FROM s),
t AS (SELECT taxon, site, max(CASE WHEN rk = 1 THEN allele END) AS a, max(CASE WHEN rk = 2 THEN allele END) AS b, max(CASE WHEN rk = 1 THEN n END) AS na, max(CASE WHEN rk = 2 THEN n END) AS nb FROM r WHERE rk <= 2 GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN nb >= 0.2 * (na + nb) THEN b ELSE a END AS o FROM t)
SELECT k.taxon, k.site, least(a, o) AS a1, greatest(a, o) AS a2, CAST(na + coalesce(nb, 0) AS BIGINT) AS depth FROM (SELECT DISTINCT taxon, site FROM l) k LEFT JOIN c ON k.taxon = c.taxon AND k.site = c.site""",
    "u06_separate_on": f"WITH {_P} SELECT taxon, " + ", ".join(f"round(max(CASE WHEN factor = '{c}' THEN y END), 4) AS {c.lower()}" for c in _SEGMENTS) + " FROM p GROUP BY taxon",
    "j07_position_in_range": f"WITH {fx.SITES}, {_R} SELECT site, s.chr, pos, arg_max(name, rank) AS name FROM sites s JOIN rg ON s.chr = rg.chr AND pos BETWEEN \"start\" AND \"end\" GROUP BY 1, 2, 3",
    "j08_overlay": f"""WITH {fx.SITES}, {_R}, ref AS (SELECT chr, pos, CASE WHEN site % 2 = 0 THEN 'A' ELSE 'C' END AS base FROM sites),
b AS (SELECT ref.chr, pos, CASE WHEN rank % 3 = 0 THEN 'T' END AS alt, rank % 4 AS depth, rank % 11 = 0 AS masked, row_number() OVER (PARTITION BY ref.chr, pos ORDER BY "start" DESC) AS rn FROM ref JOIN rg ON ref.chr = rg.chr AND pos BETWEEN "start" AND "end")
SELECT ref.chr, ref.pos, base, CASE WHEN b.depth IS NULL OR masked OR depth = 0 THEN 'N' ELSE coalesce(alt, base) END AS called FROM ref LEFT JOIN b ON ref.chr = b.chr AND ref.pos = b.pos AND rn = 1""",
    "j10_synonymize": """WITH n AS (SELECT DISTINCT upper(p_brand) || ' ' || substr(p_type, 1, 6) AS query FROM part), m AS (SELECT DISTINCT p_brand AS match FROM part),
a AS (SELECT query, regexp_replace(lower(trim(query)), '[^a-z0-9]', '', 'g') AS c FROM n), b AS (SELECT match, regexp_replace(lower(trim(match)), '[^a-z0-9]', '', 'g') AS c FROM m),
ag AS (SELECT query, substr(c, i, 2) AS g, row_number() OVER (PARTITION BY query, substr(c, i, 2)) AS o FROM (SELECT query, c, unnest(range(1, greatest(length(c), 2))) AS i FROM a)), bg AS (SELECT match, substr(c, i, 2) AS g, row_number() OVER (PARTITION BY match, substr(c, i, 2)) AS o FROM (SELECT match, c, unnest(range(1, greatest(length(c), 2))) AS i FROM b)),
k AS (SELECT query, match, count(*) AS k FROM ag JOIN bg ON ag.g = bg.g AND ag.o = bg.o GROUP BY 1, 2),
s AS (SELECT k.query, k.match, 2 * k.k / ((SELECT count(*) FROM ag WHERE ag.query = k.query) + (SELECT count(*) FROM bg WHERE bg.match = k.match)) AS score FROM k)
SELECT query, match, round(score, 6) AS score, rk FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY round(score, 9) DESC) AS rk FROM s) WHERE rk = 1""",
    "u01_common_taxa": f"WITH {_P}, {_Q}, {fx.CALLS} SELECT taxon FROM p INTERSECT SELECT taxon FROM q INTERSECT SELECT taxon FROM calls",
    "u02_all_taxa": f"WITH {_P}, {_Q} SELECT taxon, min(k) AS first_list, count(*) AS n_lists FROM (SELECT DISTINCT taxon, 0 AS k FROM p UNION ALL SELECT DISTINCT taxon, 1 FROM q) t GROUP BY taxon",
    "u03_same_taxa": f"WITH {_P}, {_Q}, j AS (SELECT a.taxon AS x, b.taxon AS y FROM (SELECT DISTINCT taxon FROM p) a FULL JOIN (SELECT DISTINCT taxon FROM q) b ON a.taxon = b.taxon) SELECT count(x) AS n_a, count(y) AS n_b, count(x + y) AS common, count(*) AS n_all, count(x + y) = count(*) AS same FROM j",
    "u04_concatenate": f"WITH {_P}, {_Q} SELECT taxon, factor, y, NULL AS z FROM p UNION ALL SELECT taxon, factor, NULL, z FROM q",
    "u05_combine_calls": f"WITH {fx.CALLS}, {fx.CALLS3} SELECT taxon, site, a1, a2 FROM calls UNION ALL SELECT taxon, site + (SELECT max(site) + 1 FROM calls), a1, a2 FROM calls3",
    "u06_pivot_on_factor": f"WITH {_P} SELECT taxon, " + ", ".join(f"round(avg(CASE WHEN factor = '{c}' THEN y END), 4) AS {c.lower()}" for c in _SEGMENTS) + " FROM p GROUP BY taxon",
    "u07_merge_annotations": "SELECT event_type AS name, string_agg(CAST(v AS VARCHAR), ';' ORDER BY v) AS vals FROM (SELECT DISTINCT event_type, user_id % 20 AS v FROM events) t GROUP BY 1",
    "u10_merge_intervals": f"""WITH {_R}, m AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR "start" > max("end") OVER w + 1 THEN 1 ELSE 0 END AS new FROM rg WINDOW w AS (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chr, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY chr, island""",
    "s21_phenotype_from_rows": "SELECT o_custkey % 40 AS taxon, " + ", ".join(f"round(arg_min(CASE WHEN o_orderpriority = '{v}' THEN o_totalprice END, CASE WHEN o_orderpriority = '{v}' THEN o_orderkey END), 4) AS v{i}" for i, v in enumerate(_LEVELS)) + " FROM orders GROUP BY 1",
}
