"""Sweeps over range partitions, the GVCF overlay and merged variants, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from locusframe.operators import gvcf, joins, sweep, variants
from locusframe.sources import readers


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Many small ranges, so that intervals are longer than one and positions are shared by several."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_covering_against_all_pairs(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(400), i) for i in range(500)] + [(None, 5, 1000), ("a", None, 1001), ("c", 7, 1002)]
    spans = []
    for i in range(300):
        start = rng.randrange(400)
        spans.append((rng.choice("ab"), start, start + rng.choice([0, 1, 5, 40, 300]), float(rng.randrange(6)), i))
    spans += [("a", 0, 399, 2.0, 900), ("a", 100, 90, 9.0, 901), ("b", None, 9, 9.0, 902), ("b", 1, None, 9.0, 903), (None, 0, 9, 9.0, 904), ("b", 0, 399, None, 905)]
    p = spark.createDataFrame(points, "chr string, pos long, no long").withColumn("start", F.lit("clash"))
    s = spark.createDataFrame(spans, "chr string, start long, end long, rank double, name long")
    got = {r["no"]: r["hit"] and tuple(r["hit"]) for r in sweep.covering(p, s, "rank", ["start", "end", "rank"]).collect()}
    assert len(got) == len(points)
    for chrom, pos, no in points:
        hits = [x for x in spans if None not in (chrom, pos, x[0], x[1], x[2], x[3]) and x[0] == chrom and x[1] <= pos <= x[2]]
        best = max(((x[3], x[1], x[2]) for x in hits), default=None)
        assert got[no] == (best and (best[1], best[2], best[0]))
    assert sweep.covering(p, s.where("false"), "rank", ["start"]).where("hit IS NOT NULL").count() == 0
    assert sweep.covering(p.where("false"), s, "rank", ["start"]).count() == 0


def test_earlier_rows_across_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.choice([None, *range(9)])) for i in range(700)]
    df = sweep.dealt(spark.createDataFrame(rows, "k string, i long, v long"), "k", "i")
    v = F.col("v")
    got = {r["i"]: r for r in sweep.earlier(df, ["k"], ["k", "i"], low=("min", v), high=("max", v), total=("sum", v), n=("count", v), last=("last", v)).collect()}
    seen = defaultdict(list)
    for k, i, v in rows:
        known = [x for x in seen[k] if x is not None]
        want = (min(known, default=None), max(known, default=None), sum(known), len(known), known[-1] if known else None)
        assert tuple(got[i][c] for c in ("low", "high", "total", "n", "last")) == want
        seen[k].append(v)


def test_merged_intervals(spark):
    rng = random.Random(3)
    rows = [(c, s, s + rng.randrange(12)) for c in "ab" for s in (rng.randrange(2000) for _ in range(250))] + [("c", 5, 5), ("c", 5, 5)]
    got = sorted(tuple(r) for r in joins.merge_intervals(spark.createDataFrame(rows, "chr string, start long, end long"), 1).collect())
    want = []
    for c, s, e in sorted(rows):
        if want and want[-1][0] == c and s <= want[-1][2] + 1:
            want[-1] = (c, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((c, s, e, 1))
    assert got == sorted(want)


RECORDS = "chr string, start long, end long, ref string, alt string, gt string, ad array<int>, depth int, is_block boolean, masked boolean, skipped boolean"


def test_overlay_calls_by_kind_of_record(spark):
    records = [
        ("1", 1, 60, "A", "", "0/0", None, 9, True, False, False),
        ("1", 70, 70, "A", "G", "1/1", [0, 5], 5, False, False, False),
        ("1", 71, 73, "ACG", "T", "0/1", [4, 5], 9, False, False, False),
        ("1", 74, 74, "C", "TTT", "1/1", [0, 3], 3, False, False, False),
        ("1", 75, 76, "CA", "G", "0/0", [2, 0], 2, False, False, False),
        ("1", 77, 77, "C", "GG", "1/1", [0, 2], 2, False, False, False),
        ("1", 78, 78, "C", "GG", "1/1", None, None, False, None, None),
        ("1", 79, 79, "C", "GG", "1/1", [0, 9], 9, False, True, False),
        ("1", 80, 82, "C", "", "0|0", None, 0, True, False, False),
        ("1", 83, 84, "C", "", "0/0", None, 5, True, True, False),
        ("1", 85, 86, "C", "", "1/1", None, 5, True, False, False),
        ("1", 87, 88, "C", "", "0/0", None, 5, True, False, True),
        ("1", 20, 21, "AC", "T", "1/1", [0, 8], 8, False, False, False),
    ]
    reference = spark.createDataFrame([("1", i, "ACGT"[i % 4]) for i in range(1, 91)], "chr string, pos long, base string")
    rows = {r["pos"]: r for r in gvcf.overlay(reference, spark.createDataFrame(records, RECORDS)).collect()}
    text = lambda a, b: [rows[i]["called"] for i in range(a, b + 1)]
    assert text(1, 19) == ["ACGT"[i % 4] for i in range(1, 20)] and text(20, 22) == ["T", "", "G"]
    assert text(61, 79) == ["N"] * 9 + ["G", "NNN", "", "", "TTT", "CA", "", "NN", "N", "NN"]
    assert text(80, 90) == ["N"] * 7 + ["", "", "N", "N"]
    assert [rows[i]["state"] for i in (5, 65, 71, 74, 75, 77, 78, 80, 85, 87)] == ["reference", "uncovered", "het", "alternate", "low_reference", "low_alternate", "zero", "zero", "block_alternate", "skipped"]
    total = gvcf.counters(gvcf.overlay(reference, spark.createDataFrame(records, RECORDS))).first()
    assert total["ref_size"] == 90 and total["size"] == sum(len(r["called"]) for r in rows.values()) and (total["het"], total["hom_ref_low"], total["hom_alt_low"]) == (3, 2, 2)
    assert total["alt"] == 1 + 3 + 2 + 1


def test_flipped_bits_and_regions(spark):
    r = spark.createDataFrame([("1", 1, 5, False, False), ("1", 6, 9, False, True), ("1", 10, 12, True, False), ("1", 13, 20, False, False)], "chr string, start long, end long, masked boolean, skipped boolean")
    keys = spark.createDataFrame([("1", 6), ("1", 10), ("2", 1), ("1", 6)], "chr string, start long")
    flipped = gvcf.flag(r, keys, "masked")
    assert sorted((x["start"], x["masked"]) for x in flipped.collect()) == [(1, False), (6, True), (10, False), (13, False)]
    assert sorted(tuple(x) for x in gvcf.covered_regions(r).collect()) == [("1", 1, 5, 1), ("1", 10, 20, 2)]
    assert gvcf.covered_regions(gvcf.flag(r, keys, "skipped")).count() == 2


def test_gvcf_file_to_overlay(spark, tmp_path):
    (tmp_path / "x.gvcf").write_text("##x\n#CHROM\tPOS\nchr1\t1\t.\tA\t<NON_REF>\t.\t.\tEND=5\tGT:DP:GQ\t0/0:7:30\nchr1\t6\t.\tA\tG,<NON_REF>\t.\t.\tDP=9\tGT:AD:DP\t1/1:0,9,0:9\nchr1\t7\t.\tA\tT,<NON_REF>\t.\t.\tDP=9\tGT:AD:DP\t0/1:4,5,0:9\n")
    records = gvcf.from_records(readers.read_gvcf(spark, str(tmp_path / "x.gvcf")))
    reference = spark.createDataFrame([("1", i, "A") for i in range(1, 9)], "chr string, pos long, base string")
    assert [r["called"] for r in gvcf.overlay(reference, records).orderBy("pos").collect()] == [*"AAAAAGNN"]


def plain_variants(cells, sites):
    """Records and calls by walking the sites in order."""
    order = sorted(sites, key=lambda s: (s[1], s[2], s[0]))
    indel = {s for _, s, a, b in cells if {a, b} & {4, 5}}
    blocks = []
    for site, chrom, pos, ref in order:
        last = blocks[-1][-1] if blocks else None
        if last and last[1] == chrom and last[2] + 1 >= pos and (ref in (4, 5) or site in indel):
            blocks[-1].append((site, chrom, pos, ref))
        else:
            blocks.append([(site, chrom, pos, ref)])
    letter = lambda c: "N" if c is None or c > 5 else "" if c > 3 else "ACGT"[c]
    of = {(t, s): (a, b) for t, s, a, b in cells}
    records, calls = [], {}
    for block in blocks:
        ref, strings = "".join(letter(s[3]) for s in block), {}
        for t in sorted({t for t, s in of if s in {x[0] for x in block}}):
            both = [[letter(of.get((t, s[0]), (None, None))[k]) for s in block] for k in (0, 1)]
            strings[t] = ["".join(x) for x in both]
        known = Counter(x for pair in strings.values() for x in pair if x.strip("N") or not x)
        start, pad = block[0][2], lambda x: x
        if not ref or "" in known:
            pad = (lambda x: "N" + x) if start > 1 else (lambda x: x + "N")
            start -= start > 1
        alts = [pad(a) for a, _ in sorted(known.items(), key=lambda x: (-x[1], x[0])) if a != ref]
        records.append((block[0][1], start, start + len(pad(ref)) - 1, pad(ref), tuple(alts), len(block)))
        for t, pair in strings.items():
            calls[t, block[0][1], start, len(records)] = tuple(pad(x) if x in known else None for x in pair)
    return sorted(records), Counter((t, c, s, *v) for (t, c, s, _), v in calls.items() if v != (None, None))


def test_merged_variants_and_their_file(spark, tmp_path):
    rng = random.Random(6)
    sites, pos = [], {"1": 0, "2": 3}
    for site in range(160):
        chrom = "1" if site < 110 else "2"
        pos[chrom] += rng.choice([0, 1, 1, 1, 1, 4]) or (site == 0)
        sites.append((site, chrom, pos[chrom], rng.choice([0, 1, 2, 3, 3, 4, 5])))
    cells = [(f"t{t}", s[0], *(rng.choice([0, 1, 2, 3, 4, 5, None]) for _ in range(2))) for t in range(4) for s in sites if rng.random() < 0.9]
    c = spark.createDataFrame(cells, "taxon string, site long, a1 int, a2 int")
    s = spark.createDataFrame(sites, "site long, chr string, pos long, ref int")
    records, calls = variants.merged_variants(c, s)
    want, want_calls = plain_variants(cells, sites)
    assert sorted((r["chr"], r["start"], r["end"], r["ref"], tuple(r["alts"]), r["n_sites"]) for r in records.collect()) == want
    assert max(r[5] for r in want) > 5  # a run over several ranges
    variants.write_variants(records, calls, str(tmp_path / "v"))
    back = variants.read_variants(spark, str(tmp_path / "v")).where("x IS NOT NULL OR y IS NOT NULL").collect()
    assert Counter((r["taxon"], r["chr"], r["start"], r["x"], r["y"]) for r in back) == want_calls


def test_known_variants_follow_the_seen_ones(spark):
    c = spark.createDataFrame([("t", 1, 0, 2), ("u", 1, None, None)], "taxon string, site long, a1 int, a2 int")
    s = spark.createDataFrame([(1, "1", 9, 0, ["A", "T", "G"]), (2, "1", 20, 3, None)], "site long, chr string, pos long, ref int, known array<string>")
    records, calls = variants.merged_variants(c, s)
    assert sorted((r["start"], r["ref"], r["alts"]) for r in records.collect()) == [(9, "A", ["G", "T"]), (20, "T", [])]
    assert sorted(((r["taxon"], r["g1"], r["g2"]) for r in calls.collect()), key=str) == [("t", 0, 1), ("u", None, None)]
