"""Writers of genotype, matrix, phenotype and report files.

Rows of a file are made in Spark and written by the text or csv sink, sorted by range
partitions so that part files follow each other; ``single=True`` makes one part, for
small exports. Sample columns of a wide file are given or found by one aggregate.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions import codes
from locusframe.operators.scalars import chromosome_key, genotype_scores
from locusframe.operators.summary import allele_counts
from locusframe.sources.readers import HAPMAP_COLUMNS


def _taxa(rows: DataFrame, column: str = "taxon") -> list[str]:
    """Names of the sample columns: one distinct aggregate; a wide file has a column for each anyway."""
    return [r[0] for r in rows.select(F.col(column).cast("string").alias("t")).distinct().orderBy("t").collect()]


def _wide(rows: DataFrame, keys: list[str], taxa: list[str], cell: Column, missing: str) -> DataFrame:
    """``keys`` and the list ``cells`` in the order of ``taxa``: one group for each site, no pivot over columns."""
    m = rows.select(*keys, F.col("taxon").cast("string").alias("t"), cell.alias("c")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("m"))
    return m.select(*keys, F.transform(F.array(*[F.lit(t) for t in taxa]), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(missing))).alias("cells"))


def _write(body: DataFrame, line: Column, header: list[str], path: str, order: list, single: bool, footer: list[str] | None = None) -> None:
    """A text file: header lines first, then ``line`` of each row of ``body`` by ``order``, then the footer's lines."""
    spark = body.sparkSession
    rows = body.select(F.lit(1).alias("_k"), *[o.alias(f"_o{i}") if isinstance(o, Column) else F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], line.alias("value"))
    kinds = [f for f in rows.schema.fields if f.name.startswith("_o")]
    top = spark.createDataFrame([(k, i, h) for k, part in ((0, header), (2, footer or [])) for i, h in enumerate(part)], "_k int, n int, value string")
    top = top.select("_k", "n", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds], "value")
    every = top.unionByName(rows.withColumn("n", F.lit(0)))
    by = ["_k", "n", *[f.name for f in kinds]]
    ordered = every.repartitionByRange(1, *by) if single else every.repartitionByRange(*by)
    ordered.sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


def write_hapmap(cells: DataFrame, path: str, diploid: bool = False, single: bool = False) -> None:
    """``taxon, chr, pos, a1, a2`` cells as Hapmap: alleles by frequency, IUPAC or two letters, N or NN where unknown."""
    taxa = _taxa(cells)
    site = cells.withColumn("site", F.struct("chr", "pos"))
    ranks = allele_counts(site).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rk", "allele"))).alias("r"))
    names = ranks.select("site.*", F.array_join(F.transform("r", lambda x: codes.letter(x["allele"])), "/").alias("alleles"))
    call = codes.diploid(F.col("a1"), F.col("a2")) if diploid else codes.iupac(F.col("a1"), F.col("a2"))
    wide = _wide(cells, ["chr", "pos"], taxa, call, "NN" if diploid else "N").join(names, ["chr", "pos"], "left")
    fixed = [F.concat(F.lit("S"), F.col("chr"), F.lit("_"), F.col("pos")), F.coalesce("alleles", F.lit("NA")), F.col("chr"), F.col("pos").cast("string"), F.lit("+"), *[F.lit("NA")] * 6]
    _write(wide, F.concat_ws("\t", *fixed, "cells"), ["\t".join([*HAPMAP_COLUMNS, *taxa])], path, [chromosome_key(F.col("chr")), "pos"], single)


def write_vcf(cells: DataFrame, path: str, single: bool = False) -> None:
    """Cells (``taxon, chr, pos, a1, a2`` and, where it is a column, the list ``depth`` by code) as VCF 4.2: the most frequent allele is REF.

    Indel sites get an N before each allele. With depth: AD of the listed alleles, DP, and PL and GQ of the first two.
    """
    taxa, deep = _taxa(cells), "depth" in cells.columns
    site = cells.withColumn("site", F.struct("chr", "pos"))
    ranks = allele_counts(site).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "allele"))), lambda x: x["allele"]).alias("order"))
    rows = cells.join(ranks.select("site.*", "order"), ["chr", "pos"], "left").withColumn("order", F.coalesce("order", F.array().cast("array<bigint>")))
    at = lambda a: F.when(F.col(a).isNull(), ".").otherwise((F.array_position("order", F.col(a)) - 1).cast("string"))
    gt = F.concat(at("a1"), F.lit("/"), at("a2"))
    if deep:
        ad = F.transform("order", lambda o: F.coalesce(F.get(F.col("depth"), o.cast("int")), F.lit(0)))
        first, second = F.coalesce(F.get(ad, F.lit(0)), F.lit(0)), F.coalesce(F.get(ad, F.lit(1)), F.lit(0))
        s = genotype_scores(first, second)
        gt = F.concat_ws(":", gt, F.when(F.size("order") > 0, F.array_join(ad, ",")).otherwise("0"), F.aggregate(ad, F.lit(0), lambda x, y: x + y).cast("string"), s["gq"].cast("string"), F.concat_ws(",", s["aa"].cast("string"), s["ab"].cast("string"), s["bb"].cast("string")))
    wide = _wide(rows, ["chr", "pos", "order"], taxa, gt, "./." + ":0:0:0:0,0,0" * deep)
    indel = F.exists("order", lambda o: o >= 4)
    text = F.transform("order", lambda o: F.when(indel, F.concat(F.lit("N"), F.when(o == 5, F.lit("")).when(o == 4, F.lit("I")).otherwise(codes.letter(o)))).otherwise(codes.letter(o)))
    line = F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.concat(F.lit("S"), F.col("chr"), F.lit("_"), F.col("pos")), F.coalesce(F.get(text, F.lit(0)), F.lit("N")), F.when(F.size(text) > 1, F.array_join(F.slice(text, F.lit(2), F.size(text) - 1), ",")).otherwise("."), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:AD:DP:GQ:PL" if deep else "GT"), "cells")
    header = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    if deep:
        header += [f'##FORMAT=<ID={k},Number={n},Type=Integer,Description="{d}">' for k, n, d in (("AD", "R", "Allelic depths"), ("DP", "1", "Read depth"), ("GQ", "1", "Genotype quality"), ("PL", "G", "Phred-scaled likelihoods"))]
    _write(wide, line, [*header, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *taxa])], path, [chromosome_key(F.col("chr")), "pos"], single)


def _sequences(cells: DataFrame) -> DataFrame:
    """``taxon, seq``: IUPAC letters of each sample over all sites of the table, in order."""
    order = cells.select("chr", "pos").distinct().withColumn("o", F.row_number().over(Window.orderBy(chromosome_key(F.col("chr")), "pos")))  # a row for each site
    n = order.agg(F.max("o").alias("n"))
    rows = cells.join(order, ["chr", "pos"]).select(F.col("taxon").cast("string").alias("taxon"), "o", codes.iupac(F.col("a1"), F.col("a2")).alias("c"))
    m = rows.groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct("o", "c"))).alias("m")).crossJoin(F.broadcast(n))  # one row
    return m.select("taxon", F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("N"))), "").alias("seq"))


def write_plink(cells: DataFrame, path: str, single: bool = False) -> None:
    """``path/map`` and ``path/ped``; unknown is 0, a gap D, other fields -9."""
    sites = cells.select("chr", "pos").distinct()
    _write(sites, F.concat_ws("\t", "chr", F.concat(F.lit("S"), F.col("chr"), F.lit("_"), F.col("pos")), F.lit("-9"), F.col("pos").cast("string")), [], f"{path}/map", [chromosome_key(F.col("chr")), "pos"], single)
    order = sites.withColumn("o", F.row_number().over(Window.orderBy(chromosome_key(F.col("chr")), "pos")))
    name = lambda c: F.translate(codes.letter(F.col(c)), "N-", "0D")
    rows = cells.join(order, ["chr", "pos"]).select("taxon", "o", F.concat(name("a1"), F.lit(" "), name("a2")).alias("c"))
    n = order.agg(F.max("o").alias("n"))
    m = rows.groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct("o", "c"))).alias("m")).crossJoin(F.broadcast(n))
    line = F.concat_ws("\t", F.lit("-9"), F.col("taxon").cast("string"), *[F.lit("-9")] * 4, F.transform(F.sequence(F.lit(1), "n"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("0 0"))))
    _write(m, line, [], f"{path}/ped", [F.col("taxon").cast("string")], single)


def write_delimited(cells: DataFrame, path: str, delimiter: str = "\t", single: bool = False) -> None:
    """Samples as rows, positions as columns."""
    sites = [(r["chr"], r["pos"]) for r in cells.select("chr", "pos").distinct().orderBy(chromosome_key(F.col("chr")), "pos").collect()]  # the file's columns
    s = _sequences(cells)
    _write(s, F.concat_ws(delimiter, "taxon", F.filter(F.split("seq", ""), lambda x: x != "")), [delimiter.join(["Taxa", *[f"S{c}_{p}" for c, p in sites]])], path, ["taxon"], single)


def write_phylip(cells: DataFrame, path: str, single: bool = False) -> None:
    """Sequential: a line of counts, then a padded name and the sequence in blocks of ten for each sample."""
    s = _sequences(cells)
    n = s.agg(F.count("*").alias("t"), F.max(F.length("seq")).alias("n")).first()
    _write(s, F.concat(F.rpad(F.substring("taxon", 1, 10), 10, " "), F.trim(F.regexp_replace("seq", "(.{10})", "$1 "))), [f"{n['t']} {n['n'] or 0}"], path, ["taxon"], single)


def write_phylip_interleaved(cells: DataFrame, path: str, single: bool = False) -> None:
    """Rows of 50 letters in blocks of ten, a block of all samples after another; names stand in the first one only."""
    s = _sequences(cells)
    n = s.agg(F.count("*").alias("t"), F.max(F.length("seq")).alias("n")).first()
    parts = s.select("taxon", F.posexplode(F.filter(F.split(F.regexp_replace("seq", "(.{50})", "$1\n"), "\n"), lambda x: x != "")).alias("b", "part"))
    name = F.when(F.col("b") == 0, F.rpad(F.substring("taxon", 1, 10), 10, " ")).otherwise(F.repeat(F.lit(" "), 10))
    _write(parts, F.concat(name, F.trim(F.regexp_replace("part", "(.{10})", "$1 "))), [f"{n['t']} {n['n'] or 0}"], path, ["b", "taxon"], single)


def write_clustalw(cells: DataFrame, path: str, single: bool = False) -> None:
    """The sequences in rows of 50, a block of all samples after another."""
    s = _sequences(cells)
    parts = s.select("taxon", F.posexplode(F.filter(F.split(F.regexp_replace("seq", "(.{50})", "$1\n"), "\n"), lambda x: x != "")).alias("b", "part"))
    _write(parts, F.concat(F.rpad("taxon", 16, " "), F.col("part")), ["CLUSTAL W", ""], path, ["b", "taxon"], single)


def write_fasta(cells: DataFrame, path: str, gaps: bool = True, single: bool = False) -> None:
    """A record for each sample; without gaps the letter - is dropped."""
    s = _sequences(cells)
    seq = F.col("seq") if gaps else F.translate("seq", "-", "")
    _write(s, F.concat(F.lit(">"), F.col("taxon"), F.lit("\n"), seq), [], path, ["taxon"], single)


def write_called_sequence(called: DataFrame, path: str, width: int = 80, single: bool = False) -> None:
    """A FASTA record for each chromosome of ``chr, pos, called`` rows (N where masked), in position order, in lines of ``width``."""
    parts = called.withColumn("line", F.floor((F.row_number().over(Window.partitionBy("chr").orderBy("pos")) - 1) / width))
    rows = parts.groupBy("chr", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "called"))), lambda x: x["called"]), "").alias("s"))
    first = F.when(F.col("line") == 0, F.concat(F.lit(">"), F.col("chr"), F.lit("\n"))).otherwise("")
    _write(rows, F.concat(first, F.col("s")), [], path, [chromosome_key(F.col("chr")), "line"], single)


def write_scores(cells: DataFrame, path: str, value: str, single: bool = False) -> None:
    """A numeric column of the cells (depth, reference probability) as a samples by sites table."""
    taxa = _taxa(cells)
    wide = _wide(cells, ["chr", "pos"], taxa, F.col(value).cast("string"), "NaN")
    _write(wide, F.concat_ws("\t", "chr", F.col("pos").cast("string"), "cells"), ["\t".join(["chr", "pos", *taxa])], path, [chromosome_key(F.col("chr")), "pos"], single)


def _full(m: DataFrame) -> DataFrame:
    return m.select("i", "j", "value").unionByName(m.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def write_square_matrix(m: DataFrame, path: str, comments: dict[str, str] | None = None, single: bool = False) -> None:
    """``##key=value`` lines, the count, then a name and all values on each row."""
    rows = _full(m).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: x["value"].cast("string")).alias("v"))
    _write(rows, F.concat_ws("\t", F.col("i").cast("string"), "v"), [*[f"##{k}={v}" for k, v in (comments or {}).items()], str(rows.count())], path, ["i"], single)


def write_grm_raw(m: DataFrame, path: str, single: bool = False) -> None:
    """``i j n value`` of the lower triangle, places from 1."""
    place = _places(m)
    rows = m.join(place.select(F.col("name").alias("i"), F.col("o").alias("x")), "i").join(place.select(F.col("name").alias("j"), F.col("o").alias("y")), "j")
    n = F.col("n") if "n" in m.columns else F.lit(1)
    _write(rows, F.concat_ws("\t", F.greatest("x", "y").cast("string"), F.least("x", "y").cast("string"), n.cast("string"), F.col("value").cast("string")), [], path, [F.greatest("x", "y"), F.least("x", "y")], single)


def _places(m: DataFrame) -> DataFrame:
    names = m.select(F.col("i").alias("name")).unionByName(m.select(F.col("j").alias("name"))).distinct()
    return names.withColumn("o", F.row_number().over(Window.orderBy("name")))  # a row for each sample


def write_darwin(m: DataFrame, path: str, single: bool = False) -> None:
    """``path/don`` (names) and ``path/dis`` (lower triangle without the diagonal), places from 1."""
    place = _places(m)
    n = place.count()
    _write(place, F.concat_ws("\t", F.col("o").cast("string"), F.col("name").cast("string")), ["@DARwin 5.0 - DON", f"{n}\t1", "N°\tTaxa"], f"{path}/don", ["o"], single)
    rows = m.where("i <> j").join(place.select(F.col("name").alias("i"), F.col("o").alias("x")), "i").join(place.select(F.col("name").alias("j"), F.col("o").alias("y")), "j")
    rows = rows.groupBy(F.greatest("x", "y").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.least("x", "y").alias("y"), "value"))), lambda c: c["value"].cast("string")).alias("v"))
    top = ["@DARwin 5.0 - DIS", str(n), "\t" + "\t".join(str(k + 1) for k in range(max(0, n - 1)))]
    _write(rows, F.concat_ws("\t", F.col("x").cast("string"), "v"), top, f"{path}/dis", ["x"], single)


def write_phylip_distance(m: DataFrame, path: str, single: bool = False) -> None:
    """Six values to a line, five decimals."""
    rows = _full(m).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: F.format_string("%.5f", x["value"])).alias("v"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 6).cast("int")), lambda k: F.array_join(F.slice(F.col("v"), k * 6 + 1, F.lit(6)), " "))
    _write(rows, F.concat(F.rpad(F.col("i").cast("string"), 10, " "), F.array_join(groups, "\n")), [str(rows.count())], path, ["i"], single)


def write_phenotype(pheno: DataFrame, path: str, roles: dict[str, str] | None = None, single: bool = False) -> None:
    """A ``<Phenotype>`` table; roles from the columns' metadata or ``roles``; a missing value is NaN, a missing factor ?."""
    role = {f.name: (roles or {}).get(f.name) or f.metadata.get("role") or ("taxa" if f.name == "taxon" else "factor" if f.dataType.simpleString() == "string" else "data") for f in pheno.schema.fields}
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("?" if role[c] in ("taxa", "factor") else "NaN")) for c in pheno.columns]
    head = ["<Phenotype>", "\t".join(role[c] for c in pheno.columns), "\t".join(pheno.columns)]
    _write(pheno, F.concat_ws("\t", *cells), head, path, [pheno.columns[0]], single)


def write_plink_phenotype(pheno: DataFrame, path: str, single: bool = False) -> None:
    """Family and individual id (both the sample), then data and covariates; missing is NA."""
    values = [f.name for f in pheno.schema.fields if f.name != "taxon" and f.dataType.simpleString() != "string"]
    t = F.col("taxon").cast("string")
    _write(pheno, F.concat_ws("\t", t, t, *[F.coalesce(F.col(v).cast("string"), F.lit("NA")) for v in values]), ["\t".join(["FID", "IID", *values])], path, ["taxon"], single)


def report_number(x: Column) -> Column:
    """Five decimals at most; scientific form below 0.001 and from a million on (so for all negative numbers)."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", x), "0+$", ""), r"\.$", "")
    e = F.floor(F.log10(F.abs(x))).cast("int")
    m = x / F.pow(F.lit(10.0), e)
    up = F.abs(F.round(m, 3)) >= 10
    mant = F.regexp_replace(F.format_string("%.3f", F.when(up, m / 10).otherwise(m)), r"(\.\d)0{1,2}$", "$1")
    mant = F.regexp_replace(mant, r"(\.\d\d)0$", "$1")
    return F.when(x.isNull() | F.isnan(x), "NaN").when(x == 0, "0").when((x < 0.001) | (x >= 1e6), F.concat(mant, F.lit("E"), F.when(up, e + 1).otherwise(e).cast("string"))).otherwise(plain)


def write_table(rows: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """A tab-delimited report with a header."""
    cells = [report_number(F.col(f.name)) if f.dataType.simpleString() in ("double", "float") else F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in rows.schema.fields]
    _write(rows, F.concat_ws("\t", *cells), ["\t".join(rows.columns)], path, order or [rows.columns[0]], single)


def _write_items(items: DataFrame, name: str, order: list, path: str, single: bool) -> None:
    """``{name: [...]}`` with an item (JSON text ``t``) on each line, by ``order``, then text. Repeated items are written as often as they come."""
    keyed = items.select(*[o.alias(f"s{i}") for i, o in enumerate(order)], "t").groupBy(*[f"s{i}" for i in range(len(order))], "t").agg(F.count("*").alias("n"))
    key = F.struct(*[f"s{i}" for i in range(len(order))], "t")
    lead = keyed.crossJoin(F.broadcast(keyed.agg(F.min(key).alias("first"))))  # one row
    line = F.concat(F.when(key.eqNullSafe(F.col("first")), "").otherwise(","), F.array_join(F.array_repeat("t", F.col("n").cast("int")), ","))
    _write(lead, line, [f'{{"{name}":['], path, [*[f"s{i}" for i in range(len(order))], "t"], single, ["]}"])


def write_taxa_json(taxa: DataFrame, path: str, single: bool = False) -> None:
    """``name, anno`` as one ``TaxaList`` object, a sample on each line. Parts of several files make the object one after another."""
    quoted = F.regexp_extract(F.to_json(F.array("name")), r"^\[(.*)\]$", 1)
    rows = taxa.select("name", F.concat(F.lit('{"name":'), quoted, F.lit(',"anno":'), F.coalesce(F.to_json("anno"), F.lit("{}")), F.lit("}")).alias("t"))
    _write_items(rows, "TaxaList", [F.col("name")], path, single)


def write_positions_json(sites: DataFrame, path: str, single: bool = False) -> None:
    """``chr, pos`` (and ``snp``, ``maf``, ``strand`` where they are columns) as one ``PositionList`` object, a site on each line."""
    named = {"snp": "SNPID", "maf": "globalMAF", "strand": "strand"}
    fields = [F.struct(F.col("chr").alias("name")).alias("chr"), F.col("pos").alias("position"), *[F.col(k).alias(v) for k, v in named.items() if k in sites.columns]]
    _write_items(sites.withColumn("t", F.to_json(F.struct(*fields))), "PositionList", [chromosome_key(F.col("chr")), F.col("pos")], path, single)


def write_filter_json(spec: object, spark, path: str) -> None:
    """A filter's settings."""
    from dataclasses import asdict

    spark.createDataFrame([(json.dumps(asdict(spec)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_taxa_table(taxa: DataFrame, path: str, keys: list[str], single: bool = False) -> None:
    """A ``<TaxaList>`` table of ``name, anno`` with a column for each key."""
    cells = [F.array_join(F.coalesce(F.try_element_at("anno", F.lit(k)), F.array().cast("array<string>")), ";") for k in keys]
    _write(taxa, F.concat_ws("\t", "name", *cells), ["<TaxaList>", "\t".join(["Taxa", *keys])], path, ["name"], single)


def numbered(path: str, n: int, total: int) -> str:
    """The path of the n-th of several exports: the number before the first dot of the file's name."""
    if total <= 1:
        return path
    folder, _, name = path.rpartition("/")
    stem, dot, rest = name.partition(".")
    return (f"{folder}/" if folder else "") + f"{stem}{n}{dot}{rest}"
