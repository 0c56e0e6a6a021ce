"""Text formats: VCF, phenotypes, covariates, gene, set, site, sample and kinship files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genotypes as G


def read_vcf(spark: SparkSession, path: str, region: str | None = None, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sites, calls) of VCF text files, plain or compressed, and of BCF files.

    Bgzipped VCF (.vcf.gz, .vcf.bgz) and BCF files are split by blocks, and with a region (`chrom:beg-end`) only its blocks are
    read, see ranged.LinesReader; other text is read by Spark unless a region is asked for.

    sites: variant_id (a hash of chrom, pos, ref and alt), chrom, pos, id, ref, alt, qual, filter, info; calls: variant_id,
    sample, gt, gd, gq, g, sparse: hom-ref cells are left out, missing ones kept. FORMAT is resolved on every row by exact
    tag. Each file's own header gives its sample names, as rows (file, place, sample) that its cells are joined with. Where
    only one file has a header it is that of all, as for the parts of one written set; else a file without one is an
    error, and so are repeated names."""
    if region or path.endswith((".vcf.gz", ".vcf.bgz", ".bcf")):
        from . import ranged

        lines = ranged.source(spark, ranged.Lines, path, region=region, split=split)
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.startswith("value", F.lit("#CHROM"))).select("file", F.slice(F.split(F.regexp_replace("value", r"\s+$", ""), "\t"), 10, 1 << 30).alias("names"))
    odd = heads.where(F.size(F.array_distinct("names")) < F.size("names")).first()
    if odd:
        raise ValueError(f"sample names repeat in {odd.file}")
    cut = F.split(F.rtrim(F.regexp_replace("value", "\r$", "")), "\t")
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0)).select("file", cut.alias("f"))
    key = ["place"] if heads.count() == 1 else ["file", "place"]
    bare = rows.select("file").distinct().join(heads, "file", "left_anti").first() if len(key) > 1 else None
    if bare:
        raise ValueError(f"no header in {bare.file}")
    names = heads.select("file", F.posexplode("names").alias("place", "sample"))
    at = lambda k: F.col("f")[k]
    site = rows.select(
        F.xxhash64(at(0), at(1), at(3), at(4)).alias("variant_id"), G.chop_chr(at(0)).alias("chrom"), at(1).cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"),
        F.expr("try_cast(f[5] as double)").alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("form"), F.slice("f", 10, 1 << 30).alias("cells"), "file",
    )
    sites = site.drop("form", "cells", "file")
    long = site.select("variant_id", "file", "form", F.posexplode("cells").alias("place", "cell"))
    number = lambda tag: F.coalesce(G.field(F.col("cell"), F.col("form"), tag).try_cast("int"), F.lit(0))
    calls = long.select("variant_id", "file", "place", G.field(F.col("cell"), F.col("form"), "GT").alias("gt"), number("GD").alias("gd"), number("GQ").alias("gq"))
    # hom-ref cells go before the names are joined
    calls = calls.withColumn("g", G.alt_count(F.col("gt"))).where(F.col("g").isNull() | (F.col("g") > 0)).join(names if len(key) > 1 else names.drop("file"), key)
    return sites, calls.select("variant_id", "sample", "gt", "gd", "gq", "g")


def vcf_lines(sites: DataFrame, calls: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, pos, line) of VCF data lines: GT:GD:GQ for carriers and missing calls, 0/0 for absent pairs."""
    cell = F.concat_ws(":", F.when(F.col("g").isNull(), "./.").when(F.col("g") == 1, "0/1").otherwise("1/1"), F.col("gd").cast("string"), F.col("gq").cast("string"))
    maps = calls.groupBy("variant_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sample"), cell))).alias("m"))
    # one row with all names, so that the plan doesn't grow with the samples
    order = sites.sparkSession.createDataFrame([(samples,)], "names array<string>")
    rows = sites.join(maps, "variant_id", "left").join(F.broadcast(order))
    cells = F.array_join(F.transform("names", lambda s: F.coalesce(F.try_element_at("m", s), F.lit("0/0:0:0"))), "\t")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return rows.select("chrom", "pos", F.concat_ws("\t", *[text(c) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")], F.lit("GT:GD:GQ"), cells).alias("line"))


def write_vcf(sites: DataFrame, calls: DataFrame, samples: list[str], path: str) -> None:
    """Write VCF text sorted by chromosome and position over partitions; the header goes in the first file."""
    spark = sites.sparkSession
    header = spark.createDataFrame([(-1, "##fileformat=VCFv4.2"), (0, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))], "pos long, line string").select(F.lit("").alias("chrom"), "pos", "line")
    header.unionByName(vcf_lines(sites, calls, samples)).orderBy("chrom", "pos").select("line").write.text(path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("line")).where(F.col("f")[0] != "")


def read_pedigree(spark: SparkSession, path: str, traits: list[str]) -> DataFrame:
    """(fid, iid, father, mother, sex, traits...) of a phenotype file with a header; text that isn't a number is null and
    samples that repeat go altogether. Sex is 1 or 2, else null."""
    header = [x.lower() for x in spark.read.text(path).first().value.split()]
    rows = _table(spark, path).where(F.lower(F.col("f")[0]) != "fid")
    value = lambda c: F.try_element_at("f", F.lit(header.index(c.lower()) + 1)).try_cast("double").alias(c)
    parent = lambda k: F.nullif(F.col("f")[k], F.lit("0"))
    sex = F.col("f")[4].try_cast("int")
    out = rows.select(F.col("f")[0].alias("fid"), F.col("f")[1].alias("iid"), parent(2).alias("father"), parent(3).alias("mother"), F.when(sex.isin(1, 2), sex).alias("sex"), *[value(t) for t in traits])
    once = out.groupBy("iid").agg(F.count("*").alias("k")).where("k = 1").select("iid")
    return out.join(once, "iid", "left_semi")


def read_covariates(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(fid, iid, covariates...) of a file whose header starts with FID IID; the first of repeated samples stays."""
    header = spark.read.text(path).first().value.split()
    if [x.lower() for x in header[:2]] != ["fid", "iid"]:
        raise ValueError("a covariate file starts with FID IID")
    names = names or header[2:]
    rows = _table(spark, path).where(F.lower(F.col("f")[0]) != "fid")
    values = [F.try_element_at("f", F.lit(header.index(c) + 1)).try_cast("double").alias(c) for c in names]
    first = rows.groupBy(F.col("f")[1].alias("iid")).agg(F.min("line").alias("line"))
    return rows.join(first.select("line"), "line", "left_semi").select(F.col("f")[0].alias("fid"), F.col("f")[1].alias("iid"), *values)


def read_models(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(responses, predictors) of a model list: two columns, terms joined by + or comma; 1 is the intercept."""
    rows = [r.value.split() for r in spark.read.text(path).collect()]  # a hand-written list
    terms = lambda x: [t for t in x.replace(",", "+").split("+") if t]
    return [(terms(r[0]), [t for t in terms(r[1]) if t != "1"]) for r in rows if len(r) > 1 and r[0].lower() != "pheno"]


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, chrom, beg, end) of a refFlat file: columns 0, 2, 4 and 5."""
    f = _table(spark, path).where(F.size("f") >= 6)
    return f.select(F.col("f")[0].alias("gene"), G.chop_chr(F.col("f")[2]).alias("chrom"), F.col("f")[4].cast("long").alias("beg"), F.col("f")[5].cast("long").alias("end"))


def ranges(text: Column) -> Column:
    """chrom:beg-end, chrom:beg and chrom:beg- as a struct of a closed interval."""
    where = F.split(text, ":")
    ends = F.split(where[1], "-")
    end = F.when(F.size(ends) == 1, ends[0]).when(ends[1] == "", F.lit(str(1 << 29))).otherwise(ends[1])
    return F.struct(G.chop_chr(where[0]).alias("chrom"), ends[0].try_cast("long").alias("beg"), end.try_cast("long").alias("end"))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(gene, chrom, beg, end) of a set file: a name and a comma list of ranges."""
    rows = _table(spark, path).where(F.size("f") >= 2).select(F.col("f")[0].alias("gene"), F.explode(F.split(F.col("f")[1], ",")).alias("r"))
    return rows.select("gene", ranges(F.col("r")).alias("x")).select("gene", "x.*").where("beg IS NOT NULL")


def read_sites(spark: SparkSession, path: str, kind: str = "site") -> DataFrame:
    """(chrom, pos) of site (chr:pos or chr pos), bim, rod (0-based) and bed (half-open, expanded) files."""
    f = _table(spark, path)
    c = F.col("f")
    if kind == "site":
        both = F.split(F.array_join("f", ":"), ":")
        out = f.select(both[0].alias("chrom"), both[1].try_cast("long").alias("pos"))
    elif kind == "bim":
        out = f.select(c[0].alias("chrom"), c[3].try_cast("long").alias("pos"))
    elif kind == "rod":
        out = f.select(c[0].alias("chrom"), (c[2].try_cast("long") + 1).alias("pos"))
    else:
        beg, end = c[1].try_cast("long"), c[2].try_cast("long")
        out = f.where(beg < end).select(c[0].alias("chrom"), F.explode(F.sequence(beg + 1, end)).alias("pos"))
    return out.where("pos IS NOT NULL").withColumn("chrom", G.chop_chr(F.col("chrom")))


def read_bgen_samples(spark: SparkSession, path: str) -> DataFrame:
    """(id_1, id_2, missing) of a sample file; its second line holds types."""
    f = _table(spark, path).where("line >= 2")
    return f.select(F.col("f")[0].alias("id_1"), F.col("f")[1].alias("id_2"), F.col("f")[2].try_cast("double").alias("missing"))


def read_kinship(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, kinship) of a matrix file FID IID id1 ... idn, in long form. The header is a row that the others are joined with, so
    the plan doesn't grow with the samples."""
    lines = _table(spark, path)
    head = lines.where(F.lower(F.col("f")[0]) == "fid").select(F.slice("f", 3, 1 << 30).alias("names"))
    rows = lines.where(F.lower(F.col("f")[0]) != "fid").join(F.broadcast(head))
    pairs = F.arrays_zip("names", F.slice("f", 3, 1 << 30).alias("k"))
    return rows.select(F.col("f")[1].alias("i"), F.explode(pairs).alias("p")).select("i", F.col("p.names").alias("j"), F.col("p.k").try_cast("double").alias("kinship"))


def write_results(rows: DataFrame, path: str) -> None:
    """Tab-separated results with a header, NA for null."""
    rows.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def write_sorted(rows: DataFrame, path: str) -> None:
    """Parquet sorted by (chrom, pos) over partitions: a range query reads only the row groups that hold it."""
    rows.orderBy("chrom", "pos").write.partitionBy("chrom").parquet(path) if "chrom" in rows.columns else rows.write.parquet(path)
