"""Sample, site and genotype filters. Each returns a DataFrame; predicates are plain Columns that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import genotypes as G


def include_samples(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of listed samples (ids(sample_id))."""
    return rows.join(ids, "sample_id", "left_semi")


def exclude_samples(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of samples that aren't listed; applied after inclusion."""
    return rows.join(ids, "sample_id", "left_anti")


def rename_samples(rows: DataFrame, names: DataFrame) -> DataFrame:
    """sample_id by names(old_id, new_id); others keep theirs."""
    out = rows.join(names.withColumnRenamed("old_id", "sample_id"), "sample_id", "left")
    return out.withColumn("sample_id", F.coalesce("new_id", F.col("sample_id").cast("string"))).drop("new_id")


def sites_in(variants: DataFrame, sites: DataFrame) -> DataFrame:
    """Variants whose (chrom, pos) is listed."""
    return variants.join(sites, ["chrom", "pos"], "left_semi")


def sites_not_in(variants: DataFrame, sites: DataFrame) -> DataFrame:
    return variants.join(sites, ["chrom", "pos"], "left_anti")


def quality_at_least(least: float) -> Column:
    return F.col("qual") >= least


def passing() -> Column:
    return F.col("filter") == "PASS"


def biallelic_snp() -> Column:
    return F.col("ref").rlike("^[ACGTacgt]$") & F.col("alt").rlike("^[ACGTacgt]$")


def plink_chromosome() -> Column:
    """1 to 22, X, Y, XY and MT, with or without chr."""
    return F.regexp_replace(F.col("chrom").cast("string"), "^chr", "").rlike("^([1-9]|1[0-9]|2[0-6]|X|Y|XY|MT)$")


def annotated(pattern: str) -> Column:
    """The annotation matches the pattern; without annotation the site is rejected."""
    return F.coalesce(F.col("anno").rlike(pattern), F.lit(False))


def frequency_between(low: float, high: float) -> Column:
    return F.col("maf").between(low - 1e-10, high + 1e-10)


def minor_count_at_least(k: int, an: Column) -> Column:
    return F.least(F.col("ac"), an - F.col("ac")) >= k


def in_regions(regions: list[tuple]) -> Column:
    """The site lies in one of the closed intervals (chrom, beg, end), or (beg, end) on any chromosome."""
    out = F.lit(False)
    for *chrom, beg, end in regions:
        own = F.col("pos").between(beg, end)
        out = out | (own if not chrom else own & (G.chop_chr(F.col("chrom").cast("string")) == str(chrom[0])))
    return out


#: The pseudo-autosomal regions of X in the common build, and the names of X.
PAR = [(60_001, 2_699_520), (154_931_044, 155_270_560)]
X_NAMES = ("X", "23")


def on_x(names: tuple = X_NAMES) -> Column:
    return G.chop_chr(F.col("chrom").cast("string")).isin(*map(str, names))


def x_par(par: list[tuple[int, int]] = PAR, names: tuple = X_NAMES) -> Column:
    """Pseudo-autosomal sites of X."""
    return on_x(names) & in_regions(par)


def x_hemizygous(par: list[tuple[int, int]] = PAR, names: tuple = X_NAMES) -> Column:
    """Sites of X outside its pseudo-autosomal regions, where males have one copy."""
    return on_x(names) & ~in_regions(par)


def info_depth_between(low: int, high: int) -> Column:
    """DP of INFO within bounds; a site without it is rejected."""
    return F.coalesce(G.info_value(F.col("info"), "DP").try_cast("int").between(low, high), F.lit(False))


def info_frequency_between(low: float, high: float) -> Column:
    """AF of INFO, folded to the minor allele's, within bounds; a site without it is rejected."""
    af = G.info_value(F.col("info"), "AF").try_cast("double")
    return F.coalesce(F.least(af, 1 - af).between(low, high), F.lit(False))


def mask_genotypes(calls: DataFrame, least_gd: int = 0, most_gd: int | None = None, least_gq: int = 0) -> DataFrame:
    """Calls whose depth or quality is out of bounds become missing; an absent depth or quality counts as 0."""
    gd, gq = F.coalesce("gd", F.lit(0)), F.coalesce("gq", F.lit(0))
    ok = (gd >= least_gd) & (gq >= least_gq)
    if most_gd is not None:
        ok = ok & (gd <= most_gd)
    return calls.withColumn("g", F.when(ok, F.col("g")))


def site_depth(calls: DataFrame, low: int, high: int) -> DataFrame:
    """(variant_id, depth) of sites whose summed depth is within bounds."""
    return calls.groupBy("variant_id").agg(F.sum("gd").cast("long").alias("depth")).where(F.col("depth").between(low, high))


def site_qc(counts: DataFrame, hwe: DataFrame, least_maf: float, least_hwe: float, least_rate: float) -> DataFrame:
    """Variants of genotype counts that pass all bounds."""
    return counts.join(hwe, "variant_id").where((F.col("maf") >= least_maf) & (F.col("hwe_p") >= least_hwe) & (F.col("call_rate") >= least_rate))
