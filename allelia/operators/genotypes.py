"""Genotype cells: decoding, coding and classification as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(cell: Column, form: Column, tag: str) -> Column:
    """The tag's value in a colon-separated cell, by its place in the row's FORMAT; null if either is absent."""
    return F.try_element_at(F.split(cell, ":"), F.nullif(F.array_position(F.split(form, ":"), tag), F.lit(0)).cast("int"))


def allele(gt: Column, k: int) -> Column:
    """First (0) or second (1) allele as a number; null if missing or absent."""
    return F.expr("int(null)") if k > 1 else F.try_to_number(F.nullif(F.try_element_at(F.split(gt, r"[/|]"), F.lit(k + 1)), F.lit(".")), F.lit("99")).cast("int")


def alt_count(gt: Column) -> Column:
    """Alternative alleles of a biallelic call: haploid or diploid; another allele, a dot or another form is missing."""
    ok = gt.rlike(r"^[01]([/|][01])?$")
    return F.when(ok, F.length(F.regexp_replace(gt, "[^1]", ""))).cast("int")


def alt_count_of(gt: Column, k: int) -> Column:
    """Copies of allele k in a multi-allelic call; missing if any allele is."""
    parts = F.split(gt, r"[/|]")
    return F.when(gt.rlike(r"^[0-9]+([/|][0-9]+)?$"), F.size(F.filter(parts, lambda x: x == str(k)))).cast("int")


def male_hemizygous(gt: Column) -> Column:
    """0 or 2 outside the pseudo-autosomal regions: haploid 1 counts twice, diploid only if homozygous."""
    return F.when(gt.isin("0", "0/0", "0|0"), 0).when(gt.isin("1", "1/1", "1|1"), 2).cast("int")


def male_binary(gt: Column) -> Column:
    """male_hemizygous as 0 or 1: presence on the one copy."""
    return (male_hemizygous(gt) / 2).cast("int")


def male_count_of(gt: Column, k: int) -> Column:
    """Twice the copies of allele k on a male's one copy: a haploid call, or a diploid one of two equal alleles."""
    same = gt.rlike(r"^([0-9]+)([/|]\1)?$")
    return F.when(same, F.when(F.regexp_extract(gt, "^([0-9]+)", 1) == str(k), 2).otherwise(0)).cast("int")


def biallelic_collapse(a: Column, b: Column, hemizygous_male: Column) -> Column:
    """Alternative alleles of two allele numbers, all alternatives alike; where a male is hemizygous two different alleles are
    missing and equal ones count as 0 or 2."""
    x, y = F.when(a > 0, 1).when(a == 0, 0), F.when(b > 0, 1).when(b == 0, 0)
    return F.when(~(hemizygous_male & (x != y)), x + y).cast("int")


def dosage_field(cell: Column, form: Column, hemizygous_male: Column, tag: str = "DS") -> Column:
    """The dosage of a cell, doubled for hemizygous males; null if absent or not a number."""
    d = field(cell, form, tag).try_cast("double")
    return F.when(hemizygous_male, 2 * d).otherwise(d)


def same_annotation(a: Column, b: Column) -> Column:
    """Either begins with the other."""
    return F.startswith(a, b) | F.startswith(b, a)


def is_phased(gt: Column) -> Column:
    return F.contains(gt, F.lit("|"))


def is_haploid(gt: Column) -> Column:
    return ~gt.rlike(r"[/|]")


def is_missing(gt: Column) -> Column:
    return F.contains(gt, F.lit("."))


def split_alternatives(sites: DataFrame) -> DataFrame:
    """One row per alternative allele of sites(alt as a comma list): alt, allele number."""
    return sites.select(*[c for c in sites.columns if c != "alt"], F.posexplode(F.split("alt", ",")).alias("k", "alt")).withColumn("k", F.col("k") + 1)


def dosage(p1: Column, p2: Column, total: Column | None = None) -> Column:
    """Expected alternative alleles from genotype probabilities, renormalised by their total where that isn't 1."""
    d = p1 + 2 * p2
    return d if total is None else F.when(total > 0, d / total)


def hard_call(probabilities: Column) -> Column:
    """The most likely genotype's number; the later of a tie of the last two wins nothing: the first does."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def dominant(g: Column) -> Column:
    return F.when(g > 0.5, 1).when(g.isNotNull(), 0)


def recessive(g: Column) -> Column:
    return F.when(g > 1.5, 1).when(g.isNotNull(), 0)


def is_transition() -> Column:
    return F.concat(F.upper("ref"), F.upper("alt")).isin("AG", "GA", "CT", "TC")


def info_value(info: Column, key: str) -> Column:
    """The key's value in a semicolon list of key=value; a bare flag gives an empty string, an absent key null."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))[key]


def annotation(info: Column) -> Column:
    """ANNO up to the first colon or semicolon."""
    return F.nullif(F.regexp_extract(info, "(?:^|;)ANNO=([^:;]*)", 1), F.lit(""))


def chop_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def align_to_reference(sites: DataFrame, reference: DataFrame) -> DataFrame:
    """sites(a1, a2) against reference(chrom, pos, base): same, switched, flipped strand, both, or unmatched."""
    other = lambda c: F.translate(F.upper(c), "ACGT", "TGCA")
    out = sites.join(reference, ["chrom", "pos"], "left")
    b = F.upper("base")
    how = F.when(F.upper("a1") == b, "same").when(F.upper("a2") == b, "switch").when(other("a1") == b, "flip").when(other("a2") == b, "flip_switch").otherwise("unmatched")
    return out.withColumn("alignment", how)
