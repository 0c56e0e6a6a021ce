"""PLINK bed, bim and fam files. A bed row has two bits a sample: 0 hom-ref-of-allele-1, 1 missing, 2 het, 3 the other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = bytes([0x6C, 0x1B, 0x01])
#: Code in the file by alternative alleles (0, 1, 2, missing), allele 1 being the reference.
_CODE = np.array([0, 2, 3, 1], np.uint8)
DECODE = np.array([0, -9, 1, 2], np.int8)


def pack(g: np.ndarray) -> bytes:
    """A row of genotypes (0, 1, 2, -9), four a byte, the first in the lowest bits."""
    code = _CODE[np.where(g < 0, 3, g)]
    code = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    return (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return DECODE[(raw[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3].reshape(-1)[:n]


def packed_rows(sites: DataFrame, calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(variant_id, chrom, pos, bed): each site's packed genotypes, samples in order of sample_id; absent pairs are 0."""
    order = samples.select("sample_id", (F.row_number().over(Window.orderBy("sample_id")) - 1).alias("k"))
    n = samples.count()
    own = calls.join(order, "sample_id").groupBy("variant_id").agg(F.collect_list(F.struct("k", F.coalesce("g", F.lit(-9)).alias("g"))).alias("cells"))
    rows = sites.select("variant_id", "chrom", "pos").join(own, "variant_id", "left")

    def run(batches):
        for frame in batches:
            out = []
            for cells in frame["cells"]:
                g = np.zeros(n, np.int8)
                for c in cells if cells is not None else ():
                    g[c["k"]] = c["g"]
                out.append(pack(g))
            yield pd.DataFrame({"variant_id": frame["variant_id"], "chrom": frame["chrom"], "pos": frame["pos"], "bed": out})

    return rows.mapInPandas(run, f"variant_id long, chrom {dict(sites.dtypes)['chrom']}, pos long, bed binary")


def read_bed(spark: SparkSession, prefix: str, region: str | None = None, split: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, samples, calls) of prefix.bed, .bim and .fam; calls are sparse.

    All three files are split by byte ranges; only the counts of lines by range go to the driver. With a region
    (`chrom:beg-end`) sites and calls are its own, and of the bed file only the rows from its first site to its last are read."""
    from . import ranged

    field = lambda k: F.split("value", r"\s+")[k]
    sites = ranged.numbered_lines(spark, f"{prefix}.bim", split).withColumn("value", F.trim("value"))
    sites = sites.select(F.col("line").alias("variant_id"), field(0).alias("chrom"), field(1).alias("id"), field(3).cast("long").alias("pos"), field(4).alias("ref"), field(5).alias("alt"))
    samples = ranged.numbered_lines(spark, f"{prefix}.fam", split).withColumn("value", F.trim("value"))
    samples = samples.select(F.col("line").alias("sample_id"), field(0).alias("fid"), field(1).alias("iid"), field(4).try_cast("int").alias("sex"), field(5).try_cast("double").alias("y"))
    first = last = None
    if region:
        name, beg, end = ranged.parse_region(region)
        sites = sites.where((F.regexp_replace("chrom", "^chr", "") == name) & F.col("pos").between(beg, end))
        first, last = sites.agg(F.min("variant_id"), F.max("variant_id")).first()
        if first is None:
            first, last = 0, -1
    calls = ranged.source(spark, ranged.Bed, f"{prefix}.bed", samples=samples.count(), first=first, last=last, split=split)
    if region:
        calls = calls.join(sites.select("variant_id"), "variant_id", "left_semi")
    return sites, samples, calls.withColumn("g", F.when(F.col("g") >= 0, F.col("g")))
