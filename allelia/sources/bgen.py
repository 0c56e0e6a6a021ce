"""BGEN genotype probabilities (layouts 1 and 2; uncompressed, zlib or zstd)."""

from __future__ import annotations

import math
import struct
import zlib
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header(data: bytes) -> tuple[int, int, int, int]:
    """(place of the first variant, samples, compression, layout)."""
    offset, length, _, n = struct.unpack_from("<IIII", data)
    if data[16:20] not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    flags = struct.unpack_from("<I", data, 4 + length - 4)[0]
    return offset + 4, n, flags & 3, flags >> 2 & 15


def _text(data: bytes, at: int, kind: str) -> tuple[str, int]:
    size = struct.calcsize(kind)
    n = struct.unpack_from(kind, data, at)[0]
    return data[at + size : at + size + n].decode(), at + size + n


def _plain(data: bytes, compression: int, size: int) -> bytes:
    if compression == 0:
        return data
    if compression == 1:
        return zlib.decompress(data)
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)


def _numbers(data: bytes, bits: int, count: int) -> np.ndarray:
    """count unsigned integers of bits bits each, lowest bits first, as shares of the largest."""
    if bits in (8, 16, 32):
        values = np.frombuffer(data, f"<u{bits // 8}", count).astype(float)
    else:
        flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
        values = flat @ (2.0 ** np.arange(bits))
    return values / (2.0**bits - 1)


def genotypes(k: int, ploidy: int) -> np.ndarray:
    """(genotypes, alleles): copies of each of k alleles in the unordered genotypes of a ploidy, in the file's order (by the
    copies of the last allele first)."""
    found = [np.bincount(c, minlength=k) for c in combinations_with_replacement(range(k), ploidy)]
    return np.array(sorted(found, key=lambda c: tuple(c[::-1])), float).reshape(-1, k)


def expected(block: bytes, n: int, alleles: int) -> tuple[bool, np.ndarray, np.ndarray]:
    """(phased, ploidy of each sample, copies) of a plain layout-2 block: copies (alleles - 1, n) has the expected copies of each
    alternative allele, nan where the sample is missing.

    A phased sample has alleles - 1 probabilities a haplotype; else one for each genotype but the last."""
    _, k, low, high = struct.unpack_from("<IHBB", block)
    if k != alleles:
        raise ValueError(f"{k} alleles in the probabilities, {alleles} in the variant")
    raw = np.frombuffer(block, np.uint8, n, 8)
    ploidy = (raw & 63).astype(np.int32)
    phased, bits = bool(block[8 + n]), block[9 + n]
    per = {z: z * (k - 1) if phased else math.comb(z + k - 1, k - 1) - 1 for z in set(ploidy.tolist())}
    counts = np.array([per[z] for z in ploidy.tolist()], np.int64)
    p = _numbers(block[10 + n :], bits, int(counts.sum()))
    at, out = np.cumsum(counts) - counts, np.full((k - 1, n), np.nan)
    for z, size in per.items():
        own = np.flatnonzero(ploidy == z)
        x = p[at[own][:, None] + np.arange(size)]
        if phased:
            x = x.reshape(len(own), z, k - 1)
            copies = np.concatenate([x, 1 - x.sum(2, keepdims=True)], 2).sum(1)
        else:
            copies = np.column_stack([x, 1 - x.sum(1)]) @ genotypes(k, z)
        out[:, own] = copies.T[1:]
    out[:, raw & 128 > 0] = np.nan
    return phased, ploidy, out


def first_layout(block: bytes, n: int) -> tuple[bool, np.ndarray, np.ndarray]:
    """The same of a plain layout-1 block: three probabilities a sample, of diploid biallelic calls, all 0 where it is missing."""
    p = np.frombuffer(block, "<u2").reshape(n, 3) / 32768
    total = p.sum(1)
    copies = np.where(total > 0, (p[:, 1] + 2 * p[:, 2]) / np.where(total > 0, total, 1), np.nan)
    return False, np.full(n, 2, np.int32), copies[None, :]


def read_bgen(spark: SparkSession, path: str, region: str | None = None, split: int | None = None) -> DataFrame:
    """(id, rsid, chrom, pos, alleles, phased, ploidy, copies, ref, alt, dosage) of BGEN files at or below path, see
    ranged.BgenReader; dosage is that of a biallelic variant's second allele, null for others. region: `chrom:beg-end`."""
    from . import ranged

    rows = ranged.source(spark, ranged.Bgen, path, region=region, split=split)
    two = F.size("alleles") == 2
    return rows.withColumns({"ref": F.col("alleles")[0], "alt": F.array_join(F.slice("alleles", 2, 1 << 30), ","), "dosage": F.when(two, F.get("copies", F.lit(0)))})
