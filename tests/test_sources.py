"""File formats: fixtures written here, read back whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia import views as V
from allelia.operators import genotypes as G
from allelia.operators import kinship as K
from allelia.sources import plink, text

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\tD
chr1\t10\trs1\tA\tG\t30\tPASS\tDP=7;HM3;ANNO=exon:GENE\tGT:GD:GQ\t0/0:5:9\t0/1:6:8\t1|1:7:7\t./.:0:0
2\t20\t.\tC\tT,A\t.\tq10\tDP=9\tGQB:GT:GD\t1:0|1:3\t2:0/2:4\t3:.\t4:1
"""


def test_vcf(spark, tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text(VCF)
    sites, calls = text.read_vcf(spark, str(path))
    s = {r.pos: r for r in sites.collect()}
    assert (s[10].chrom, s[10].qual, s[20].qual, s[20].alt) == ("1", 30.0, None, "T,A")
    c = {(r.pos, r["sample"]): r for r in calls.join(sites.select("variant_id", "pos"), "variant_id").collect()}
    assert {k: v.g for k, v in c.items()} == {(10, "B"): 1, (10, "C"): 2, (10, "D"): None, (20, "A"): 1, (20, "B"): None, (20, "C"): None, (20, "D"): 1}
    assert c[20, "A"].gq == 0 and c[20, "A"].gd == 3  # GQB isn't GQ
    out = str(tmp_path / "out")
    text.write_vcf(sites.where("pos = 10"), calls, ["A", "B", "C", "D"], out)
    again_sites, again = text.read_vcf(spark, out)
    assert {(r["sample"], r.g) for r in again.collect()} == {("B", 1), ("C", 2), ("D", None)}
    row = sites.where("pos = 10").select(G.info_value(F.col("info"), "DP").alias("dp"), G.annotation(F.col("info")).alias("a")).first()
    assert tuple(row) == ("7", "exon")


def test_vcf_headers_by_file(spark, tmp_path):
    """Files with different samples under one path keep their own names."""
    (tmp_path / "a.vcf").write_text(VCF)
    (tmp_path / "b.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tY\tZ\n3\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\t1/1\n")
    sites, calls = text.read_vcf(spark, str(tmp_path))
    rows = calls.join(sites.select("variant_id", "pos"), "variant_id").where("pos IN (5, 10)").collect()
    assert {(r.pos, r["sample"], r.g) for r in rows} == {(5, "Y", 1), (5, "Z", 2), (10, "B", 1), (10, "C", 2), (10, "D", None)}
    (tmp_path / "c.vcf").write_text("3\t6\t.\tA\tC\t.\t.\t.\tGT\t0/1\t1/1\n")
    with pytest.raises(ValueError, match="no header"):
        text.read_vcf(spark, str(tmp_path))


def test_plink_round_trip(spark, sf_dir, tmp_path):
    g = np.array([0, 1, 2, -9, 2, 1, 0], np.int8)
    assert (plink.unpack(plink.pack(g), 7) == g).all()
    samples = V.samples(spark, sf_dir).where("sample_id < 30")
    sites = V.variants(spark, sf_dir).where("variant_id < 25")
    calls = V.calls(spark, sf_dir).join(samples.select("sample_id"), "sample_id").join(sites.select("variant_id"), "variant_id")
    rows = plink.packed_rows(sites, calls, samples).orderBy("variant_id").collect()
    (tmp_path / "x.bed").write_bytes(plink.MAGIC + b"".join(bytes(r.bed) for r in rows))
    (tmp_path / "x.bim").write_text("".join(f"{r.chrom} v{r.variant_id} 0 {r.pos} A G\n" for r in rows))
    (tmp_path / "x.fam").write_text("".join(f"F {i} 0 0 1 -9\n" for i in range(30)))
    s, p, c = plink.read_bed(spark, str(tmp_path / "x"))
    assert s.count() == 25 and p.count() == 30
    key = lambda rows: sorted((r.variant_id, r.sample_id, -1 if r.g is None else r.g) for r in rows)
    assert key(c.collect()) == key(calls.collect())


def test_tables(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    ped = text.read_pedigree(spark, put("ped", "fid iid fatid matid sex y1 y2\nf a 0 0 1 1.5 NA\nf b a 0 2 x 2\nf c 0 0 0 1 1\nf c 0 0 0 2 2\n"), ["y1", "y2"])
    assert {(r.iid, r.father, r.sex, r.y1, r.y2) for r in ped.collect()} == {("a", None, 1, 1.5, None), ("b", "a", 2, None, 2.0)}
    cov = text.read_covariates(spark, put("cov", "FID IID c1 c2\nf a 1 2\nf a 3 4\nf b NA 5\n"))
    assert {(r.iid, r.c1, r.c2) for r in cov.collect()} == {("a", 1.0, 2.0), ("b", None, 5.0)}
    with pytest.raises(ValueError):
        text.read_covariates(spark, put("bad", "iid c1\na 1\n"))
    assert text.read_models(spark, put("models", "pheno covar\ny1,y2 1+c1+c2\n")) == [(["y1", "y2"], ["c1", "c2"])]
    genes = text.read_genes(spark, put("genes", "G1 t1 chr1 - 10 30 x\nG2 t2 X + 5 9 x\n"))
    assert {tuple(r) for r in genes.collect()} == {("G1", "1", 10, 30), ("G2", "X", 5, 9)}
    sets = text.read_sets(spark, put("sets", "s1 1:1-3,chr2:5\ns2 3:7-\n"))
    assert {tuple(r) for r in sets.collect()} == {("s1", "1", 1, 3), ("s1", "2", 5, 5), ("s2", "3", 7, 1 << 29)}
    assert {tuple(r) for r in text.read_sites(spark, put("site", "1:5\nchr2 7\n")).collect()} == {("1", 5), ("2", 7)}
    assert {tuple(r) for r in text.read_sites(spark, put("bed", "1 5 8\n"), "bed").collect()} == {("1", 6), ("1", 7), ("1", 8)}
    assert {tuple(r) for r in text.read_sites(spark, put("rod", "1 x 5\n"), "rod").collect()} == {("1", 6)}
    k = text.read_kinship(spark, put("kin", "FID IID a b\nf a 1 0.5\nf b 0.5 1\n"))
    assert {tuple(r) for r in k.collect()} == {("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)}
    assert [tuple(r) for r in text.read_bgen_samples(spark, put("sample", "ID_1 ID_2 missing\n0 0 0\na b 0\n")).collect()] == [("a", "b", 0.0)]
    text.write_results(k.withColumn("kinship", F.nullif("kinship", F.lit(1.0))), str(tmp_path / "res"))
    assert "NA" in "".join(p.read_text() for p in (tmp_path / "res").glob("part*"))


def test_pedigree_generations(spark):
    people = spark.createDataFrame([("a", None, None, 1), ("b", None, None, 2), ("c", "a", "b", 1), ("d", "a", "b", 2), ("e", "c", "d", 1)], "id string, father string, mother string, sex int")
    k = {(r.i, r.j): r.kinship for r in K.pedigree(people).collect()}
    assert k["c", "d"] == 0.25 and k["e", "e"] == 0.5 * 1.25 and k["c", "e"] == 0.5 * (0.5 + 0.25) and k["a", "e"] == 0.25 and ("a", "b") not in k
    x = {(r.i, r.j): r.kinship for r in K.pedigree(people, x_linked=True).collect()}
    assert x["a", "a"] == 1.0 and x["c", "c"] == 1.0 and x["b", "c"] == 0.5 and ("a", "c") not in x and x["a", "d"] == 0.5


def test_streams(spark, sf_dir, tmp_path):
    from allelia.streaming import counters

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = counters.windowed_events(spark.readStream.schema(events.schema).parquet(src), "1 day", "60 days")
    run = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.sql("SELECT SUM(n) AS n FROM windowed").first().n == events.count()


def _bgen(tmp_path, name, compression, bits, layout=2):
    import struct
    import zlib

    import zstandard

    rng = np.random.default_rng(bits)
    n, m = 5, 4
    want, body = [], b""
    for v in range(m):
        top = 2**bits - 1
        hom, het = rng.integers(0, top // 2 + 1, n), rng.integers(0, top // 2 + 1, n)
        missing = np.arange(n) == v
        phased = layout == 2 and v == 3
        body += struct.pack("<I", n) if layout == 1 else b""
        for s in (f"id{v}", f"rs{v}", "07"):
            body += struct.pack("<H", len(s)) + s.encode()
        body += struct.pack("<I", 100 + v) + (struct.pack("<H", 2) if layout == 2 else b"")
        for s in ("A", "GT"):
            body += struct.pack("<I", len(s)) + s.encode()
        if layout == 1:
            p = np.stack([hom, het, 32768 - hom - het], 1)
            p[missing] = 0
            block = p.astype("<u2").tobytes()
            g = np.where(missing, np.nan, (p[:, 1] + 2 * p[:, 2]) / 32768)
        else:
            pairs = np.stack([hom, het], 1).reshape(-1)
            flat = (pairs[:, None] >> np.arange(bits) & 1).astype(np.uint8).reshape(-1)
            block = struct.pack("<IHBB", n, 2, 2, 2) + bytes(2 | (128 if x else 0) for x in missing) + bytes([int(phased), bits]) + np.packbits(flat, bitorder="little").tobytes()
            a, b = hom / top, het / top
            g = np.where(missing, np.nan, (2 - a - b) if phased else b + 2 * (1 - a - b))
        packed = {0: lambda x: x, 1: zlib.compress, 2: zstandard.ZstdCompressor().compress}[compression](block)
        if layout == 1:
            body += (struct.pack("<I", len(packed)) if compression else b"") + packed
        else:
            body += struct.pack("<I", len(packed) + 4 * bool(compression)) + (struct.pack("<I", len(block)) if compression else b"") + packed
        want.append(g)
    head = struct.pack("<IIII", 20, 20, m, n) + b"bgen" + struct.pack("<I", compression | layout << 2)
    (tmp_path / name).write_bytes(head + body)
    return want


@pytest.mark.parametrize("compression,bits,layout", [(0, 8, 2), (1, 16, 2), (2, 11, 2), (1, 1, 2), (1, 15, 1), (0, 15, 1)])
def test_bgen(spark, tmp_path, compression, bits, layout):
    from allelia.sources import bgen

    want = _bgen(tmp_path, "x.bgen", compression, bits, layout)
    rows = bgen.read_bgen(spark, str(tmp_path / "x.bgen")).orderBy("pos").collect()
    assert [(r.id, r.rsid, r.chrom, r.pos, r.ref, r.alt) for r in rows] == [(f"id{v}", f"rs{v}", "07", 100 + v, "A", "GT") for v in range(4)]
    for r, g in zip(rows, want):
        assert [x is None for x in r.dosage] == np.isnan(g).tolist()
        assert [x for x in r.dosage if x is not None] == pytest.approx(g[~np.isnan(g)].tolist(), abs=1e-9)
