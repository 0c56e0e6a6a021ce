"""Files that are read by several tasks, and by region: each record once, bytes counted."""

from __future__ import annotations

import itertools
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from allelia.sources import bgen, blocks, plink, ranged, text

EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf(plain: bytes, cuts: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """(file, [(place in plain, place in file)] of its blocks)."""
    out, where = b"", []
    for a, b in itertools.pairwise([0, *cuts, len(plain)]):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(plain[a:b]) + z.flush()
        where.append((a, len(out)))
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(plain[a:b]), b - a)
    return out + EOF, where


def virtual(where, place: int) -> int:
    a, at = next((a, at) for a, at in reversed(where) if a <= place)
    return at << 16 | place - a


def csi(records, where, end: int, names: list[str], shift: int, depth: int, magic: bytes) -> bytes:
    """An index of records (sequence, pos, begin in plain): a chunk for each record in its smallest bin."""
    first = ((1 << 3 * depth) - 1) // 7
    starts = [r[2] for r in records] + [end]
    body = struct.pack("<i", len(names)) if magic == b"CSI\1" else b""
    for s in range(len(names)):
        bins: dict[int, list[tuple[int, int]]] = {}
        for k, (own, pos, at) in enumerate(records):
            if own == s:
                bins.setdefault(first + (pos - 1 >> shift), []).append((virtual(where, at), virtual(where, starts[k + 1])))
        body += struct.pack("<i", len(bins) + 1)
        for number, chunks in [*bins.items(), (((1 << 3 * (depth + 1)) - 1) // 7 + 1, [(0, 0), (0, 0)])]:
            body += struct.pack("<I", number) + (struct.pack("<Q", 0) if magic == b"CSI\1" else b"") + struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        body += struct.pack("<iQ", 1, 0) if magic == b"TBI\1" else b""
    joined = b"\0".join(x.encode() for x in names) + b"\0"
    head = struct.pack("<7i", 2, 1, 2, 0, 35, 0, len(joined)) + joined
    whole = magic + (struct.pack("<iii", shift, depth, len(head)) + head if magic == b"CSI\1" else struct.pack("<i", len(names)) + head) + body
    return bgzf(whole, [])[0]


def lines_of(n_per, samples=6):
    rng = np.random.default_rng(3)
    out = []
    for chrom in ("chr1", "chr2", "chrX"):
        for pos in sorted(rng.integers(1, 400_000, n_per).tolist()):
            cells = "\t".join(f"{rng.integers(0, 2)}/{rng.integers(0, 2)}:{rng.integers(1, 60)}" for _ in range(samples))
            out.append((chrom, pos, f"{chrom}\t{pos}\tv{len(out)}\tA\tG\t30\tPASS\tDP={rng.integers(9)};NOTE={'x' * int(rng.integers(0, 300))}\tGT:GD\t{cells}"))
    return out


HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{k}" for k in range(6)) + "\n"


def write_vcf(tmp_path, name, rows, index=None, seed=0):
    plain, records = HEAD.encode(), []
    for chrom, pos, line in rows:
        records.append((("chr1", "chr2", "chrX").index(chrom), pos, len(plain)))
        plain += line.encode() + b"\n"
    rng = np.random.default_rng(seed)
    # blocks that end in the middle of lines, at their ends, and empty ones
    cuts = sorted([*rng.integers(1, len(plain), len(plain) // 3000).tolist(), *[r[2] for r in records[::17]], records[5][2], records[5][2]])
    data, where = bgzf(plain, cuts)
    (tmp_path / name).write_bytes(data)
    if index:
        shift, depth = (14, 5) if index == ".tbi" else (13, 6)
        (tmp_path / (name + index)).write_bytes(csi(records, where, len(plain), ["chr1", "chr2", "chrX"], shift, depth, b"TBI\1" if index == ".tbi" else b"CSI\1"))
    return str(tmp_path / name), len(data)


def read_all(reader):
    parts = reader.partitions()
    return parts, [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]


@pytest.mark.parametrize("split", [700, 5_000, 1 << 20])
def test_every_line_once(tmp_path, split):
    rows = lines_of(150)
    for seed in range(3):
        path, size = write_vcf(tmp_path, "a.vcf.gz", rows, seed=seed)
        parts, got = read_all(ranged.LinesReader({"path": path, "split": split}))
        assert len(parts) == 1 + -(-size // split)
        assert got == HEAD.strip().split("\n") + [r[2] for r in rows]
    (tmp_path / "b.vcf").write_text(HEAD + "\n".join(r[2] for r in rows))
    assert read_all(ranged.LinesReader({"path": str(tmp_path / "b.vcf"), "split": split}))[1] == HEAD.strip().split("\n") + [r[2] for r in rows]


@pytest.mark.parametrize("index", [None, ".tbi", ".csi"])
def test_region_reads_its_blocks(tmp_path, index):
    rows = lines_of(400)
    path, size = write_vcf(tmp_path, "a.vcf.gz", rows, index)
    for region in ("2:100000-150000", "chrX:1-20000", "1", f"chr2:{rows[450][1]}", "3:1-9", "X:399000-"):
        reader = ranged.LinesReader({"path": path, "split": 10_000, "region": region})
        got = read_all(reader)[1]
        name, beg, end = ranged.parse_region(region)
        want = [x for c, p, x in rows if c == "chr" + name and beg <= p <= end]
        assert [x for x in got if x[0] != "#"] == want, region


def test_region_bytes_on_a_larger_file(tmp_path):
    """Of 6 MB of poorly compressible lines a region's chunks and one chunk of look-ahead are read."""
    rng = np.random.default_rng(8)
    rows = [("chr1", 100 * k, f"chr1\t{100 * k}\tv{k}\tA\tG\t.\t.\tX={rng.bytes(700).hex()}\tGT\t" + "\t".join(["0/1"] * 6)) for k in range(1, 6000)]
    path, size = write_vcf(tmp_path, "a.vcf.gz", rows, ".csi")
    assert size > 4_000_000
    reader = ranged.LinesReader({"path": path, "region": "1:200000-210000"})
    assert len([x for x in read_all(reader)[1] if x[0] != "#"]) == 101
    assert reader.taken < size / 4


def test_read_vcf_by_blocks(spark, tmp_path):
    rows = lines_of(40)
    path, _ = write_vcf(tmp_path, "a.vcf.gz", rows, ".tbi")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.vcf").write_text(HEAD + "\n".join(r[2] for r in rows))
    key = lambda pair: (sorted(map(str, pair[0].collect())), sorted(map(str, pair[1].collect())))
    whole = key(text.read_vcf(spark, path, split=2_000))
    assert whole == key(text.read_vcf(spark, str(tmp_path / "plain")))
    sites, _ = text.read_vcf(spark, path, region="2:1-200000")
    assert sorted(r.pos for r in sites.collect()) == sorted(p for c, p, _ in rows if c == "chr2" and p <= 200_000)
    assert ranged.source(spark, ranged.Lines, path, split=1_000).rdd.getNumPartitions() > 4


# ---- BCF -------------------------------------------------------------------------------------------------------------


def typed(values, kind):
    n = len(values)
    head = bytes([kind | min(n, 15) << 4]) + (bytes([0x12]) + struct.pack("<h", n) if n >= 15 else b"")
    return head + (values if kind == 7 else struct.pack(f"<{n}{ {1: 'b', 2: 'h', 3: 'i', 5: 'f'}[kind]}", *values))


def write_bcf(tmp_path, n=300):
    rng = np.random.default_rng(6)
    header = "".join(f"{x}\n" for x in ['##fileformat=VCFv4.2', '##FILTER=<ID=q10,Description="x">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="x">', '##INFO=<ID=HM3,Number=0,Type=Flag,Description="x">', '##INFO=<ID=AF,Number=A,Type=Float,Description="x">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=GD,Number=1,Type=Integer,Description="x">', "##contig=<ID=chr1>", "##contig=<ID=chr2,IDX=1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td"])
    plain = b"BCF\2\2" + struct.pack("<I", len(header) + 1) + header.encode() + b"\0"
    want, records = header.strip().split("\n"), []
    for k in range(n):
        chrom, pos, long = int(k >= n // 2), 1000 * (k % (n // 2)) + 7, "T" * int(rng.integers(1, 40))
        gd = [5, -128, int(rng.integers(0, 99)), 300]
        wide = k % 3 == 0
        gt = [[2, 5], [0, 0], [4, -127], [2, 2]]  # 0|1, ./., 1, 0/0
        shared = struct.pack("<iiiIII", chrom, pos - 1, 1, 0x7F800001 if k % 2 else struct.unpack("<I", struct.pack("<f", 30.5))[0], 2 << 16 | 3, 2 << 24 | 4)
        shared += typed(f"rs{k}".encode(), 7) + typed(b"A", 7) + typed(long.encode(), 7) + typed([1], 1)
        shared += typed([2], 1) + typed([1000 + k], 2) + typed([3], 1) + b"\0" + typed([4], 1) + typed([0.25], 5)
        cells = bytes([0x11, 5, 0x21]) + b"".join(struct.pack("<bb", *g) for g in gt)
        cells += typed([6], 1) + (b"\x12" + struct.pack("<4h", *[-32768 if v == -128 else v for v in gd]) if wide else b"\x11" + struct.pack("<4b", *[min(v, 99) for v in gd]))
        records.append((chrom, pos, len(plain)))
        plain += struct.pack("<II", len(shared), len(cells)) + shared + cells
        depth = [str(v) if wide else str(min(v, 99)) for v in gd]
        depth[1] = "."
        want.append("\t".join([f"chr{chrom + 1}", str(pos), f"rs{k}", "A", long, "." if k % 2 else "30.5", "q10", f"DP={1000 + k};HM3;AF=0.25", "GT:GD", *(f"{g}:{d}" for g, d in zip(("0|1", "./.", "1", "0/0"), depth))]))
    data, where = bgzf(plain, sorted(rng.integers(1, len(plain), 40).tolist()))
    (tmp_path / "x.bcf").write_bytes(data)
    (tmp_path / "x.bcf.csi").write_bytes(csi(records, where, len(plain), ["chr1", "chr2"], 14, 5, b"CSI\1"))
    return str(tmp_path / "x.bcf"), want


def test_bcf(spark, tmp_path):
    path, want = write_bcf(tmp_path)
    parts, got = read_all(ranged.LinesReader({"path": path, "split": 1_000}))
    assert got == want and len(parts) > 4
    region = [x for x in read_all(ranged.LinesReader({"path": path, "region": "2:50000-90000"}))[1] if x[0] != "#"]
    assert region == [x for x in want if x.startswith("chr2\t") and 50_000 <= int(x.split("\t")[1]) <= 90_000] and region
    (tmp_path / "x.bcf.csi").unlink()
    assert read_all(ranged.LinesReader({"path": path, "split": 1_000}))[1] == want
    sites, calls = text.read_vcf(spark, path)
    assert sites.count() == 300 and {(r["sample"], r.g) for r in calls.collect()} == {("a", 1), ("b", None), ("c", 1)}


# ---- BGEN ------------------------------------------------------------------------------------------------------------


def write_bgen(tmp_path, n=7, m=60):
    """Two to four alleles, ploidy 1 to 3, phased and not; with its index."""
    rng = np.random.default_rng(9)
    body, want, index = b"", [], []
    first = 24
    for v in range(m):
        k, phased, bits = 2 + v % 3, v % 4 == 1, (8, 11, 16)[v % 3]
        ploidy = rng.integers(1, 4, n) if v % 2 else np.full(n, 2)
        top, flat, copies = 2**bits - 1, [], np.full((k - 1, n), np.nan)
        for s, z in enumerate(ploidy):
            if phased:
                shares = [rng.multinomial(top, rng.dirichlet(np.ones(k))) for _ in range(z)]
                flat += [x for p in shares for x in p[:-1]]
                own = sum(p / top for p in shares)
            else:
                kinds = sorted((c for c in itertools.product(range(z + 1), repeat=k) if sum(c) == z), key=lambda c: c[::-1])
                p = rng.multinomial(top, rng.dirichlet(np.ones(len(kinds))))
                flat += list(p[:-1])
                own = sum(x / top * np.array(c) for x, c in zip(p, kinds))
            if s != v % n:
                copies[:, s] = own[1:]
        raw = (np.array(flat, np.int64)[:, None] >> np.arange(bits) & 1).astype(np.uint8).reshape(-1)
        block = struct.pack("<IHBB", n, k, ploidy.min(), ploidy.max()) + bytes(int(z) | (128 if s == v % n else 0) for s, z in enumerate(ploidy)) + bytes([int(phased), bits]) + np.packbits(raw, bitorder="little").tobytes()
        begin = first + len(body)
        chrom, pos, alleles = "01" if v < m // 2 else "02", 100 * v, ["A", "GT", "C", "TTT"][:k]
        for x in (f"id{v}", f"rs{v}" * (200 if v == 5 else 1), chrom):
            body += struct.pack("<H", len(x)) + x.encode()
        body += struct.pack("<IH", pos, k) + b"".join(struct.pack("<I", len(x)) + x.encode() for x in alleles)
        packed = zlib.compress(block)
        body += struct.pack("<II", len(packed) + 4, len(block)) + packed
        index.append((chrom, pos, f"rs{v}", k, alleles[0], alleles[1], begin, first + len(body) - begin))
        want.append((f"id{v}", chrom, pos, alleles, phased, ploidy.tolist(), copies))
    (tmp_path / "y.bgen").write_bytes(struct.pack("<IIII", 20, 20, m, n) + b"bgen" + struct.pack("<I", 1 | 2 << 2) + body)
    with sqlite3.connect(tmp_path / "y.bgen.bgi") as db:
        db.execute("CREATE TABLE Variant (chromosome TEXT, position INT, rsid TEXT, number_of_alleles INT, allele1 TEXT, allele2 TEXT, file_start_position INT, size_in_bytes INT)")
        db.executemany("INSERT INTO Variant VALUES (?, ?, ?, ?, ?, ?, ?, ?)", index)
    return str(tmp_path / "y.bgen"), want


def test_bgen_any_alleles_and_ploidy(spark, tmp_path):
    path, want = write_bgen(tmp_path)

    def check(rows, told):
        rows = sorted(rows, key=lambda r: r.pos)
        assert [(r.id, r.chrom, r.pos, r.alleles, r.phased, r.ploidy) for r in rows] == [w[:6] for w in told]
        for r, w in zip(rows, told):
            got = np.array([[np.nan if x is None else x for x in c] for c in r.copies], float)
            np.testing.assert_allclose(got, w[6], atol=1e-9)
            assert (r.dosage is None) == (len(w[3]) > 2)

    df = bgen.read_bgen(spark, path, split=1_500)
    assert df.rdd.getNumPartitions() > 3
    check(df.collect(), want)
    check(bgen.read_bgen(spark, path, region="2:3500-4200").collect(), [w for w in want if w[1] == "02" and 3500 <= w[2] <= 4200])
    reader = ranged.BgenReader({"path": path, "region": "02:3500-4200"})
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 8 and reader.taken < 30 * 1024 + 8 * 400
    (tmp_path / "y.bgen.bgi").unlink()
    check(bgen.read_bgen(spark, path).collect(), want)
    check(bgen.read_bgen(spark, path, region="2:3500-4200").collect(), [w for w in want if w[1] == "02" and 3500 <= w[2] <= 4200])


# ---- PLINK -----------------------------------------------------------------------------------------------------------


def test_bed_by_rows_and_region(spark, tmp_path):
    rng = np.random.default_rng(1)
    n, m = 37, 500
    g = rng.choice(np.array([0, 1, 2, -9], np.int8), (m, n))
    (tmp_path / "x.bed").write_bytes(plink.MAGIC + b"".join(plink.pack(r) for r in g))
    sites = [("chr1" if v < 300 else "chr2", 10 * v) for v in range(m)]
    (tmp_path / "x.bim").write_text("".join(f"{c} v{v} 0 {p} A G\n" for v, (c, p) in enumerate(sites)))
    (tmp_path / "x.fam").write_text("\n".join(f"F i{k} 0 0 1 {k}" for k in range(n)))
    prefix = str(tmp_path / "x")
    s, p, c = plink.read_bed(spark, prefix, split=900)
    assert [(r.variant_id, r.chrom, r.pos, r.id) for r in s.orderBy("variant_id").collect()] == [(v, *sites[v], f"v{v}") for v in range(m)]
    assert [(r.sample_id, r.iid, r.y) for r in p.orderBy("sample_id").collect()] == [(k, f"i{k}", float(k)) for k in range(n)]
    got = np.zeros((m, n), np.int8)
    for r in c.collect():
        got[r.variant_id, r.sample_id] = -9 if r.g is None else r.g
    assert (got == g).all() and ranged.source(spark, ranged.Bed, f"{prefix}.bed", samples=n, split=900).rdd.getNumPartitions() == 6
    s, _, c = plink.read_bed(spark, prefix, region="2:4000-4200")
    assert {r.variant_id for r in s.collect()} == set(range(400, 421)) == {r.variant_id for r in c.collect()}
    assert plink.read_bed(spark, prefix, region="7:1-9")[2].count() == 0
    reader = ranged.BedReader({"path": f"{prefix}.bed", "samples": n, "first": 400, "last": 420})
    assert sum(b.num_rows for q in reader.partitions() for b in reader.read(q)) == int((g[400:421] != 0).sum())
    assert reader.taken == 21 * 10
