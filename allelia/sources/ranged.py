"""Python data sources that split files by byte ranges and read only the blocks of a region."""

from __future__ import annotations

import re
import sqlite3
import struct
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bcf, bgen, plink
from .blocks import File, Index, Stream, exists, files, find_block, is_bgzf

#: Bytes of a file that a task reads, about.
SPLIT = 32 << 20
BATCH = 512


def parse_region(region: str | None) -> tuple[str, int, int] | None:
    """(chrom without chr, beg, end), from 1 and inclusive, of `chrom`, `chrom:pos` or `chrom:beg-end`."""
    if not region:
        return None
    m = re.fullmatch(r"([^:]+)(?::([\d,]+)(-)?([\d,]+)?)?", region)
    if not m:
        raise ValueError(f"not a region: {region}")
    beg = int((m[2] or "1").replace(",", ""))
    end = int(m[4].replace(",", "")) if m[4] else beg if m[2] and not m[3] else 1 << 29
    return m[1].removeprefix("chr"), beg, end


@dataclass
class Part(InputPartition):
    """kind: head, bytes (from a to b) or chunk (virtual offsets from a to b)."""

    kind: str
    path: str
    a: int = 0
    b: int = 0


class Plain:
    """Stream's interface over a plain text file."""

    def __init__(self, file: File, offset: int):
        self.file, self.at, self.data, self.base = file, offset, b"", offset

    def place(self) -> int:
        return self.at if self.at < self.file.size else 1 << 63

    def line(self) -> bytes | None:
        out = []
        while self.at < self.file.size:
            if not self.base <= self.at < self.base + len(self.data):
                self.data, self.base = self.file.read(self.at, 1 << 18), self.at
            k = self.data.find(b"\n", self.at - self.base)
            out.append(self.data[self.at - self.base : k if k >= 0 else len(self.data)])
            self.at = self.base + (k + 1 if k >= 0 else len(self.data))
            if k >= 0:
                break
        return b"".join(out) if out else None


def _pieces(size: int, split: int) -> list[tuple[int, int]]:
    return [(a, min(a + split, size)) for a in range(0, size, split)]


class LinesReader(DataSourceReader):
    """Lines (value, file) of VCF text, plain or bgzipped, and of BCF. Header lines come from a task of their own.

    A task's byte range has the lines that begin after its first line's begin, up to that of the next range, so every line
    is read once wherever blocks and lines end. With a region, an index beside the file gives the blocks to read; without
    one, a task first looks at the records at both ends of its range, and reads on only if the region can lie between
    (records are sorted, and a chromosome's lie together)."""

    def __init__(self, options):
        self.path, self.region, self.split = options["path"], parse_region(options.get("region")), int(options.get("split", SPLIT))
        self.taken = 0

    def _index(self, path: str) -> Index | None:
        return next((Index(path + end) for end in (".csi", ".tbi") if exists(path + end)), None)

    def partitions(self) -> list[Part]:
        out = []
        for path in files(self.path, (".vcf", ".vcf.gz", ".vcf.bgz", ".bcf", ".txt")):
            out.append(Part("head", path))
            file = File(path)
            packed = is_bgzf(file)
            binary = packed and Stream(file).read(3) == b"BCF"
            index = self._index(path) if packed and (binary or self.region) else None
            if index and self.region:
                names = list(bcf.Header(Stream(file)).contigs.values()) if binary else index.names
                at = [k for k, x in enumerate(names) if x.removeprefix("chr") == self.region[0]]
                out += [Part("chunk", path, a, b) for k in at for a, b in index.chunks(k, *self.region[1:])]
            elif binary:
                stream = Stream(file)
                bcf.Header(stream)
                cuts = [stream.place()]
                for v in index.starts() if index else []:
                    if v >> 16 >= (cuts[-1] >> 16) + self.split:
                        cuts.append(v)
                out += [Part("chunk", path, a, b) for a, b in zip(cuts, [*cuts[1:], 1 << 62])]
            else:
                out += [Part("bytes", path, a, b) for a, b in _pieces(file.size, self.split)]
        return out

    def read(self, part: Part | None):
        if part is None:  # as Spark has it for no partitions
            return
        file = File(part.path)
        rows: list[str] = []
        for line in self._lines(file, part):
            rows.append(line)
            if len(rows) == BATCH:
                yield self._batch(rows, part.path)
                rows = []
        if rows:
            yield self._batch(rows, part.path)
        self.taken += file.taken

    @staticmethod
    def _batch(rows, path):
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array([path] * len(rows))], names=["value", "file"])

    def _lines(self, file: File, part: Part):
        packed = is_bgzf(file)
        start = Stream(file) if packed else Plain(file, 0)
        binary = packed and start.read(3) == b"BCF"
        if part.kind == "head":
            if binary:
                yield from bcf.Header(Stream(file)).lines
                return
            start = Stream(file) if packed else Plain(file, 0)
            while (line := start.line()) is not None and line[:1] == b"#":
                yield line.decode()
        elif binary:
            header, stream = bcf.Header(Stream(file)), Stream(file, part.a)
            while stream.place() < part.b and (found := bcf.record(stream, header)):
                if not self.region or self._order(*found[:2]) == 0:
                    yield found[2]
                elif self._order(*found[:2]) > 0:
                    return
        elif part.kind == "chunk":
            stream = Stream(file, part.a)
            while stream.place() < part.b and (line := stream.line()) is not None:
                order = self._order(*self._site(line))
                if order == 0:
                    yield line.decode().rstrip("\r")
                elif order > 0:
                    return
        else:
            yield from self._range(file, part, packed)

    @staticmethod
    def _site(line: bytes) -> tuple[str, int]:
        chrom, pos = line.split(b"\t", 2)[:2]
        return chrom.decode(), int(pos)

    def _order(self, chrom: str, pos: int) -> int | None:
        """0 in the region, -1 before and 1 after it on its chromosome, -2 on another."""
        name, beg, end = self.region
        return -2 if chrom.removeprefix("chr") != name else -1 if pos < beg else 1 if pos > end else 0

    def _range(self, file: File, part: Part, packed: bool):
        at = lambda x: Stream(file, find_block(file, x) << 16) if packed else Plain(file, x)
        stream, last = at(part.a), at(part.b)
        stop = last.place() if part.b < file.size else 1 << 62
        if part.a:
            stream.line()
        first = True
        while stream.place() <= stop and (line := stream.line()) is not None:
            if line[:1] == b"#" or not line.rstrip():
                continue
            if self.region:
                order = self._order(*self._site(line))
                if first and order != 0 and part.b < file.size:
                    last.line()  # as the next range does
                    if not self._between(line, last.line()):
                        return
                first = False
                if order > 0:
                    return
                if order < 0:
                    continue
            yield line.decode().rstrip("\r")

    def _between(self, line: bytes, end: bytes | None) -> bool:
        """Whether records of the region can lie between two records."""
        if end is None or not end.strip():
            return True
        (c, p), (d, q) = self._site(line), self._site(end)
        name, beg, stop = self.region
        c, d = c.removeprefix("chr"), d.removeprefix("chr")
        if c == d:
            return c == name and p <= stop and q >= beg
        return p <= stop if c == name else q >= beg if d == name else True


class Lines(DataSource):
    @classmethod
    def name(cls):
        return "variant_lines"

    def schema(self):
        return "value string, file string"

    def reader(self, schema):
        return LinesReader(self.options)


class TextReader(DataSourceReader):
    """(part, k, value): the lines of a plain text file by byte range, k counting from 0 in each."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self):
        return [Part("bytes", self.path, a, b) for a, b in _pieces(File(self.path).size, self.split)]

    def read(self, part):
        if part is None:
            return
        file = File(part.path)
        stream, rows, k = Plain(file, part.a), [], 0
        if part.a:
            stream.line()
        while stream.place() <= (part.b if part.b < file.size else 1 << 62) and (line := stream.line()) is not None:
            if line.strip():
                rows.append(line.decode().rstrip("\r"))
            if len(rows) == 8 * BATCH:
                yield self._batch(part, k, rows)
                k, rows = k + len(rows), []
        if rows:
            yield self._batch(part, k, rows)

    @staticmethod
    def _batch(part, k, rows):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part.a)), pa.array(np.arange(k, k + len(rows))), pa.array(rows)], names=["part", "k", "value"])


class Text(DataSource):
    @classmethod
    def name(cls):
        return "ranged_text"

    def schema(self):
        return "part long, k long, value string"

    def reader(self, schema):
        return TextReader(self.options)


class BedReader(DataSourceReader):
    """(variant_id, sample_id, g) of the cells that aren't 0 in a variant-major bed file, -9 for missing; a task has whole rows
    of about `split` bytes, from variant `first` up to `last` where these are given."""

    def __init__(self, options):
        self.path, self.n, self.split = options["path"], int(options["samples"]), int(options.get("split", SPLIT))
        self.width, self.taken = -(-self.n // 4), 0
        self.first, self.last = int(options.get("first", 0)), options.get("last")

    def partitions(self):
        file = File(self.path)
        if file.read(0, 3) != plink.MAGIC:
            raise ValueError(f"not a variant-major bed file: {self.path}")
        end = (file.size - 3) // max(self.width, 1)
        end = min(end, int(self.last) + 1) if self.last is not None else end
        rows = max(1, self.split // max(self.width, 1))
        return [Part("rows", self.path, a, min(a + rows, end)) for a in range(self.first, end, rows)]

    def read(self, part):
        if part is None:
            return
        file, step = File(part.path), max(1, (1 << 20) // max(self.n, 1))
        for v in range(part.a, part.b, step):
            m = min(step, part.b - v)
            raw = np.frombuffer(file.read(3 + v * self.width, m * self.width), np.uint8).reshape(m, self.width)
            g = plink.DECODE[(raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3].reshape(m, -1)[:, : self.n]
            row, sample = np.nonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(row + v), pa.array(sample), pa.array(g[row, sample].astype(np.int32))], names=["variant_id", "sample_id", "g"])
        self.taken += file.taken


class Bed(DataSource):
    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return "variant_id long, sample_id long, g int"

    def reader(self, schema):
        return BedReader(self.options)


BGEN_SCHEMA = "id string, rsid string, chrom string, pos long, alleles array<string>, phased boolean, ploidy array<int>, copies array<array<double>>"


class BgenReader(DataSourceReader):
    """The variants of BGEN files with any number of alleles, any ploidy, phased or not; copies has for each alternative allele
    the expected copies of every sample, null where it is missing.

    A `.bgi` index beside a file (a table Variant of places and sizes) splits it by bytes and finds a region; without one
    a file is walked from variant to variant by one task, which reads past the probabilities outside the region."""

    def __init__(self, options):
        self.path, self.region, self.split = options["path"], parse_region(options.get("region")), int(options.get("split", SPLIT))
        self.taken = 0

    def partitions(self):
        out = []
        for path in files(self.path, (".bgen",)):
            if not exists(path + ".bgi"):
                out.append(Part("walk", path))
                continue
            index = File(path + ".bgi")
            with tempfile.NamedTemporaryFile(suffix=".bgi") as local:  # sqlite reads local files only; the driver reads the index
                local.write(index.read(0, index.size))
                local.flush()
                with sqlite3.connect(local.name) as db:
                    where, values = "", ()
                    if self.region:
                        where, values = "WHERE chromosome IN (?, ?, ?) AND position BETWEEN ? AND ?", (self.region[0], "chr" + self.region[0], self.region[0].zfill(2), *self.region[1:])
                    rows = db.execute(f"SELECT MIN(file_start_position), MAX(file_start_position + size_in_bytes) FROM Variant {where} GROUP BY file_start_position / {self.split} ORDER BY 1", values).fetchall()
            out += [Part("bytes", path, a, b) for a, b in rows]
        return out

    def read(self, part):
        if part is None:
            return
        file = File(part.path)
        first, n, compression, layout = bgen.header(file.read(0, 1 << 12))
        at, end, rows = (part.a, part.b, []) if part.kind == "bytes" else (first, file.size, [])
        while at < end:
            site, at, size, full = self._site(file, at, n, compression, layout)
            if not self.region or self._inside(site):
                data = bgen._plain(file.read(at, size), compression, full)
                phased, ploidy, copies = bgen.expected(data, n, len(site[4])) if layout == 2 else bgen.first_layout(data, n)
                rows.append((*site, phased, ploidy.tolist(), [[None if np.isnan(x) else x for x in c] for c in copies.tolist()]))
            at += size
            if len(rows) == 64:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)
        self.taken += file.taken

    def _inside(self, site) -> bool:
        chrom = site[2].removeprefix("chr")
        return (chrom == self.region[0] or chrom.lstrip("0") == self.region[0]) and self.region[1] <= site[3] <= self.region[2]

    @staticmethod
    def _site(file: File, at: int, n: int, compression: int, layout: int):
        """((id, rsid, chrom, pos, alleles), place, packed and plain size of the probabilities)."""
        data, size = b"", 1 << 10
        while True:
            data = file.read(at, size)
            try:
                k = 4 if layout == 1 else 0
                names = []
                for _ in range(3):
                    name, k = bgen._text(data, k, "<H")
                    names.append(name)
                pos, k = struct.unpack_from("<I", data, k)[0], k + 4
                count, k = (struct.unpack_from("<H", data, k)[0], k + 2) if layout == 2 else (2, k)
                alleles = []
                for _ in range(count):
                    allele, k = bgen._text(data, k, "<I")
                    alleles.append(allele)
                if layout == 1 and not compression:
                    packed = full = 6 * n
                else:
                    packed, k = struct.unpack_from("<I", data, k)[0], k + 4
                    full = 6 * n if layout == 1 else packed
                    if layout == 2 and compression:
                        full, packed, k = struct.unpack_from("<I", data, k)[0], packed - 4, k + 4
                if k > len(data):
                    raise struct.error
                return (*names, pos, alleles), at + k, packed, full
            except struct.error:
                if at + size >= file.size:
                    raise ValueError(f"a variant is cut at {at}") from None
                size *= 8

    @staticmethod
    def _batch(rows):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["id", "rsid", "chrom", "pos", "alleles", "phased", "ploidy", "copies"])


class Bgen(DataSource):
    @classmethod
    def name(cls):
        return "bgen"

    def schema(self):
        return BGEN_SCHEMA

    def reader(self, schema):
        return BgenReader(self.options)


def source(spark: SparkSession, kind: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def numbered_lines(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """(line, value) of a plain text file, lines that aren't blank counted from 0: only the counts of the byte ranges go to the
    driver."""
    lines = source(spark, Text, path, split=split)
    before, total = [], 0
    for r in sorted(lines.groupBy("part").agg(F.count("*").alias("c")).collect()):
        before.append((r.part, total))
        total += r.c
    before = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    return lines.join(before, "part").select((F.col("before") + F.col("k")).alias("line"), "value")
