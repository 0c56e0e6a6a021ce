"""BCF records as VCF lines."""

from __future__ import annotations

import re
import struct

import numpy as np

from .blocks import Stream

#: Typed values: numpy type and the bit patterns that stand for a missing value and for a vector's end.
_KINDS = {1: ("<i1", -128, -127), 2: ("<i2", -32768, -32767), 3: ("<i4", -(1 << 31), 1 - (1 << 31)), 5: ("<i4", 0x7F800001, 0x7F800002)}


class Header:
    """The header's text lines, the names of filters, INFO and FORMAT tags, the contigs and the number of samples."""

    def __init__(self, stream: Stream):
        if stream.read(5) != b"BCF\x02\x02":
            raise ValueError("not a BCF 2 file")
        self.lines = stream.read(struct.unpack("<I", stream.read(4))[0]).rstrip(b"\0").decode().rstrip("\n").split("\n")
        self.tags, self.contigs = {0: "PASS"}, {}
        known = {"PASS"}
        for line in self.lines:
            m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<.*?\bID=([^,>]+)", line)
            if m:
                table = self.contigs if m[1] == "contig" else self.tags
                idx = re.search(r"\bIDX=(\d+)", line)
                if idx:
                    table[int(idx[1])] = m[2]
                elif m[1] == "contig" or m[2] not in known:
                    table[len(table)] = m[2]
                known.add(m[2])


def _descriptor(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, length, place of the values)."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        inner, _, at = _descriptor(data, at)
        n = int(np.frombuffer(data, _KINDS[inner][0], 1, at)[0])
        at += int(_KINDS[inner][0][2])
    return kind, n, at


def _numbers(raw: np.ndarray, kind: int) -> str:
    """One value's numbers, comma-separated, up to the vector's end."""
    _, missing, end = _KINDS[kind]
    out = []
    for v in raw.tolist():
        if v == end:
            break
        out.append("." if v == missing else str(np.int32(v).view(np.float32)) if kind == 5 else str(v))
    return ",".join(out) or "."


def _value(data: bytes, at: int) -> tuple[str | None, int]:
    """(text, place after) of a typed value; None for one without type."""
    kind, n, at = _descriptor(data, at)
    if kind == 0:
        return None, at
    if kind == 7:
        return data[at : at + n].rstrip(b"\0").decode() or ".", at + n
    width = int(_KINDS[kind][0][2])
    return (_numbers(np.frombuffer(data, _KINDS[kind][0], n, at), kind) if n else "."), at + n * width


def _genotype(raw: np.ndarray, end: int) -> str:
    out = ""
    for k, v in enumerate(raw.tolist()):
        if v == end:
            break
        out += ("|" if v & 1 else "/") * (k > 0) + (str((v >> 1) - 1) if v >> 1 > 0 else ".")
    return out or "."


def record(stream: Stream, header: Header) -> tuple[str, int, str] | None:
    """(chrom, pos, VCF line) of the next record, None at the end."""
    head = stream.read(8)
    if len(head) < 8:
        return None
    shared, individual = struct.unpack("<II", head)
    data, rest = stream.read(shared), stream.read(individual)
    chrom, pos, _, quality, counts, samples = struct.unpack_from("<iiiiII", data)
    name, at = _value(data, 24)
    alleles = []
    for _ in range(counts >> 16):
        allele, at = _value(data, at)
        alleles.append(allele)
    filters, at = _value(data, at)
    info = []
    for _ in range(counts & 0xFFFF):
        key, at = _value(data, at)
        value, at = _value(data, at)
        info.append(header.tags[int(key)] + ("" if value is None else f"={value}"))
    n, tags, columns, at = samples & 0xFFFFFF, [], [], 0
    for _ in range(samples >> 24):
        key, at = _value(rest, at)
        kind, width, at = _descriptor(rest, at)
        tag = header.tags[int(key)]
        tags.append(tag)
        if kind == 7:
            columns.append([rest[at + k * width : at + (k + 1) * width].rstrip(b"\0").decode() or "." for k in range(n)])
            at += n * width
        else:
            raw = np.frombuffer(rest, _KINDS[kind][0], n * width, at).reshape(n, width)
            columns.append([_genotype(r, _KINDS[kind][2]) if tag == "GT" else _numbers(r, kind) for r in raw])
            at += raw.nbytes
    names = "." if filters in (None, ".") else ";".join(header.tags[int(k)] for k in filters.split(","))
    text = [header.contigs[chrom], str(pos + 1), name or ".", alleles[0], ",".join(alleles[1:]) or ".", "." if quality == 0x7F800001 else str(np.int32(quality).view(np.float32)), names, ";".join(info) or "."]
    cells = [":".join(tags), *(":".join(c[k] for c in columns) for k in range(n))] if tags else []
    return text[0], pos + 1, "\t".join(text + cells)
