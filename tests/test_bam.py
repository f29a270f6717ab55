"""BAM files against the SAM text of the same records, with blocks and ranges that cut records anywhere."""

import random
import struct
import zlib

import pytest

from kinweave.operators import alignments
from kinweave.sources import bam, readers


def packed(line, contigs):
    query, flag, contig, pos, mapq, cigar, _, _, _, seq, _, *tags = line.split("\t")
    ops = [] if cigar == "*" else [(int(n) << 4) | bam.OPS.index(op) for n, op in bam.re.findall(r"(\d+)(\D)", cigar)]
    letters = "" if seq == "*" else seq
    raw = b""
    for tag in tags:
        name, kind, value = tag.split(":", 2)
        raw += name.encode() + kind.encode() + (struct.pack("<i", int(value)) if kind == "i" else value.encode() + b"\0")
    raw += b"XBBs" + struct.pack("<ihh", 2, 5, -7) + b"XCAq"
    if len(ops) > 60:  # as where a CIGAR is too long for its field
        raw += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(letters) << 4 | 4, 9 << 4 | 3]
    codes = [bam.LETTERS.index(c) for c in letters] + [0]
    seq = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(letters), 2))
    ref = contigs.index(contig) if contig != "*" else -1
    body = struct.pack("<iiBBHHHiiii", ref, int(pos) - 1, len(query) + 1, int(mapq), 0, len(ops), int(flag), len(letters), -1, -1, 0)
    body += query.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + seq + b"\xff" * len(letters) + raw
    return struct.pack("<i", len(body)) + body


def compressed(text, size):
    out = b""
    for i in range(0, len(text) + 1, size):  # the last one is empty
        part = text[i : i + size] if i < len(text) else b""
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("block,size", [(97, 300), (1000, 700), (60000, 1 << 20), (400, 5000)])
def test_bam_equals_sam(spark, tmp_path, block, size):
    draw = random.Random(block)
    contigs = ["chr1", "chr2", "a" * 40]
    lines = []
    for i in range(400):
        seq = "".join(draw.choices("ACGTN", k=draw.choice([1, 20, 33, 400])))
        flag, contig = draw.choice([0, 16, 256, 4, 2048]), draw.choice(contigs)
        cigar = draw.choice([f"{len(seq)}M", f"{len(seq)}=", f"3S2I1D{len(seq)}X"]) if len(seq) < 400 else "1=" * 200 + f"{len(seq) - 200}X"
        head = f"q{i % 90}\t4\t*\t0\t0\t*" if flag == 4 else f"q{i % 90}\t{flag}\t{contig}\t{draw.randrange(1, 9999)}\t{draw.randrange(61)}\t{cigar}"
        tags = draw.choice(["", f"\tAS:i:{draw.randrange(-50, 50)}", f"\tAS:i:7\tMD:Z:{len(seq)}"])
        lines.append(f"{head}\t*\t0\t0\t{'*' if flag == 256 else seq}\t*{tags}")
    sq = "".join(f"@SQ\tSN:{c}\tLN:{9999 + i}\n" for i, c in enumerate(contigs))
    (tmp_path / "x.sam").write_text(sq + "\n".join(lines) + "\n")
    head = b"BAM\1" + struct.pack("<i", len(sq)) + sq.encode() + struct.pack("<i", 3) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 9999 + i) for i, c in enumerate(contigs))
    raw = compressed(head + b"".join(packed(x, contigs) for x in lines), block)
    (tmp_path / "x.bam").write_bytes(raw)
    fields = [f.split()[0] for f in bam.FIELDS.split(", ")]
    text, binary = readers.sam(spark, str(tmp_path / "x.sam")), bam.bam(spark, str(tmp_path / "x.bam"), size)
    assert binary.rdd.getNumPartitions() == -(-len(raw) // size)
    read = sorted(binary.collect(), key=lambda r: r["line"])
    assert [tuple(r[f] for f in fields) for r in read] == [tuple(r[f] for f in fields) for r in sorted(text.collect(), key=lambda r: r["line"])]
    assert sorted(map(tuple, bam.contigs(spark, str(tmp_path / "x.bam")).collect())) == sorted(map(tuple, readers.sam_contigs(spark, str(tmp_path / "x.sam")).collect()))
    last = lambda x: sorted(map(tuple, alignments.last_positions(x).collect()))
    assert last(binary) == last(text)
    assert binary.schema.simpleString() == text.schema.simpleString()


def test_damaged(spark, tmp_path):
    with pytest.raises(ValueError):
        bam.header(iter([(0, b"SAM\1")]))
    (tmp_path / "empty.bam").write_bytes(compressed(b"BAM\1" + bytes(8), 50))
    assert bam.bam(spark, str(tmp_path / "empty.bam"), 10).count() == 0 and bam.contigs(spark, str(tmp_path / "empty.bam")).count() == 0
