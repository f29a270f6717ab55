"""BAM files by byte ranges: tasks find the first compressed block and the first record of their range on their own."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _stem

#: Bytes of a file that one task reads.
RANGE = 64 << 20
#: Bytes that are fetched at once; no compressed block is longer than 64 KiB.
FETCHED = 1 << 20
#: Records in a row that must be sound for the first of them to be taken as a record's begin.
SOUND = 4
#: Records of an Arrow batch.
BATCH = 8192

# Fixed values of the format.
LETTERS = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

FIELDS = "query string, flag int, contig string, pos long, mapq int, cigar string, seq string, score int, md string"


class Blocks:
    """Compressed blocks of a file from a place on; bytes are fetched as they are needed."""

    def __init__(self, path: str, begin: int):
        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:", "", path))
        self.file, self.end, self.start, self.have = system.open_input_file(name), 0, begin, b""
        self.end = self.file.size()

    def _need(self, at: int, n: int) -> bytes:
        """n bytes from at on, fewer at the file's end."""
        if at < self.start or at + n > self.start + len(self.have):
            self.have, self.start = self.file.read_at(min(max(n, FETCHED), max(0, self.end - at)), at), at
        return self.have[at - self.start : at - self.start + n]

    def size(self, at: int) -> int:
        """Bytes of the block at a place, 0 where there is none."""
        head = self._need(at, 12)
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            return 0
        extra = self._need(at + 12, int.from_bytes(head[10:12], "little"))
        while len(extra) >= 6:
            n = int.from_bytes(extra[2:4], "little")
            if extra[:2] == b"BC" and n == 2:
                return int.from_bytes(extra[4:6], "little") + 1
            extra = extra[4 + n :]
        return 0

    def first(self, begin: int) -> int:
        """The first block at or after a place: three in a row must have a sound head."""
        for at in range(begin, min(begin + (1 << 17), self.end)):
            place = at
            for _ in range(3):
                step = self.size(place)
                place += step
                if not step or place == self.end:
                    break
            if step:
                return at
        return self.end

    def texts(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(place, letters) of the blocks from a place on."""
        while at < self.end:
            n = self.size(at)
            if not n:
                raise ValueError("a compressed block is damaged")
            raw = self._need(at, n)
            skip = 12 + int.from_bytes(raw[10:12], "little")
            yield at, zlib.decompress(raw[skip:-8], -15)
            at += n


class Records:
    """The letters of blocks as one growing text, of which passed parts are dropped."""

    def __init__(self, texts: Iterator[tuple[int, bytes]]):
        self.texts, self.text, self.places = texts, bytearray(), []

    def reach(self, n: int) -> bool:
        while len(self.text) < n:
            place, more = next(self.texts, (None, b""))
            if place is None:
                return False
            self.places.append((len(self.text), place))
            self.text += more
        return True

    def block(self, at: int) -> int:
        """The place of the block in which a character lies."""
        return max(x for x in self.places if x[0] <= at)[1]

    def drop(self, n: int) -> None:
        last = max(i for i, x in enumerate(self.places) if x[0] <= n)
        del self.text[:n]
        self.places = [(max(a - n, 0), p) for a, p in self.places[last:]]


def header(texts: Iterator[tuple[int, bytes]]) -> tuple[list[tuple[str, int]], int]:
    """Names and lengths of contigs, and the characters that the header takes."""
    records = Records(texts)
    number = lambda at: struct.unpack_from("<i", records.text, at)[0] if records.reach(at + 4) else 0
    records.reach(4)
    if records.text[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    contigs = []
    n, at = number(at), at + 4
    for _ in range(n):
        size = number(at)
        records.reach(at + 8 + size)
        contigs.append((records.text[at + 4 : at + 3 + size].decode(), number(at + 4 + size)))
        at += 8 + size
    return contigs, at


def _sound(records: Records, at: int, contigs: int) -> bool:
    """Whether records can begin here: so many in a row, or up to the end."""
    for _ in range(SOUND):
        if not records.reach(at + 36):
            return len(records.text) == at
        size, ref, pos, name, _, _, ops, _, letters, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", records.text, at)
        least = 32 + name + 4 * ops + (letters + 1) // 2 + letters
        if not (-1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and name > 0 and letters >= 0 and least <= size < 1 << 29):
            return False
        if not records.reach(at + 4 + least):
            return False
        text = records.text[at + 36 : at + 36 + name]
        if text[-1] or any(not 33 <= c <= 126 for c in text[:-1]) or any(c & 15 > 8 for c in struct.unpack_from(f"<{ops}I", records.text, at + 36 + name)):
            return False
        at += 4 + size
        if not records.reach(at):
            return False
    return True


def _tags(raw: bytes) -> dict[str, tuple[str, object]]:
    found, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            found[name], at = raw[at:end].decode("latin-1"), end + 1
        elif kind == "A":
            found[name], at = chr(raw[at]), at + 1
        elif kind == "B":
            of, n = NUMBERS[chr(raw[at])], int.from_bytes(raw[at + 1 : at + 5], "little")
            found[name] = struct.unpack_from(f"<{n}{of}", raw, at + 5)
            at += 5 + n * struct.calcsize(of)
        else:
            of = NUMBERS[kind]
            found[name], at = struct.unpack_from(f"<{of}", raw, at)[0], at + struct.calcsize(of)
    return found


def decoded(raw: bytes, contigs: list[str]) -> tuple:
    """FIELDS of a record, as the same record of SAM text has them."""
    ref, pos, name, mapq, _, n, flag, letters = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + name
    ops = struct.unpack_from(f"<{n}I", raw, at)
    packed = raw[at + 4 * n : at + 4 * n + (letters + 1) // 2]
    seq = "".join(LETTERS[b >> 4] + LETTERS[b & 15] for b in packed)[:letters]
    tags = _tags(raw[at + 4 * n + (letters + 1) // 2 + letters :])
    if "CG" in tags and ops and ops[0] == letters << 4 | 4:  # a CIGAR too long for its field
        ops = tags["CG"]
    cigar = "".join(f"{op >> 4}{OPS[op & 15]}" for op in ops) or "*"
    score = tags.get("AS")
    return raw[32 : at - 1].decode("latin-1"), flag, contigs[ref] if ref >= 0 else "*", pos, mapq, cigar, seq or None, None if score is None else int(score), tags.get("MD")


def _of_range(path: str, begin: int, end: int) -> Iterator[tuple]:
    """Records that begin in the blocks that begin in a range of bytes."""
    contigs, skip = header(Blocks(path, 0).texts(0))
    names = [c for c, _ in contigs]
    blocks = Blocks(path, begin)
    records, at = Records(blocks.texts(blocks.first(begin))), skip if begin == 0 else 0
    if begin:
        while records.reach(at + 1) and not _sound(records, at, len(names)):
            if records.block(at) >= end:
                return
            at += 1
    while records.reach(at + 4) and records.block(at) < end:
        n = struct.unpack_from("<i", records.text, at)[0]
        if not records.reach(at + 4 + n):
            raise ValueError("the file ends within a record")
        yield decoded(bytes(records.text[at + 4 : at + 4 + n]), names)
        at += 4 + n
        if at > FETCHED and records.reach(at + 1):
            records.drop(at)
            at = 0


def _read(batches):
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
    names = ["assembly", "block", "i", *[f.split()[0] for f in FIELDS.split(", ")]]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for given in batches:
        for r in given.to_pylist():
            rows = []
            for i, fields in enumerate(_of_range(r["path"], r["begin"], r["end"])):
                rows.append((r["assembly"], r["begin"], i, *fields))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def bam(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """readers.sam of BAM files: the same columns, read by ranges of bytes, a task each.

    A range's records are those that begin in its blocks. Where records begin is told by the record heads themselves
    (SOUND in a row, or up to the file's end); no index is needed. Tasks open files by their URI, or from shared folders.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", _stem(r"\.bam").alias("assembly")).where("length > 0")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("begin")
    ranges = files.select("path", "assembly", begin).withColumn("end", F.col("begin") + size)
    spread = ranges.repartition(max(1, ranges.count()))  # a row a task, dealt in turn
    rows = spread.mapInArrow(_read, f"assembly string, block long, i long, {FIELDS}")
    return rows.select("assembly", F.struct("block", "i").alias("line"), *[f.split()[0] for f in FIELDS.split(", ")])


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) from the headers of BAM files."""

    def run(batches):
        for batch in batches:
            for p in batch.column("path").to_pylist():
                found, _ = header(Blocks(p, 0).texts(0))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found]), pa.array([n for _, n in found], pa.int64())], ["contig", "length"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").select("path")
    return files.mapInArrow(run, "contig string, length long").distinct()
