"""Token ids in binary segments with Elias-Fano coded document boundaries.

The output is a Parquet table of segments in ascending doc_id order (so any store that Spark writes will do, and
Spark's committer makes lost executors harmless). A segment holds whole documents: their ids end to end (two bytes
an id where the vocabulary allows), and the end offset of each document in Elias-Fano form: low bits packed, high
bits in unary, and the place of every SAMPLE-th one bit, so that an offset is found by select without a table of
64-bit offsets. Offsets are within the segment; the sum of the segments before gives the global start.

Edge cases: null or empty text is a document of its end id alone; null doc_ids come first; rows of one doc_id are
in order of their text; a document longer than a segment is a segment of its own; an empty table has no segments;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, texts_of
from .tokens import encoder

SAMPLE = 64
#: A segment ends with the document that reaches so many ids.
SEGMENT_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of n integers below 2 ** 32 in about n * (2 + log2(largest / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.packbits((v[:, None] >> np.arange(width)) & 1, bitorder="little") if width else np.zeros(0, np.uint8)
        ones = (v >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        b = a + self.low_bits
        return int.from_bytes(self.low[a >> 3 : (b + 7) >> 3], "little") >> (a & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one bit, on to the i-th, in whole bytes."""
        at = int.from_bytes(self.samples[4 * (i // SAMPLE) : 4 * (i // SAMPLE) + 4], "little")
        left, byte = i % SAMPLE, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            out |= bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return out


_SEGMENT = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("low_bits", pa.int32())]
    + [("doc_ids", pa.list_(pa.int64())), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()), ("ids", pa.large_binary())]
)
_SEGMENT_DDL = "part int, segment int, n_docs long, n_ids long, id_bytes int, low_bits int, doc_ids array<long>, low binary, high binary, samples binary, ids binary"


def _encoded(path: str, end_id: int):
    def run(batches):
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        doc_ids, ids, segment = [], [], 0

        def packed() -> pa.RecordBatch:
            ends = EliasFano.of(np.cumsum([len(x) >> 2 for x in ids]))
            flat = np.frombuffer(b"".join(ids), "<u4")
            width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
            row = [part, segment, len(ids), len(flat), width, ends.low_bits, doc_ids, ends.low, ends.high, ends.samples, flat.astype(f"<u{width}").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SEGMENT)], schema=_SEGMENT)

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                doc_ids.append(doc_id)
                ids.append(encode.ids(text) + end)
                held += len(ids[-1]) >> 2
                if held >= SEGMENT_IDS:
                    yield packed()
                    doc_ids, ids, segment, held = [], [], segment + 1, 0
        if ids:
            yield packed()

    return run


def write_segments(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The segment table of docs, as read back from the shared folder."""
    in_order = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(in_order.mapInArrow(_encoded(vocabulary, end_id), _SEGMENT_DDL), "segments")


def _decoded(batches):
    for batch in batches:
        for r in batch.to_pylist():
            coded = EliasFano(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"])
            ends = np.fromiter(map(coded.select, range(r["n_docs"])), np.int64, r["n_docs"])
            starts = np.concatenate(([0], ends[:-1]))
            flat = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = r["n_docs"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * n, pa.int32()), pa.array([r["segment"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                ["part", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, segment, base): ids of all segments before; parts are added up first, so that no window spans all segments."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    local = segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part"))
    return local.join(parts, "part").select("part", "segment", (F.col("part_base") + F.col("in_part")).alias("base"))


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a segment table."""
    docs = segments.mapInArrow(_decoded, "part int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    placed = docs.join(segment_starts(segments), ["part", "segment"])
    return placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_binary(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    return read_documents(write_segments(table(spark, sf_dir, "documents"), path, end_id=2))
