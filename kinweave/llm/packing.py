"""Packing token sequences by cutting-stock column generation.

A document is cut into whole sequences, then a piece of a multiple of QUANTUM ids, then a rest below QUANTUM, so
lengths fall into CAPACITY / QUANTUM + QUANTUM - 1 classes that are exact. From the counts of the classes (the only
thing the driver sees) a linear program chooses how often each pattern of classes fills a sequence; a knapsack
dynamic program over the dual prices finds the next pattern to admit. Patterns are rounded down, the few pieces that
remain get patterns of their own, largest first. Pieces are ranked within their class, and the rank alone tells the
sequence and the offset: no piece is sorted or moved to be placed.

Edge cases: null or empty text is its end id alone; repeated rows are packed each for itself; an empty table gives
no pieces; null doc_id is kept as it is; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, texts_of
from .tokens import encoder

CAPACITY, QUANTUM = 2048, 32
#: Columns that the linear program may admit; with fewer it is only less tight.
MOST_COLUMNS = 2000

_PIECES_DDL = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long"


def cuts(n: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    whole, rest = divmod(n, CAPACITY)
    out = [CAPACITY] * whole
    return out + [x for x in (rest - rest % QUANTUM, rest % QUANTUM) if x]


def _pieces(path: str, end_id: int):
    def run(batches):
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = memoryview(encode.ids(text) + end)
                n, at = len(ids) >> 2, 0
                for length in cuts(n):
                    for column, x in zip(columns, (doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, ranks[length])):
                        column.append(x)
                    at, ranks[length] = at + length, ranks[length] + 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], ["part", *names])

    return run


def best_pattern(lengths: np.ndarray, prices: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of at most CAPACITY ids of the highest price."""
    value, last = np.zeros(CAPACITY + 1), np.full(CAPACITY + 1, -1)
    for c in range(1, CAPACITY + 1):
        fits = lengths <= c
        offers = value[c - lengths[fits]] + prices[fits]
        if len(offers) and (k := int(np.argmax(offers))) >= 0 and offers[k] > value[c - 1]:
            value[c], last[c] = offers[k], np.flatnonzero(fits)[k]
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(len(lengths), np.int64), CAPACITY
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(lengths[last[c]])
    return float(value[CAPACITY]), pattern


def choose_patterns(demand: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by length) and how many sequences each fills; together exactly the demand."""
    lengths = np.array(sorted(k for k, n in demand.items() if n), np.int64)
    if not len(lengths):
        return []
    need = np.array([demand[int(x)] for x in lengths], np.int64)
    patterns = [np.where(np.arange(len(lengths)) == i, CAPACITY // x, 0) for i, x in enumerate(lengths)]
    inverse = np.diag(1.0 / (CAPACITY // lengths))
    used = need * np.diag(inverse)
    for _ in range(MOST_COLUMNS):
        value, pattern = best_pattern(lengths, inverse.sum(axis=0))
        if value <= 1 + 1e-7:
            break
        column = inverse @ pattern
        grows = column > 1e-9
        ratio = np.where(grows, used / np.where(grows, column, 1), np.inf)
        out = int(np.argmin(ratio))
        patterns[out] = pattern
        inverse[out] /= column[out]
        for i in np.flatnonzero(np.abs(column) > 1e-15):
            if i != out:
                inverse[i] -= column[i] * inverse[out]
        used = np.maximum(inverse @ need, 0)
    chosen, left = [], need.copy()
    for i in np.argsort(-used, kind="stable"):
        p = patterns[i]
        times = min([int(used[i] + 1e-9), *(left[p > 0] // p[p > 0])])
        if times:
            chosen.append((p, times))
            left = left - times * p
    while left.any():
        room, p = CAPACITY, np.zeros(len(lengths), np.int64)
        for i in range(len(lengths) - 1, -1, -1):
            p[i] = min(left[i], room // lengths[i])
            room -= int(p[i] * lengths[i])
        times = int((left[p > 0] // p[p > 0]).min())
        chosen.append((p, times))
        left = left - times * p
    return [({int(x): int(k) for x, k in zip(lengths, p) if k}, int(times)) for p, times in chosen]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length the slots in order of rank: first rank, pieces a sequence, first sequence, offset of the first piece."""
    out: dict[int, list] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            out[length].append((ranks[length], k, sequence, offset))
            ranks[length] += k * times
            offset += k * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _placed(slots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own, s = length == x, slots[int(x)]
                r = rank[own]
                at = s[np.searchsorted(s[:, 0], r, side="right") - 1]
                q = r - at[:, 0]
                sequence[own] = at[:, 2] + q // at[:, 1]
                offset[own] = at[:, 3] + q % at[:, 1] * x
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    pieces = materialise(docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, end_id), _PIECES_DDL), "pieces")
    counted = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    demand = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # 95 classes at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank"))
    return ranked.mapInArrow(
        _placed(places(choose_patterns(demand))), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op4_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
