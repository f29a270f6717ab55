"""Places of elements with substitutions, insertions and deletions: seeds, bands of diagonals, edit distances by column.

Of most + 1 disjoint parts of an element one stands unchanged in any place of at most so many edits, and all of the
alignment lies within most diagonals of that part's. Diagonals are gathered in cells, so that many seeds of one place are
one band; a band meets the chunk that holds its text.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import as_chunks
from .locate import _diagonals, _size, _stride, strands
from .regions import islands

#: Diagonals of a cell at least.
CELL = 16
#: Numbers of the distance table that a task holds at once.
TABLE = 1 << 22
#: More than any distance, and no overflow when added to.
FAR = 1 << 20
#: Stands for the text before a contig's begin and behind its end; no code point.
OUTSIDE = 0x7FFFFFFF


def distances(q: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The table (row, i, k) of least edits of the first i characters of q against the text that ends at i + k.

    q is (row, length), text (row, length + band). Text begins anywhere; characters outside of a contig are never taken.
    """
    rows, n = q.shape
    band = text.shape[1] - n
    out = np.empty((rows, n + 1, band), np.int32)
    out[:, 0] = 0
    ladder = np.arange(band, dtype=np.int32)
    for i in range(1, n + 1):
        at = text[:, i - 1 : i - 1 + band]  # the text's character that stands against q's i-th
        both = out[:, i - 1] + np.where(at == OUTSIDE, FAR, at != q[:, i - 1 : i])
        both[:, :-1] = np.minimum(both[:, :-1], out[:, i - 1, 1:] + 1)  # a character of q alone
        out[:, i] = np.minimum.accumulate(both - ladder, axis=1) + ladder  # characters of the text alone
    return out


def traced(table: np.ndarray, q: np.ndarray, text: np.ndarray, k: int) -> tuple[int, str]:
    """(start, CIGAR) of the alignment of one row that ends on diagonal k: pairs first, then insertions, then deletions."""
    i, ops = len(q), []
    while i:
        at = text[i - 1 + k]
        if at != OUTSIDE and table[i, k] == table[i - 1, k] + (at != q[i - 1]):
            ops.append("=" if at == q[i - 1] else "X")
            i -= 1
        elif k + 1 < table.shape[1] and table[i, k] == table[i - 1, k + 1] + 1:
            ops.append("I")
            i, k = i - 1, k + 1
        else:
            ops.append("D")
            k -= 1
    return k, "".join(f"{len(list(g))}{op}" for op, g in groupby(reversed(ops)))


def _aligned(most: int):
    """Ends of at most so many edits in bands (keys..., q, base, text), with their CIGAR where no neighbour is better."""
    keys = ["id", "strand", "genome", "contig"]

    def codes(x: str) -> np.ndarray:
        return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)

    def ends(batch, q, rows, bases, texts):
        wide = texts[0].shape[0]
        step = max(1, TABLE // ((wide - len(q) + 1) * (len(q) + 1)))
        for a in range(0, len(rows), step):
            text = np.stack(texts[a : a + step])
            table = distances(np.repeat(q[None], len(text), 0), text)
            last = np.pad(table[:, -1], ((0, 0), (1, 1)), constant_values=FAR)
            good = last[:, 1:-1] <= most
            lowest = good & (last[:, 1:-1] < last[:, :-2]) & (last[:, 1:-1] <= last[:, 2:])
            for r, k in np.argwhere(good).tolist():
                at = bases[a + r] + len(q) + k
                start, cigar = traced(table[r], q, text[r], k) if lowest[r, k] else (None, None)
                yield rows[a + r], at, int(table[r, -1, k]), None if start is None else bases[a + r] + start, cigar

    def run(batches):
        for batch in batches:
            groups: dict[tuple[str, int], list] = {}
            columns = [batch.column(c).to_pylist() for c in ("q", "band", "base", "lead", "text")]
            for row, (q, band, base, lead, text) in enumerate(zip(*columns)):
                have = codes(text)
                line = np.full(len(q) + band, OUTSIDE, np.int32)
                line[lead : lead + len(have)] = have[: len(line) - lead]
                groups.setdefault((q, band), []).append((row, base, line))
            found = [x for (q, _), some in groups.items() for x in ends(batch, codes(q), *map(list, zip(*some)))]
            if found:
                of, *rest = zip(*found)
                kept = batch.select(keys).take(pa.array(of))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, t) for c, t in zip(rest, types)]], [*keys, "end", "edits", "start", "cigar"])

    return run


def ends(elements: DataFrame, sequences: DataFrame, most: int, seed: int) -> DataFrame:
    """(id, strand, genome, contig, end, edits, start, cigar): all ends of text that at most so many edits turn into an element.

    edits is the least number over all starts. start and cigar are there where no neighbouring end is better.
    """
    parts = most + 1
    shortest, longest = elements.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if shortest is not None and shortest < seed * parts:
        raise ValueError("seed too long for the shortest element")
    longest = longest or 1
    cell = max(CELL, 2 * most + 1)
    band = cell + 2 * most
    both = strands(elements.select("id", "seq"))
    cells, _ = _diagonals(both, sequences, parts, seed, _stride(shortest or seed * parts, parts, seed))
    base = F.floor(F.col("start") / cell) * cell - most
    cells = cells.select("id", "strand", "genome", "contig", base.alias("base")).distinct().join(both, ["id", "strand"])
    size = _size(sequences, longest + band)
    first = F.greatest(F.col("base"), F.lit(0))
    at = cells.withColumn("lead", (first - F.col("base")).cast("int")).withColumn("chunk", F.floor(first / size))
    inside = (F.greatest(F.col("base"), F.lit(0)) - F.col("chunk") * size + 1).cast("int")
    at = at.join(as_chunks(sequences, size, longest + band), ["genome", "contig", "chunk"])
    text = F.substring(F.col("seq"), inside, (F.length("q") + band - F.col("lead")).cast("int"))
    bands = at.select("id", F.col("strand"), "genome", "contig", "q", F.lit(band).alias("band"), F.col("base").cast("long").alias("base"), "lead", text.alias("text"))
    kind = dict(elements.dtypes)["id"]
    found = bands.mapInArrow(_aligned(most), f"id {kind}, strand string, genome string, contig string, end long, edits int, start long, cigar string")
    best = F.min(F.struct("edits", F.col("cigar").isNull().alias("bare"), (-F.col("start")).alias("back"), "cigar")).alias("x")  # an end may lie in two cells
    out = found.groupBy("id", "strand", "genome", "contig", "end").agg(best)
    return out.select("id", "strand", "genome", "contig", "end", "x.edits", (-F.col("x.back")).alias("start"), "x.cigar")


def locate_gapped(elements: DataFrame, sequences: DataFrame, most: int, seed: int) -> DataFrame:
    """(id, genome, contig, start, end, strand, edits, cigar) of elements (id, seq) in sequences, on both strands.

    Neighbouring ends of at most so many edits are one place, told by the one of fewest edits, the first of equals. No
    place is missed and no number of places is capped. The CIGAR has the signs =, X, I and D; sequences are whole, or chunks
    of CHUNK characters. Null elements have no places; elements shorter than seed times the parts raise.
    """
    by = ["id", "strand", "genome", "contig"]
    all_ends = ends(elements, sequences, most, seed)
    gap = F.col("end") - F.lag("end").over(Window.partitionBy(*by).orderBy("end")) > 1
    places = islands(all_ends, by, ["end"], gap, "place").groupBy(*by, "place").agg(F.min(F.struct("edits", "end", "start", "cigar")).alias("x"))
    return places.select("id", "genome", "contig", "x.start", "x.end", "strand", "x.edits", "x.cigar")


def locate_gapped_all(elements: DataFrame, sequences: DataFrame, most: int, seed: int) -> DataFrame:
    """locate_gapped for elements of different lengths: those too short for the seed are found by the longest that their
    parts hold. Null elements have none; elements of at most so many characters raise, as each position is a place of theirs."""
    sized = elements.where("seq IS NOT NULL").withColumn("_seed", F.least(F.lit(seed), F.floor(F.length("seq") / (most + 1))).cast("int"))
    sizes = sorted(r["_seed"] for r in sized.select("_seed").distinct().collect())  # at most seed + 1 rows
    if sizes and not sizes[0]:
        raise ValueError("an element of no more characters than edits is everywhere")
    found = [locate_gapped(sized.where(F.col("_seed") == n).drop("_seed"), sequences, most, n) for n in sizes or [seed]]
    return reduce(DataFrame.unionByName, found)
