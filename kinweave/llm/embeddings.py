"""Near-duplicate vectors by int8 tile products with rigorous error bounds, confirmed in double precision.

Equal vectors of a label (by two 64-bit hashes) are one representative with a weight. Representatives are ordered by
label and by their projection on a fixed direction and cut into blocks of at most BLOCK; two blocks whose boxes of
projections are further apart than linked vectors can be are no pair. Blocks travel as int8 codes with a scale and
an error a vector. A tile multiplies the codes of two blocks; with u = s q + e, the product of two unit vectors
differs from s s' q.q' by at most |e| |u'| + |e'| |u| + |e| |e'|, so pairs that cannot reach the threshold fall away.
Only tiles with open pairs fetch their blocks' vectors, and compute those pairs again in double precision. A tile
returns partner counts and a spanning forest, never its pairs.

Edge cases: a vector that is null, zero or has a null or non-finite component, or whose label is null, links with
nothing (n_links 0, its own component). Vectors of other lengths than a block's majority are compared within their
length only. A null vec_id can name no component: such a row stays alone (component_id null). Repeated rows link
with each other; ties go to the smallest vec_id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, materialise, table

BLOCK = 1024
#: Projections that bound a block.
AXES = 4


@cache
def _axes(width: int) -> np.ndarray:
    """AXES orthonormal directions, fixed by the width."""
    q, _ = np.linalg.qr(np.random.default_rng(width).standard_normal((width, min(AXES, width))))
    return np.pad(q, ((0, 0), (0, AXES - q.shape[1])))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that neither large nor tiny components leave the range."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _projected(batches):
    """Adds the width, and the projection on the first axis; rows of one width at a time."""
    for batch in batches:
        lists = batch.column("embedding")
        flat, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        width = np.diff(ends)
        firsts = np.zeros(len(width))
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            firsts[own] = _unit(flat[ends[own][:, None] + np.arange(w)]) @ _axes(int(w))[:, 0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width, pa.int32()), pa.array(firsts)], [*batch.schema.names, "width", "first"])


_BLOCK_DDL = "label int, width int, block long, n int, reps binary, weights binary, codes binary, scales binary, errors binary, vectors binary, low array<double>, high array<double>"


def _blocks(batches):
    """Blocks of rows that come sorted by label, width and projection."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def packed(rows: list) -> pa.RecordBatch:
        nonlocal number
        label, width, number = rows[0][0], rows[0][1], number + 1
        vectors = np.array([r[4] for r in rows], np.float64)
        units = _unit(vectors)
        at, (codes, scales, errors) = units @ _axes(width), quantised(units)
        columns = [label, width, (part << 32) + number, len(rows), np.array([r[2] for r in rows], "<i8").tobytes(), np.array([r[3] for r in rows], "<i8").tobytes()]
        columns += [codes.tobytes(), scales.tobytes(), errors.tobytes(), vectors.tobytes(), at.min(axis=0), at.max(axis=0)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _BLOCK_DDL.split(", ")])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("label", "width", "rep", "weight", "embedding"))):
            if held and (row[:2] != held[0][:2] or len(held) == BLOCK):
                yield packed(held)
                held = []
            held.append(row)
    if held:
        yield packed(held)


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and length of the error of each unit vector."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    error = np.sqrt(((units - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9) + 1e-12


def open_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of (codes, scales, errors) whose cosine may reach the threshold."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    # products of int8 codes are whole numbers below 2 ** 24 for up to 1040 components: exact in single precision, which has a fast kernel
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    product = qa.astype(kind) @ qb.astype(kind).T
    return np.nonzero(product * sa[:, None] * sb + ea[:, None] + eb + ea[:, None] * eb >= threshold - 1e-9)


def confirmed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of rows of a and b whose cosine in double precision is at least threshold."""
    exact = np.concatenate([(a[i[k : k + 65536]] * b[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0)])
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    cosine = exact / (norm(a)[i] * norm(b)[j])
    odd = ~np.isfinite(cosine)
    if odd.any():
        cosine[odd] = (_unit(a)[i[odd]] * _unit(b)[j[odd]]).sum(axis=1)
    return i[cosine >= threshold], j[cosine >= threshold]


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of cosine at least threshold: int8 products first, then double precision where they leave it open."""
    return confirmed(a, b, *open_pairs(quantised(_unit(a)), quantised(_unit(b)), threshold), threshold)


def _opened(threshold: float):
    """Of tiles of codes: those that have open pairs, with the pairs."""

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                a, b = ((np.frombuffer(t["codes" + s], np.int8).reshape(-1, t["width"]), np.frombuffer(t["scales" + s]), np.frombuffer(t["errors" + s])) for s in ("", "2"))
                i, j = open_pairs(a, b, threshold)
                if t["block"] == t["block2"]:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    columns = [pa.array([t["block"]]), pa.array([t["block2"]]), pa.array([i.astype("<i4").tobytes()], pa.binary()), pa.array([j.astype("<i4").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "block2", "i", "j"])

    return run


def _tiles(threshold: float):
    """Of tiles with open pairs and vectors: links by representative, and a spanning forest of the linked ones."""

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                same = t["block"] == t["block2"]
                a, b = (np.frombuffer(t["vectors" + s]).reshape(-1, t["width"]) for s in ("", "2"))
                reps, reps2, weights, weights2 = (np.frombuffer(t[c], "<i8") for c in ("reps", "reps2", "weights", "weights2"))
                i, j = confirmed(a, b, np.frombuffer(t["i"], "<i4"), np.frombuffer(t["j"], "<i4"), threshold)
                links = np.bincount(i, weights2[j], len(a)), np.bincount(j, weights[i], len(b))
                forest = Forest(len(a) + len(b))
                tree = [(x, y) for x, y in zip(i.tolist(), j.tolist()) if forest.joined(x, y if same else len(a) + y)]
                counted = [(r, int(n)) for rs, ns in ((reps, links[0]), (reps2, links[1])) for r, n in zip(rs.tolist(), ns) if n]
                columns = [[r for r, _ in counted] + [int(reps[x]) for x, _ in tree], [n for _, n in counted] + [0] * len(tree), [None] * len(counted) + [int(reps2[y]) for _, y in tree]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "other"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label)."""
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = sound & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    plain = F.transform("embedding", lambda x: x + 0.0)  # one zero
    hashed = [F.when(F.col("sound"), F.xxhash64(F.lit(k), "label", plain)).alias(f"h{k}") for k in (1, 2)]
    rows = materialise(rows.select("*", *hashed), "vectors")

    classes = rows.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    projected = classes.mapInArrow(_projected, "h1 long, h2 long, rep long, weight long, label int, embedding array<double>, width int, first double")
    classes = materialise(projected, "vector-classes")
    in_order = classes.select("label", "width", "first", "rep", "weight", "embedding").repartitionByRange("label", "width", "first").sortWithinPartitions("label", "width", "first", "rep")
    blocks = materialise(in_order.mapInArrow(_blocks, _BLOCK_DDL), "blocks")

    # |u - v| <= sqrt(2 - 2 threshold) for linked unit vectors, in any projection
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    boxes = blocks.select("label", "width", "block", "low", "high")
    near = (F.col("a.label") == F.col("b.label")) & (F.col("a.width") == F.col("b.width")) & (F.col("a.block") <= F.col("b.block"))
    for k in range(AXES):
        near = near & (F.col("a.low")[k] <= F.col("b.high")[k] + reach) & (F.col("b.low")[k] <= F.col("a.high")[k] + reach)
    pairs = materialise(boxes.alias("a").join(boxes.alias("b"), near).select(F.col("a.block").alias("block"), F.col("b.block").alias("block2")), "tiles")
    def sides(of: DataFrame, columns: list[str]) -> DataFrame:
        """Tiles with some columns of both their blocks."""
        first, second = blocks.select("block", "width", *columns), blocks.select(F.col("block").alias("block2"), *[F.col(c).alias(c + "2") for c in columns])
        return of.join(first.hint("merge"), "block").join(second.hint("merge"), "block2")

    opened = materialise(sides(pairs, ["codes", "scales", "errors"]).mapInArrow(_opened(threshold), "block long, block2 long, i binary, j binary"), "open-tiles")
    found = sides(opened, ["reps", "weights", "vectors"]).mapInArrow(_tiles(threshold), "rep long, links long, other long")
    found = materialise(found, "tile-links")

    links = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.select("h1", "h2", "rep", "weight").join(links.hint("merge"), "rep", "left").join(label.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    known = materialise(known.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-links")
    one = rows.where("sound").select("vec_id", "h1", "h2").join(known.hint("merge"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return one.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
