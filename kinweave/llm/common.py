"""Helpers shared by the training-data operators: tables, scratch tables, word arrays, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white space characters.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Text that one step of a Python worker holds as word arrays; a longer document is a step of its own.
STEP_BYTES = 4 << 20

_OWN_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a local session leaves it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_SCRATCH[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def size_of(df: DataFrame) -> int:
    """Bytes of a scratch table on disk."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def parts_for(df: DataFrame, each: int = 16 << 20) -> int:
    """Shuffle partitions for what a scratch table holds: about each bytes of it (compressed) a partition, so tasks do not grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(df) // each))


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES):
    """Slices (start, end) of about limit bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of some documents, end to end, and the offsets of the documents in it."""
    offsets = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=offsets[1:])
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((i for d in docs for i in map(vocabulary.__getitem__, d)), np.int64, offsets[-1])
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    return hashed[ids] if len(ids) else np.zeros(0, np.uint64), offsets


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of every run of width consecutive values; none if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, multiplier = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        out = out * multiplier + h[k : k + n]
    return mix64(out)


class Forest:
    """Union-find over 0..n-1 inside one bounded group; joined() tells whether a union changed anything."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def joined(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), component the smallest node, for all nodes of edges (a, b).

    Rounds of hooking each node to its smallest neighbour, pointer jumping to the root, and renaming the
    edges to roots. A round at least halves the nodes left in a component, so rounds are logarithmic. All
    state is in tables; a node of very many neighbours only meets partial sums and joins that AQE splits. The tables
    grow with the input, so the joins are shuffled ones.
    """
    label = None
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while label is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")).select("node", "root"), "hooks")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = materialise(parent.join(up.hint("merge"), "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "jumped")
            moved = not jumped.where("moved").isEmpty()
            discard(parent)
            parent = jumped
            if not moved:
                break
        roots = parent.select("node", "root")
        if label is None:
            label = roots.select("node", F.col("root").alias("component"))
        else:
            at = label.join(roots.withColumnRenamed("node", "component").hint("merge"), "component", "left")
            label = materialise(at.select("node", F.coalesce("root", "component").alias("component")), "labels")
        left = edges.join(roots.toDF("a", "ra").hint("merge"), "a").join(roots.toDF("b", "rb").hint("merge"), "b").where("ra <> rb")
        renamed = materialise(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(edges)
        edges = renamed
    return label
