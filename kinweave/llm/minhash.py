"""MinHash near-duplicates by a multi-index Hamming join, confirmed on whole shingle sets.

A signature has CHUNKS x WIDTH min-hashes of 16 bits. By pigeonhole, signatures that differ in at most DISTANCE =
2 * CHUNKS - 1 components have a chunk with at most one error; every chunk therefore gives WIDTH keys, each leaving
one component out, and all pairs within that distance meet in a key. A pair of similarity 0.8 is further apart, and
then lost, with a chance of 2.1e-7 (the tail of a binomial distribution; less above 0.8). Documents of equal sets are
one class before any key is made. Classes that meet in a key are compared by their signatures, in tiles of at most
MOST_COMPARED a side where a key has more of them, so one rule holds for keys of every size; those within the distance
are joined, by a spanning forest of each tile. The classes that are so connected form candidate groups, and tiles of a
group compare all its pairs exactly on the whole sets, so no candidate is capped. A tile returns a spanning forest,
not pairs.

Edge cases: null or empty text, or no words: n_shingles 0, linked with nothing. Fewer words than the shingle:
the whole sequence is the one shingle. A null doc_id can name no component: such a row stays alone
(component_id null, kept true). Repeated rows link with each other; ties go to the smallest doc_id. A very long text
is a step of its own and one row of a tile. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, materialise, mix64, parts_for, rolled, steps, table, texts_of, word_hashes

CHUNKS, WIDTH = 15, 4
DISTANCE = 2 * CHUNKS - 1
#: A tile of a key holds about so many classes a side.
MOST_COMPARED = 4096
#: A tile of a candidate group holds about so many classes and shingles a side.
TILE_DOCS, TILE_SHINGLES = 512, 1_000_000

_seeds = mix64(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
#: For each key its components: a chunk without one of its members.
_KEYS = np.array([[c * WIDTH + k for k in range(WIDTH) if k != out] for c in range(CHUNKS) for out in range(WIDTH)])
_SCHEMA = "doc_id long, n_shingles long, fp1 long, fp2 long, signature binary, keys array<long>"


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The set of each document as sorted 64-bit shingle hashes."""
    out: list[np.ndarray] = []
    for a, b in steps(texts):
        docs = [t.lower().split() for t in texts[a:b]]
        h, at = word_hashes(docs)
        s = rolled(h, words)
        for i, d in enumerate(docs):
            if len(d) >= words:
                x = np.sort(s[at[i] : at[i + 1] - words + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            else:
                out.append(np.array([xxhash.xxh64_intdigest(b" ".join(d), seed=len(d))] if d else [], np.uint64))
    return out


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix64(s + np.uint64(0x14057B7EF767814F)).sum()
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_seeds), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048, None] ^ _seeds
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, x.min(axis=0), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint64)


def _keys(signatures: np.ndarray) -> np.ndarray:
    x = np.arange(len(_KEYS), dtype=np.uint64) + np.zeros((len(signatures), 1), np.uint64)
    for k in range(WIDTH - 1):
        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + signatures[:, _KEYS[:, k]])
    return x.astype(np.int64)


def _signed(words: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), texts_of(batch)
            for a, b in steps(texts):
                sets = shingle_sets(texts[a:b], words)
                prints = [_fingerprint(s) if len(s) else (None, None) for s in sets]
                signatures = np.stack([_signature(s) for s in sets])
                keys = pa.array([k if len(s) else None for k, s in zip(_keys(signatures), sets)], pa.list_(pa.int64()))
                packed = pa.array([x.astype("<u2").tobytes() if len(s) else None for x, s in zip(signatures, sets)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), packed, keys],
                    ["doc_id", "n_shingles", "fp1", "fp2", "signature", "keys"],
                )

    return run


def near_forest(signatures: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of signatures that differ in at most distance components."""
    out, open_ = [], np.arange(len(signatures))
    while len(open_) > 1:
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            x = front.pop()
            near = (signatures[open_] != signatures[x]).sum(axis=1) <= distance
            out += [(int(x), int(y)) for y in open_[near]]
            front += open_[near].tolist()
            open_ = open_[~near]
    return out


def _met(batches):
    """Pairs (a, b) of a spanning forest of the classes within DISTANCE of each key or tile of one; rows come sorted by key."""

    def pairs(keys, cids, signatures):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[(signatures[two] != signatures[two + 1]).sum(axis=1) <= DISTANCE]
        found = [np.stack([cids[two], cids[two + 1]], axis=1)]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            tree = near_forest(signatures[s : s + n], DISTANCE)
            if tree:
                found.append(cids[s + np.array(tree)])
        found = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    held: list = []
    for batch in batches:
        keys, cids = (batch.column(c).to_numpy() for c in ("key", "cid"))
        signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(len(keys), -1)
        if held:
            keys, cids, signatures = (np.concatenate(x) for x in zip(held, (keys, cids, signatures)))
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
        if last:
            yield pairs(keys[:last], cids[:last], signatures[:last])
        held = [keys[last:], cids[last:], signatures[last:]]
    if held and len(held[0]):
        yield pairs(*held)


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int):
    """Union-find over the sets of a tile; yields the unions, of all pairs with 100 I >= percent U. side: 0, 1, or all 0."""
    n, cross = len(sets), side.any()
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    rising = sizes[order]
    all_ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(inverse, np.cumsum(sizes)[:-1])
    flat = np.concatenate([parts[i] for i in order])
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    forest, seen = Forest(n), np.zeros(len(all_ids), np.int32)
    for k in range(n - 1):
        i = order[k]
        last = np.searchsorted(rising, sizes[i] * 100 // percent, side="right")
        if last <= k + 1:
            continue
        seen[parts[i]] = 1
        inter = np.add.reduceat(seen[flat[starts[k + 1] : ends[last - 1]]], starts[k + 1 : last] - starts[k + 1])
        seen[parts[i]] = 0
        union = sizes[i] + sizes[order[k + 1 : last]] - inter
        for j in order[k + 1 : last][100 * inter >= percent * union]:
            if not (cross and side[i] == side[j]) and forest.joined(int(i), int(j)):
                yield int(i), int(j)


def _tile(words: int, percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets([t.encode() for t in pdf["text"]], words)
        pdf["own"] = [len(s) > 0 and _fingerprint(s)[0] == f for s, f in zip(sets, pdf["fp1"])]  # not another text of this doc_id
        pdf = pdf[pdf["own"]].drop_duplicates(["cid", "fp1"])
        sets = [sets[i] for i in pdf.index]
        if len(pdf) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids = pdf["cid"].to_numpy()
        side = (pdf["block"].to_numpy() != pdf["bi"].to_numpy()).astype(int)
        found = [(ids[i], ids[j]) for i, j in linked_pairs(sets, side, percent)]
        return pd.DataFrame({"a": [min(x) for x in found], "b": [max(x) for x in found]}, dtype="int64")

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: components of links with 100 I >= percent U on shingle sets."""
    rows = materialise(docs.select("doc_id", "text").mapInArrow(_signed(words), _SCHEMA), "signed")
    named = rows.where("doc_id IS NOT NULL AND fp1 IS NOT NULL")
    classes = materialise(named.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("cid"), F.any_value("signature").alias("signature"), F.any_value("keys").alias("keys")), "classes")

    keyed = classes.select("cid", "fp1", F.explode("keys").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    met = materialise(keyed.join(shared.hint("merge"), "key").select("key", "cid", "fp1", F.ceil(F.col("n") / MOST_COMPARED).cast("int").alias("blocks")), "met")
    one = met.where("blocks = 1").select("key", "cid", "fp1")
    own = F.expr("cast(pmod(xxhash64(cid), blocks) AS int)")
    split = met.where("blocks > 1").select("*", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    split = split.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "cid", "fp1")  # tiles that chance gives one hash are compared too
    signed = one.union(split).join(classes.select("fp1", "signature").hint("merge"), "fp1").repartition(parts_for(met, 4 << 20), "key").sortWithinPartitions("key")
    groups = components(signed.select("key", "cid", "signature").mapInArrow(_met, "a long, b long"))

    members = materialise(groups.join(classes.select(F.col("cid").alias("node"), "n_shingles", "fp1").hint("merge"), "node"), "members")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_DOCS), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("blocks"))
    sizes = materialise(sizes, "group-sizes")
    placed = members.join(sizes.hint("merge"), "component").select(F.col("node").alias("cid"), "fp1", "component", "blocks", F.expr("cast(pmod(xxhash64(node), blocks) AS int)").alias("block"))
    with_text = docs.select(F.col("doc_id").alias("cid"), "text").where("cid IS NOT NULL AND text IS NOT NULL").join(placed.hint("merge"), "cid")
    tiles = with_text.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("cid", "fp1", "text", "component", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    links = tiles.groupBy("component", "bi", "bj").applyInPandas(_tile(words, percent), "a long, b long")

    label = components(links).select(F.col("node").alias("cid"), "component")
    classed = materialise(classes.select("fp1", "fp2", "cid").join(label.hint("merge"), "cid", "left").select("fp1", "fp2", F.coalesce("component", "cid").alias("component_id")), "classed")
    linked = named.select("doc_id", "n_shingles", "fp1", "fp2").join(classed.hint("merge"), ["fp1", "fp2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("doc_id IS NULL OR fp1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
