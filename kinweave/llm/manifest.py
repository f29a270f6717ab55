"""A Merkle manifest of a dataset, and a proof for every row by pointer jumping; DataFrame operations only.

Each lang has a tree over the digests of its rows in doc_id order, FAN children a node, and a top tree over the roots
of those. A tree grows by levels: a run of FAN nodes that are next to each other is one row with its members, so a
level is one grouping on at most FAN rows a key, an eighth of the level before. Places in a tree are those of a range
partitioning: a partition's own order, plus the rows of the partitions before.

Inner nodes start with the segment of siblings towards their parent. Repeated self-joins double the distance: a node
takes its ancestor's ancestor and appends that one's segment to its own, so all reach the root after as many rounds as
the logarithm of the height. No node has a leaf as ancestor, so leaves, seven eighths of all nodes, take no part in
the rounds: each reaches the root through its parent in the last join, which is one row a run. A round joins only
ancestors that stand high enough to be met in it; they are few when many nodes share one.

Edge cases: null values are hashed as null, and null lang is a tree of its own, before all others; a null doc_id comes
first in its tree and is never tampered with; equal doc_ids come in the order of their digests, so repeated rows stand
next to each other, with equal leaves but proofs of their own; a tree of one row is that row; an empty text differs
from a null one; a very long text is hashed as one value; an empty table gives an empty result; other columns are no
part of a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

FAN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The top tree's name, which no lang has, and what is added to its levels so that they are above all others.
TOP, ABOVE = "^", 1000
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row: each value as its length in bytes and itself, or a dash."""
    texts = [v.cast("string") for v in values.values()]
    return _hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _name(tree: Column, level: int, at: Column) -> Column:
    return F.concat(F.lit(f"{level}/"), at.cast("string"), F.lit("/"), tree)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, hash, ...) with at, their place in their tree in this order, and n, the size of the tree."""
    own = [c for c in rows.columns if c not in ("tree", "hash")]
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    spread = materialise(spread.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "placed")
    spans = spread.groupBy("part", "tree").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))  # partitions and trees are in order: at most as many rows as both
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("rows").over(by_tree).alias("n"))
    return spread.join(spans, ["part", "tree"]).select("tree", "hash", *own, (F.col("row") + F.col("shift")).alias("at"), "n")


def grown(leaves: DataFrame, *carried: str) -> list[DataFrame]:
    """Runs by level from 1: (tree, at, n, hash, members), n the nodes of the tree on that level; a tree of one node grows no more."""
    levels, nodes = [], leaves
    while not nodes.where("n > 1").isEmpty():
        member = F.struct("at", "hash", *(carried if not levels else ()))
        runs = nodes.where("n > 1").groupBy("tree", "n", F.floor(F.col("at") / FAN).cast("long").alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"))
        hashed = _hashed(F.array_join(F.transform("members", lambda m: _hex(m["hash"])), ""))
        levels.append(materialise(runs.select("tree", F.col("run").alias("at"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), hashed.alias("hash"), "members"), "runs"))
        nodes = levels[-1]
    return levels


def _siblings(members: Column, i: Column) -> Column:
    """The digests before and after member i (from 0) of a run, each side end to end."""
    joined = lambda part: F.aggregate(part, F.lit(b""), lambda a, m: F.concat(a, m["hash"]))
    return F.struct(joined(F.slice(members, 1, i)).alias("l"), joined(F.slice(members, i + 2, FAN)).alias("r"))


def _links(runs: DataFrame, level: int, above: int, name: Column | None = None) -> DataFrame:
    """(node, level, ancestor, path) of the members of a level's runs; name: theirs, where they have one of their own."""
    one = runs.select("tree", F.col("at").alias("run"), "members", F.posexplode("members").alias("i", "m"))
    named = name if name is not None else _name(F.col("tree"), level - 1, F.col("m.at"))
    return one.select(named.alias("node"), F.lit(level - 1 + above).alias("level"), _name(F.col("tree"), level, F.col("run")).alias("ancestor"), F.array(_siblings(F.col("members"), F.col("i"))).alias("path"))


def jumped(links: DataFrame, root: str) -> DataFrame:
    """(node, level, ancestor, path) with the root as ancestor of all, and the segments on the way."""
    pointers, distance = materialise(links, "pointers"), 1
    while True:
        open_ = pointers.where(F.col("ancestor") != root)
        if open_.isEmpty():
            return pointers
        up = pointers.where(F.col("level") > distance).select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("path").alias("further"))
        nearer = open_.join(up, "ancestor").select("node", "level", F.col("above").alias("ancestor"), F.concat("path", "further").alias("path"))
        doubled = materialise(nearer.unionByName(pointers.where(F.col("ancestor") == root)), "pointers")
        discard(pointers)
        pointers, distance = doubled, 2 * distance


def proofs(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of each row of docs, and what a tampered row's proof folds to."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    values = {c: F.col(c) for c in FIELDS}
    lowered = leaf(values | {"text": F.translate("text", CAPITALS, SMALL)})
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaves = docs.select(FIELDS).select("doc_id", tree.alias("tree"), leaf(values).alias("hash"), F.when(tampered, lowered).alias("tampered"))
    leaves = placed(materialise(leaves, "leaves"), "doc_id", "hash")
    levels = grown(leaves, "doc_id", "tampered")
    lone = leaves.where("n = 1")

    roots = [lone.select("tree", "hash", _name(F.col("tree"), 0, F.lit(0)).alias("name"))]
    roots += [runs.where("n = 1").select("tree", "hash", _name(F.col("tree"), k, F.lit(0)).alias("name")) for k, runs in enumerate(levels, 1)]
    roots = materialise(reduce(DataFrame.unionByName, roots), "roots")
    tops = placed(roots.select(F.lit(TOP).alias("tree"), "hash", F.col("tree").alias("of"), "name"), "of")
    top_levels = grown(tops, "name")
    top = top_levels[-1].select(_name(F.col("tree"), len(top_levels), F.lit(0)).alias("name"), _hex(F.col("hash")).alias("root")) if top_levels else roots.select("name", _hex(F.col("hash")).alias("root"))
    found = top.head()  # the one root
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)

    links = [_links(runs, k, 0) for k, runs in enumerate(levels, 1) if k > 1]
    links += [_links(runs, k, ABOVE, F.col("m.name") if k == 1 else None) for k, runs in enumerate(top_levels, 1)]
    empty = docs.sparkSession.createDataFrame([], "node string, level int, ancestor string, path array<struct<l:binary,r:binary>>")
    pointers = jumped(reduce(DataFrame.unionByName, links, empty), found["name"]).select("node", "path")

    no_path = F.array().cast("array<struct<l:binary,r:binary>>")
    alone = lone.select("tree", _name(F.col("tree"), 0, F.lit(0)).alias("node"), F.array(F.struct("at", "hash", "doc_id", "tampered")).alias("members"), F.lit(True).alias("alone"))
    runs = alone if not levels else levels[0].select("tree", _name(F.col("tree"), 1, F.col("at")).alias("node"), "members", F.lit(False).alias("alone")).unionByName(alone)
    runs = runs.join(pointers, "node", "left").join(roots.select("tree", _hex(F.col("hash")).alias("subroot")), "tree")
    one = runs.select("subroot", "path", "members", "alone", F.posexplode("members").alias("i", "m"))
    own = F.when(F.col("alone"), no_path).otherwise(F.array(_siblings(F.col("members"), F.col("i"))))
    one = one.select("m.doc_id", "m.hash", F.coalesce("m.tampered", "m.hash").alias("shown"), "subroot", F.concat(own, F.coalesce("path", no_path)).alias("path"))
    folded = F.aggregate("path", _hex(F.col("shown")), lambda a, p: F.sha2(F.concat(_hex(p["l"]), a, _hex(p["r"])).cast("binary"), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(_hex(p["l"]), _hex(p["r"]))), "").cast("binary"), 256)
    out = one.select("doc_id", _hex(F.col("hash")).alias("leaf"), "subroot", F.lit(found["root"]).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, by: str, levels: int) -> str:
    """Common table expressions of the levels of trees: name0 has (by, i, n, h); nodes of a tree of one pass on."""
    out = []
    for k in range(levels):
        run = f"PARTITION BY {by}, i // {FAN} ORDER BY i ROWS BETWEEN"
        out.append(f"{name}_side{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT {by}, i // {FAN} AS i, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY {by}, i // {FAN}, n)")
    return ",\n".join(out)


def _folds_sql(source: str, name: str, on: str, at: str, levels: int) -> str:
    """Common table expressions that fold source's column folded, and collect its siblings in proof, level by level."""
    out = []
    for k in range(levels):
        before = source if k == 0 else f"{name}_fold{k - 1}"
        out.append(
            f"{name}_fold{k} AS (SELECT b.* EXCLUDE (folded, proof), CASE WHEN s.n = 1 THEN folded ELSE sha256(s.l || folded || s.r) END AS folded, CASE WHEN s.n = 1 THEN proof ELSE proof || s.l || s.r END AS proof "
            f"FROM {before} b JOIN {name}_side{k} s ON {on} AND s.i = b.{at} // {FAN**k})"
        )
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"


#: Levels that the SQL has for a tree: up to 8 ** 7 rows a lang, and 8 ** 3 langs.
_ROWS, _LANGS = 7, 3
SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
leaves AS (
  SELECT *, {_leaf_sql("text")} AS leaf, {_leaf_sql(f"translate(text, '{CAPITALS}', '{SMALL}')")} AS lowered,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM documents, crc),
ordered AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS folded, '' AS proof,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
tree0 AS (SELECT lang, place AS i, n, leaf AS h FROM ordered),
{_tree_sql("tree", "lang", _ROWS)},
top0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, lang FROM tree{_ROWS}),
{_tree_sql("top", "one", _LANGS).replace("FROM top0 GROUP", "FROM (SELECT one, i, n, h FROM top0) GROUP")},
{_folds_sql("ordered", "tree", "b.lang IS NOT DISTINCT FROM s.lang", "place", _ROWS)},
ranked AS (SELECT b.doc_id, b.leaf, b.folded, b.proof, t.h AS subroot, t.i AS rank FROM tree_fold{_ROWS - 1} b JOIN top0 t ON b.lang IS NOT DISTINCT FROM t.lang),
{_folds_sql("ranked", "top", "true", "rank", _LANGS)}
SELECT f.doc_id, f.leaf, f.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = t.h AS verified
FROM top_fold{_LANGS - 1} f, top{_LANGS} t
"""
