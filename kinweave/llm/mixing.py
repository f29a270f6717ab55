"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only.

Every document has a hash of its doc_id, cut into levels of bits. Sizes are summed by source and first-level
bucket; the bucket in which a source's budget is used up is the only one that is summed again by the next level.
The thresholds then filter documents without a sort. Documents of one hash stand or fall together, so reruns agree.

A source's target is its share of all words by weight (1, 2, 3 repeating over the sources by code point, null
last), at most limit times its size, the excess reshared by weight until none is above. Each document is taken
whole floor(target / size of the source) times, and once more while its hash is below the source's threshold.

Edge cases: null or empty text has size 0; null source is a source of its own; null doc_id hashes as one value;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, materialise, table

#: Bits of the two histogram levels, from the top of a 60-bit hash.
BITS = 12


def word_list(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null and empty texts have none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_SPLIT)).otherwise(F.array().cast("array<string>"))


def source_targets(sized: DataFrame, limit: int) -> DataFrame:
    """(source, source_size, target): water filling in closed form over the sources by cap per weight."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sums.select("source", "source_size", ((F.row_number().over(by_name) - 1) % 3 + 1).alias("weight"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighted.withColumn("cap", limit * F.col("source_size")).select(
        "*", ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)).alias("level")
    )
    capped = level.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    share = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything) * F.col("weight")
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _cut(histogram: DataFrame, rest: Column, bucket: str) -> DataFrame:
    """Adds words before each bucket of a source; rest is what the source may still take."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return histogram.select("*", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("before"), rest.alias("rest"))


def _buckets() -> list[Column]:
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    return [F.shiftright(h, 60 - BITS).alias("b1"), F.shiftright(h, 60 - 2 * BITS).bitwiseAND((1 << BITS) - 1).alias("b2")]


def thresholds(sized: DataFrame, limit: int) -> DataFrame:
    """(source, source_size, target, whole, left_over, edge1, edge2): what decides on each document of a source."""
    targets = source_targets(sized, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = materialise(targets.select("source", "source_size", "target", whole.cast("long").alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("left_over")), "targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    coarse = sized.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    coarse = coarse.join(targets, same(coarse, targets)).select(coarse["source"], "b1", "words", "left_over")
    coarse = _cut(coarse, F.col("left_over"), "b1").where("before <= rest AND rest < before + words")
    edge = materialise(coarse.select("source", F.col("b1").alias("edge1"), "before", "rest"), "edges")

    fine = sized.join(edge, same(sized, edge) & (sized["b1"] == edge["edge1"])).groupBy(edge["source"], "edge1", "b2").agg(F.sum("size").alias("words"), F.first(F.col("rest") - F.col("before")).alias("short"))
    fine = _cut(fine, F.col("short"), "b2").where("2 * before + words <= 2 * rest")
    fine = fine.groupBy("source", "edge1").agg(F.max("b2").alias("edge2"))

    cuts = targets.join(edge.select(F.col("source").alias("s1"), "edge1"), F.col("source").eqNullSafe(F.col("s1")), "left")
    cuts = cuts.join(fine.select(F.col("source").alias("s2"), "edge2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return materialise(cuts.select("source", "source_size", "target", "whole", "left_over", "edge1", F.coalesce("edge2", F.lit(-1)).alias("edge2")), "cuts")


def with_copies(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(own, source_size, target, copies): the row of docs, and how often the mix takes it."""
    # without an edge the source takes all once more, or nothing is left over to take
    below = F.when(F.col("edge1").isNull(), F.col("left_over") > 0).otherwise((F.col("b1") < F.col("edge1")) | ((F.col("b1") == F.col("edge1")) & (F.col("b2") <= F.col("edge2"))))
    at = cuts.withColumnRenamed("source", "of_source")
    found = docs.select(F.struct(*docs.columns).alias("own"), F.col("source").alias("own_source"), *_buckets()).join(at, F.col("own_source").eqNullSafe(F.col("of_source")))
    return found.select("own", "source_size", "target", (F.col("whole") + below.cast("long")).alias("copies"))


def _sized(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", "source", F.size(word_list(F.col("text"))).cast("long").alias("size"), *_buckets()), "sized")


def mix(docs: DataFrame, limit: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row; each source's taken words come near its target."""
    sized = _sized(docs)
    found = with_copies(sized.drop("b1", "b2"), thresholds(sized, limit)).select("own.*", "source_size", "target", "copies")
    return found.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, limit: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    taken = with_copies(docs, thresholds(_sized(docs), limit)).where("copies > 0")
    return taken.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 6) AS BIGINT) AS b
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sums),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
capped AS (SELECT *, cap <= level * weight AS is_capped FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE (SELECT max(level) FROM capped WHERE NOT is_capped) * weight END AS target
  FROM capped),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
histogram AS (SELECT source, b, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, b),
cut AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM histogram)
SELECT s.doc_id, s.size, t.source_size, t.target,
       s.size * (t.whole + CASE WHEN 2 * c.before + c.words <= 2 * (t.target - t.whole * t.source_size) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN budget t ON s.source IS NOT DISTINCT FROM t.source
JOIN cut c ON s.source IS NOT DISTINCT FROM c.source AND s.b = c.b
"""
