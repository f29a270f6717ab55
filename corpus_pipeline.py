"""From raw documents to packed training sequences: five stages, each on all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Each decides by its operator with production
parameters; what the operators do with nulls, empty or very long texts, ties, repeated rows, empty tables and extra
columns is in their own descriptions. Here, rows with a null doc_id or text pass a stage that does not reject them,
and extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import minhash, mixing, packing, quality, substring
from kinweave.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one that names it. Equal rows of one doc_id become one; its unequal texts all stay."""
    found = minhash.near_duplicates(docs)
    doubtful = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("d")).agg(F.bool_or(~F.col("kept")).alias("dropped"), (F.count(F.lit(1)) > 1).alias("repeated"))
    doubtful = materialise(doubtful.where("dropped OR repeated"), "doubtful")
    once = docs.select(COLUMNS).join(doubtful, F.col("doc_id") == F.col("d"), "left_anti")
    twice = docs.select(COLUMNS).join(doubtful.where("repeated AND NOT dropped"), F.col("doc_id") == F.col("d"), "left_semi")
    return once.union(twice.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row")).select("doc_id", "text", "row.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; those of which nothing is left go."""
    _, cut = substring.remove_repeats(docs.select(COLUMNS))
    cut = materialise(cut.drop("n_removed"), "cut-texts")
    keyed = docs.select(*substring.row_key(), *COLUMNS).join(cut, ["k1", "k2"], "left")
    text = F.coalesce("kept_text", "text")
    changed = keyed.where(F.col("kept_text").isNull() | (F.col("kept_text") != ""))
    return changed.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs.select(COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality classifier", classified), ("MinHash near-dedup", deduplicated), ("substring dedup", without_repeats), ("mixing", mixed), ("packing", packed)]

#: A classifier that is fitted here and token ids are not for SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
