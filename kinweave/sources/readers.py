"""Readers: FASTA, BED, SAM text, block lists, graphs, index files, logs. All are plain Spark scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunks import CHUNK, assembled


def _stem(extension: str) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), f"{extension}$", "")


def fasta(spark: SparkSession, path: str, extension: str = r"\.(fa|fasta)(\.gz)?") -> DataFrame:
    """(genome, contig, seq, length): genome is the file's name, contig the header's first word; records may span lines."""
    records = spark.read.option("lineSep", "\n>").text(path).select(_stem(extension).alias("genome"), F.regexp_replace("value", "^>", "").alias("r"))
    header = F.substring_index("r", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("r"), F.length(header) + 1, F.length("r")), r"\s+", "")
    out = records.where(F.length(F.trim("r")) > 0).select("genome", F.regexp_extract(header, r"^\s*(\S*)", 1).alias("contig"), body.alias("seq"))
    return out.withColumn("length", F.length("seq").cast("long"))


def _parts(size: int | None):
    """Parts of records (genome, file, block, record, contig, at, text) in the lines of splits; without a size, their lengths.

    Lines lie side by side in an Arrow batch, so the letters between two headers are one stretch of its buffer. A record
    is numbered within its split; number 0, without a name, goes on from the split before.
    """

    def run(batches):
        split, record, contig, at = None, 0, None, 0
        for batch in batches:
            lines = batch.column("value").cast(pa.large_binary())
            n = len(lines)
            if not n:
                continue
            offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
            data = lines.buffers()[2]
            data = memoryview(data) if data is not None else memoryview(b"")
            raw = np.frombuffer(data, np.uint8)
            full = np.flatnonzero(np.diff(offsets) > 0)
            heads = set(full[raw[offsets[full]] == ord(">")].tolist())
            blocks = np.asarray(batch.column("block"))
            files = batch.column("file").dictionary_encode()
            names, genomes = files.dictionary.to_pylist(), batch.column("genome")
            codes = np.asarray(files.indices)
            turns = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
            begins = sorted({0, *turns.tolist(), *heads})
            rows = []
            for a, b in zip(begins, [*begins[1:], n]):
                of = (names[codes[a]], int(blocks[a]))
                if of != split:
                    split, record, contig, at = of, 0, None, 0
                body = a
                if a in heads:
                    body, record, at = a + 1, record + 1, 0
                    words = bytes(data[offsets[a] + 1 : offsets[a + 1]]).split(None, 1)
                    contig = words[0].decode("utf-8", "replace") if words else ""
                letters = bytes(data[offsets[body] : offsets[b]]).translate(None, b" \t\n\r\v\f")
                key = (genomes[a].as_py(), *of, record, contig)
                if size is None:
                    rows.append((*key, at, len(letters)))
                else:
                    rows.extend((*key, at + i, letters[i : i + size].decode("ascii", "replace")) for i in range(0, max(1, len(letters)), size))
                at += len(letters)
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64() if size is None else pa.string()]
            fields = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(fields, ["genome", "file", "block", "record", "contig", "at", "text"])

    return run


def fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK, extension: str = r"\.(fa|fasta)(\.gz)?") -> DataFrame:
    """Chunks (genome, contig, chunk, seq) of FASTA files, read by split: a record goes on over as many splits as it needs.

    A first pass finds, a row a split, the last header and the letters behind it; summed in file order they tell each split
    in what record, and how far in it, it begins. The second pass reads the letters. A line is one row, so a record on one
    line is read by one task. Letters are ASCII, any other byte counts as one unknown letter; text before a file's first
    header is no record. Contig names are unique in a genome.
    """
    lines = spark.read.text(path).select(_stem(extension).alias("genome"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    schema = "genome string, file string, block long, record long, contig string, at long, text "
    sizes = lines.mapInArrow(_parts(None), schema + "long")
    records = sizes.groupBy("file", "block", "record").agg(F.max("contig").alias("contig"), F.sum("text").alias("n"))
    last = F.max_by(F.struct("contig", "n"), "record")
    splits = records.groupBy("file", "block").agg(F.max("record").alias("records"), last.alias("last"))
    order = Window.partitionBy("file").orderBy("block")  # a row a split
    splits = splits.withColumn("name", F.last(F.when(F.col("records") > 0, F.col("last.contig")), True).over(order)).withColumn("of", F.sum(F.when(F.col("records") > 0, 1).otherwise(0)).over(order))
    splits = splits.withColumn("behind", F.sum("last.n").over(Window.partitionBy("file", "of").orderBy("block")))
    begins = splits.select("file", "block", F.lag("name").over(order).alias("carried"), F.lag("behind").over(order).alias("before"), F.lit(0).cast("long").alias("record"))
    parts = lines.mapInArrow(_parts(size), schema + "string").join(begins, ["file", "block", "record"], "left")
    whole = parts.select("genome", F.coalesce("contig", "carried").alias("contig"), (F.col("at") + F.coalesce("before", F.lit(0))).alias("start"), "text")
    return assembled(whole.where("contig IS NOT NULL"), size)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (file, block, i, ...), i rising within a split, with line, from 0 in each file, in place of these three.

    A split's rows have ids without gaps, so a row's number in it is its id less the least; the lines of the splits before
    are added. A row a split is joined back, no line is sorted.
    """
    splits = rows.groupBy("file", "block").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    at = rows.join(splits, ["file", "block"]).withColumn("line", F.col("before") + F.col("i") - F.col("first"))
    return at.drop("file", "block", "i", "first", "before")


def genomes(spark: SparkSession, folder: str) -> DataFrame:
    """(genome, path) of the .fa files of a folder, without results (files with a second extension before .fa)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fa").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.rlike(r"\.[^.]+\.fa$")).select(F.regexp_replace(name, r"\.fa$", "").alias("genome"), "path")


def only_file(spark: SparkSession, folder: str, genome: str, extension: str) -> str:
    """The one file of a genome with an extension; none or several raise."""
    found = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", f"{genome}*{extension}").load(folder).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} {extension} file for {genome}")
    return found[0]


def bed(spark: SparkSession, path: str, tags: tuple[str, ...] = ("name", "score")) -> DataFrame:
    """(genome, contig, start, end, tags...): tags are strings; genome is the file's name."""
    schema = ", ".join(["contig string", "start long", "end long", *[f"`{t}` string" for t in tags]])
    return spark.read.schema(schema).option("sep", "\t").csv(path).select(_stem(r"\.bed").alias("genome"), "contig", "start", "end", *tags)


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """(genome, contig, start, end, id, identity, anchor_id) of placed elements in BED files; anchor_id is the line in the
    file, from 0."""
    schema = "contig string, start long, end long, id string, identity string"
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")]
    rows = spark.read.schema(schema).option("sep", "\t").csv(path).select(*place, _stem(r"\.bed").alias("genome"), "contig", "start", "end", "id", F.col("identity").cast("double").alias("identity"))
    return _numbered(rows).withColumnRenamed("line", "anchor_id")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(assembly, line, query, flag, contig, pos, mapq, cigar, seq, score, md): pos from 0; line orders the records of a file."""
    rows = spark.read.text(path).select(_stem(r"\.sam").alias("assembly"), F.col("_metadata.file_block_start").alias("block"), "value").where(~F.col("value").startswith("@") & (F.length("value") > 0))
    f = F.split("value", "\t")
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:[A-Za-z]:([^\t]+)", 1), F.lit(""))
    fields = [f[0].alias("query"), f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), F.nullif(f[9], F.lit("*")).alias("seq")]
    line = F.struct("block", F.monotonically_increasing_id().alias("i"))  # within a file ids rise with the lines
    return rows.select("assembly", line.alias("line"), *fields, tag("AS").cast("int").alias("score"), tag("MD").alias("md"))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) from the @SQ lines of SAM headers."""
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length")).distinct()


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, path): one comma-joined chain of ids a line; the chain itself names the block."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias("block"), F.split(F.trim("value"), ",").alias("path"))


def gexf(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of a GEXF graph."""
    schema = "_source string, _target string, _weight double"
    return spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_weight").alias("weight"))


def faidx(spark: SparkSession, path: str) -> DataFrame:
    """(genome, contig, length) from FASTA index files."""
    rows = spark.read.schema("contig string, length long, offset long, bases int, width int").option("sep", "\t").csv(path)
    return rows.select(_stem(r"(\.fa)?\.fai").alias("genome"), "contig", "length")


def table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    """CSV or TSV of a known schema."""
    return spark.read.schema(schema).options(sep=sep, header=header).csv(path)


def log(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(ts, message) of log lines that match; the pattern has the two groups."""
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).cast("timestamp_ntz").alias("ts"), F.regexp_extract("value", pattern, 2).alias("message"))


def order_map(spark: SparkSession, path: str, kind: str, elements: DataFrame | None = None, seed: int = 24) -> DataFrame:
    """Edges (src, dst, weight) of an order map: a GEXF graph, or placed elements whose neighbours are edges.

    Elements are placed already (bed, sam; .bam files count as sam), or elements (id, seq) are placed in an assembly
    (fasta) without mismatch. Of several places of an element the last one counts, as in alignments.
    """
    from ..operators.alignments import last_positions
    from ..operators.locate import locate_all
    from ..operators.synteny import adjacency, consensus, unique_ids
    from .bam import bam

    if kind == "gexf":
        return gexf(spark, path)
    if kind == "bed":
        placed = anchors(spark, path).select("genome", "contig", "start", "id")
    elif kind == "sam":
        records = bam(spark, path) if path.endswith(".bam") else sam(spark, path)
        placed = last_positions(records).select(F.lit("").alias("genome"), "contig", "start", F.col("query").alias("id"))
    elif kind == "fasta":
        if elements is None:
            raise ValueError("a map from FASTA needs elements")
        places = locate_all(elements, fasta_chunks(spark, path), 0, seed)
        placed = places.groupBy("genome", "id").agg(F.max(F.struct("contig", "start")).alias("x")).select("genome", "x.contig", "x.start", "id")
    else:
        raise ValueError(f"unknown kind of map: {kind}")
    return consensus(adjacency(unique_ids(placed))).select("src", "dst", F.col("weight").cast("double").alias("weight"))
