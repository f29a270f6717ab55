"""Registered queries: each operator bound to the given tables, with the SQL that must give the same rows.

Bindings. Sequences: the A, C, G, T of every document's text, genome its source, contig its doc_id. Alignments: one
record a line item. Anchors: elements are part brands, genomes order priorities, contigs return flags, positions
first ship days; or events of a type, genomes users. Nothing is limited to some ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequences as S
from .operators import alignments, align, assess, chunks, compare, gapped, graph, kmers, locate, regions, stats, synteny
from .operators.lineage import cut
from .params import Params
from .plans import find, order

K, SUPPORT = 16, 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# ---- sequences -------------------------------------------------------------------------------------------------

SEQ = """
WITH s AS (SELECT source AS genome, CAST(doc_id AS VARCHAR) AS contig, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]+', '', 'g')) AS seq FROM documents)
"""
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
HITS = (
    SEQ
    + f""", c AS (SELECT genome, contig, seq, unnest(range(length(seq) - {K - 1})) AS pos FROM s WHERE length(seq) >= {K}),
f AS (SELECT genome, contig, pos, least(substring(seq, pos + 1, {K}), {RC.format(f"substring(seq, pos + 1, {K})")}) AS kmer FROM c),
core AS (SELECT kmer, count(DISTINCT genome) AS support FROM f GROUP BY kmer HAVING count(DISTINCT genome) >= {SUPPORT}),
hits AS (SELECT f.* FROM f JOIN core USING (kmer))
"""
)


def sequences(spark: SparkSession, d: str) -> DataFrame:
    # texts of few row groups are few tasks; spreading them costs a small part of what their k-mers cost, and less for letters only
    docs = _table(spark, d, "documents").select("source", "doc_id", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs, early = (docs, True) if 4 * docs.rdd.getNumPartitions() >= tasks else (docs.repartition(tasks), False)
    rows = docs.select(F.col("source").alias("genome"), F.col("doc_id").cast("string").alias("contig"), S.dna(F.coalesce("text", F.lit(""))).alias("seq"))
    return rows.repartition(tasks) if early else rows


def found_kmers(spark: SparkSession, d: str) -> DataFrame:
    """K-mers as numbers; queries that return them give their letters."""
    return kmers.numbered_kmers(sequences(spark, d), K)


def genomes(spark: SparkSession, d: str) -> list[str]:
    return [r["source"] for r in _table(spark, d, "documents").select("source").distinct().collect()]


def lettered(df: DataFrame) -> DataFrame:
    return df.withColumn("kmer", kmers.letters("kmer", K))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the places of core k-mers."""
    return kmers.core_runs(sequences(spark, d), K, SUPPORT, genomes(spark, d))


@query(HITS + "SELECT kmer, support FROM core")
def a3_core_kmers(spark, d):
    return lettered(kmers.core_kmers(found_kmers(spark, d), SUPPORT, genomes(spark, d)))


@query(HITS + "SELECT genome, kmer, count(*) AS n FROM f GROUP BY ALL")
def a1_kmer_counts(spark, d):
    return lettered(kmers.genome_counts(sequences(spark, d), K, genomes(spark, d)))


@query(HITS + "SELECT genome, count(*) AS windows, count(DISTINCT kmer) AS distinct_windows FROM f GROUP BY genome")
def c6_windows(spark, d):
    return found_kmers(spark, d).groupBy("genome").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("kmer").alias("distinct_windows"))


@query(HITS + "SELECT kmer, 'c' || row_number() OVER (ORDER BY kmer) AS id FROM core")
def c16_named_kmers(spark, d):
    return lettered(kmers.named(kmers.core_kmers(found_kmers(spark, d), SUPPORT)))


@query(HITS + "SELECT a.genome, b.genome AS other, count(*) AS shared FROM hits a JOIN hits b ON a.kmer = b.kmer AND a.genome <> b.genome GROUP BY ALL")
def j1_places_elsewhere(spark, d):
    # places are counted by k-mer and genome first, so what meets is a row a genome; the rows of a k-mer are in one partition
    n = kmers.genome_counts(sequences(spark, d), K, genomes(spark, d))
    held = n.groupBy("kmer").agg(F.collect_list(F.struct("genome", "n")).alias("a")).where(F.size("a") >= SUPPORT)
    pairs = held.select("a", F.explode("a").alias("x")).select("x", F.explode("a").alias("y")).where("x.genome <> y.genome")
    return pairs.groupBy("x.genome", F.col("y.genome").alias("other")).agg(F.sum(F.col("x.n") * F.col("y.n")).alias("shared"))


ISLANDS = (
    HITS
    + f""", marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY genome, contig ORDER BY pos) > {K + 4} THEN 1 ELSE 0 END AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY genome, contig ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM marked),
regions AS (SELECT genome, contig, CAST(island AS BIGINT) AS island, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM numbered GROUP BY ALL HAVING max(pos) - min(pos) + {K + 4} >= 24)
"""
)


@query(ISLANDS + "SELECT * FROM regions")
def w1_regions(spark, d):
    return regions.candidate_regions(runs(spark, d), K, 4, 24)


@query(ISLANDS + "SELECT genome, contig || '_' || lpad(CAST(row_number() OVER w - 1 AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY genome, contig) AS VARCHAR)) AS INTEGER), '0') AS id, first_pos, last_pos FROM regions WINDOW w AS (PARTITION BY genome, contig ORDER BY first_pos)")
def c15_region_ids(spark, d):
    return regions.region_ids(w1_regions(spark, d)).select("genome", "id", "first_pos", "last_pos")


@query(
    HITS
    + f""", marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY genome, contig ORDER BY pos) > {K} THEN 1 ELSE 0 END AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY genome, contig ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM marked),
runs AS (SELECT genome, contig, min(pos) AS a, max(pos) + {K} AS z FROM numbered GROUP BY genome, contig, island HAVING max(pos) - min(pos) + {K} >= 20),
w AS (SELECT genome, contig, a, z, unnest(range(a, z - 19)) AS start FROM runs)
SELECT genome, contig, start, substring(seq, start + 1, 20) AS "window" FROM w JOIN s USING (genome, contig)"""
)
def w2_run_windows(spark, d):
    return regions.run_windows(runs(spark, d), sequences(spark, d), K, 0, 20)


@query(SEQ + f"SELECT genome, contig, md5({RC.format('seq')}) AS rc, md5(least(seq, {RC.format('seq')})) AS canonical FROM s")
def c1_c2_canonical(spark, d):
    seq = F.col("seq")
    return sequences(spark, d).select("genome", "contig", F.md5(S.reverse_complement(seq)).alias("rc"), F.md5(S.canonical(seq)).alias("canonical"))


@query(
    SEQ
    + f""", n AS (SELECT genome, contig, seq, lead(seq) OVER (PARTITION BY genome ORDER BY CAST(contig AS BIGINT)) AS nxt FROM s),
m AS (SELECT genome, contig, left(seq, least(length(seq), length(nxt))) AS a, left(nxt, least(length(seq), length(nxt))) AS b FROM n WHERE nxt IS NOT NULL AND least(length(seq), length(nxt)) > 0)
SELECT genome, contig, CAST(length(a) - hamming(a, b) AS BIGINT) AS equal, CAST(hamming(a, b) AS BIGINT) AS differing,
  round(greatest(length(a) - hamming(a, b), length(a) - hamming(a, {RC.format('b')})) / length(a), 6) AS homology FROM m"""
)
def c3_c5_homology(spark, d):
    s = sequences(spark, d)
    at = kmers.ranked(s.select("genome", "contig", F.struct("genome", F.col("contig").cast("long").alias("c")).alias("key")), "key")
    near = at.select("genome", F.col("contig").alias("behind"), (F.col("rank") + 1).alias("rank")).join(at.select("genome", "contig", "rank"), ["genome", "rank"])
    n = near.join(s.select("genome", F.col("contig").alias("behind"), "seq"), ["genome", "behind"]).join(s.select("genome", "contig", F.col("seq").alias("nxt")), ["genome", "contig"])
    n = n.select("genome", F.col("behind").alias("contig"), "seq", "nxt", F.least(F.length("seq"), F.length("nxt")).alias("m")).where("m > 0")
    n = n.select("genome", "contig", F.substring(F.col("seq"), F.lit(1), F.col("m")).alias("a"), F.substring(F.col("nxt"), F.lit(1), F.col("m")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rounded(n.select("genome", "contig", S.matches(a, b).alias("equal"), S.mismatches(a, b).alias("differing"), S.homology(a, b).alias("homology")))


@query(SEQ + "SELECT genome, contig, md5(substring(seq, length(seq) // 4 + 1, length(seq) // 2 - length(seq) // 4 + 10)) AS slice FROM s")
def s6_slices(spark, d):
    rows = sequences(spark, d)
    n = F.length("seq")
    spans = rows.select(F.lit(0).alias("id"), "genome", "contig", F.floor(n / 4).alias("start"), (F.floor(n / 2) + 10).alias("end"))
    return chunks.subsequences(spans, rows).select("genome", "contig", F.md5("seq").alias("slice"))


@query(SEQ + "SELECT genome, CAST(sum(length(seq)) AS BIGINT) AS size FROM s GROUP BY genome")
def c22_genome_sizes(spark, d):
    return sequences(spark, d).groupBy("genome").agg(F.sum(F.length("seq")).alias("size"))


@query(SEQ + "SELECT contig AS id, genome, greatest(0, length(seq) // 3 - 50) AS start, least(length(seq), length(seq) // 2 + 50) AS \"end\" FROM s")
def c14_flanks(spark, d):
    n = F.length("seq").cast("long")
    rows = sequences(spark, d).select("genome", "contig", n.alias("length"))
    spans = rows.select("genome", "contig", F.col("contig").alias("id"), F.floor(F.col("length") / 3).alias("start"), F.floor(F.col("length") / 2).alias("end"))
    out = locate.with_flanks(spans, 50, rows)
    return out.select("id", "genome", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(SEQ + "SELECT contig AS id, genome, contig, length(seq) // 3 AS start, length(seq) // 2 AS \"end\", substring(seq, length(seq) // 3 + 1, length(seq) // 2 - length(seq) // 3) AS seq FROM s")
def s18_subsequences(spark, d):
    rows = sequences(spark, d)
    n = F.length("seq")
    spans = rows.select(F.col("contig").alias("id"), "genome", "contig", F.floor(n / 3).alias("start"), F.floor(n / 2).alias("end"))
    return rounded(chunks.subsequences(spans, rows))


@query(HITS + "SELECT genome, contig, count(DISTINCT pos) AS covered FROM hits GROUP BY ALL")
def a9_hit_coverage(spark, d):
    return locate.hit_coverage(runs(spark, d))


@query(SEQ + ", z AS (SELECT genome, sum(length(seq)) AS size FROM s GROUP BY genome), g AS (SELECT genome, size, lead(size, 4) OVER (ORDER BY size, genome) - size AS spread FROM z) SELECT genome AS first, CAST(spread AS BIGINT) AS spread FROM g WHERE spread IS NOT NULL ORDER BY spread, size, genome LIMIT 1")
def n_closest_genomes(spark, d):
    """The five genomes whose sizes lie closest together."""
    return stats.closest_group(c22_genome_sizes(spark, d), "genome", "size", 5)


@query("WITH x AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS length FROM orders) SELECT * FROM x WHERE length IS NOT NULL")
def n_steps(spark, d):
    return stats.steps(_table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").where("length IS NOT NULL")


@query(
    f"""WITH b AS (SELECT item_id AS id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]+', '', 'g')) AS x FROM benchmark),
p AS (SELECT id, x, lead(x) OVER (ORDER BY id) AS y FROM b), q AS (SELECT id, CASE WHEN length(x) > length(y) THEN y ELSE x END AS small, CASE WHEN length(x) > length(y) THEN x ELSE y END AS big FROM p WHERE y IS NOT NULL),
w AS (SELECT id, small, substring(big, i + 1, length(small)) AS part FROM (SELECT *, unnest(range(length(big) - length(small) + 1)) AS i FROM q WHERE length(small) > 0))
SELECT id, round(max(greatest(length(small) - hamming(small, part), length(small) - hamming(small, {RC.format('part')})) / length(small)), 6) AS homology FROM w GROUP BY id"""
)
def n_best_homology(spark, d):
    """Neighbouring benchmark texts as sequences: the best place of the shorter along the longer."""
    rows = _table(spark, d, "benchmark").select(F.col("item_id").alias("id"), S.dna(F.coalesce("text", F.lit(""))).alias("x"))
    at = kmers.ranked(rows, "id")
    near = at.join(at.select((F.col("rank") - 1).alias("rank"), F.col("x").alias("y")), "rank").select("id", "x", "y")
    return rounded(locate.best_homology(near))


#: The search spelled out: every position's longest stretch of enough genomes, one letter more at a time, then from each
#: first start to the next behind the position at which the element could not grow.
SHARED_K, SHARED_LENGTH, SHARED_SHARE = K, 24, 0.25
SHARED = (
    SEQ.replace("WITH", "WITH RECURSIVE", 1)
    + f""", n AS (SELECT CAST(ceil({SHARED_SHARE} * count(DISTINCT genome)) AS BIGINT) AS support, count(DISTINCT genome) AS genomes FROM s),
refs AS (SELECT genome FROM (SELECT genome, row_number() OVER (ORDER BY genome) AS i FROM (SELECT DISTINCT genome FROM s)), n WHERE i <= genomes - support + 1),
c AS (SELECT genome, contig, seq, {RC.format("seq")} AS back, length(seq) AS size, CAST(unnest(range(length(seq) - {SHARED_K - 1})) AS BIGINT) AS pos FROM s WHERE length(seq) >= {SHARED_K}),
f AS (SELECT genome, contig, pos, least(substring(seq, pos + 1, {SHARED_K}), substring(back, size - pos - {SHARED_K} + 1, {SHARED_K})) AS kmer FROM c),
core AS (SELECT genome, contig, pos FROM f WHERE kmer IN (SELECT kmer FROM f GROUP BY kmer HAVING count(DISTINCT genome) >= (SELECT support FROM n))),
first_grown AS (
  SELECT genome, contig, seq, back, size, pos, {SHARED_LENGTH} AS len, least(substring(seq, pos + 1, {SHARED_LENGTH}), substring(back, size - pos - {SHARED_LENGTH} + 1, {SHARED_LENGTH})) AS x FROM c WHERE pos + {SHARED_LENGTH} <= size),
grown AS (
  SELECT * FROM first_grown WHERE x IN (SELECT x FROM first_grown GROUP BY x HAVING count(DISTINCT genome) >= (SELECT support FROM n))
  UNION ALL
  SELECT genome, contig, seq, back, size, pos, len, x FROM (
    SELECT *, len(list_distinct(list(genome) OVER (PARTITION BY x))) AS held FROM (
      SELECT genome, contig, seq, back, size, pos, len + 1 AS len, least(substring(seq, pos + 1, len + 1), substring(back, size - pos - len, len + 1)) AS x FROM grown WHERE pos + len + 1 <= size))
  WHERE held >= (SELECT support FROM n)),
starts AS (SELECT genome, contig, pos AS start, pos + max(len) AS stop FROM grown WHERE genome IN (SELECT genome FROM refs) GROUP BY genome, contig, pos),
failed AS (
  SELECT t.*, CASE WHEN c.pos - (stop - {SHARED_K}) <= {SHARED_K} THEN c.pos ELSE stop - {SHARED_K - 1} END AS failed
  FROM (SELECT *, stop - {SHARED_K - 1} AS least FROM starts) t ASOF LEFT JOIN core c ON t.genome = c.genome AND t.contig = c.contig AND t.least <= c.pos),
linked AS (
  SELECT f.genome, f.contig, f.start, f.stop, g.start AS following
  FROM (SELECT *, failed + 1 AS behind FROM failed) f ASOF LEFT JOIN starts g ON f.genome = g.genome AND f.contig = g.contig AND f.behind <= g.start),
taken AS (
  SELECT * FROM linked WHERE (genome, contig, start) IN (SELECT (genome, contig, min(start)) FROM starts GROUP BY genome, contig)
  UNION ALL SELECT l.* FROM taken t JOIN linked l ON l.genome = t.genome AND l.contig = t.contig AND l.start = t.following),
texts AS (SELECT DISTINCT substring(seq, start + 1, stop - start) AS seq FROM taken JOIN s USING (genome, contig)),
shared AS (SELECT DISTINCT least(seq, {RC.format("seq")}) AS seq FROM texts)
"""
)


@query(SHARED + "SELECT seq FROM shared")
def q_shared_elements(spark, d):
    """Q1 to Q3 with exact homology over all documents, from as many reference genomes as one of any supporting set is among."""
    return find.find_shared(sequences(spark, d), Params(min_length=SHARED_LENGTH, kmer=SHARED_K, kmer_threshold=SHARED_SHARE))


@query(
    SHARED
    + f""", named AS (SELECT CAST(row_number() OVER (ORDER BY seq) - 1 AS VARCHAR) AS id, seq FROM shared),
turned AS (SELECT id, '+' AS strand, seq AS q FROM named UNION ALL SELECT id, '-', {RC.format("seq")} FROM named),
places AS (
  SELECT id, genome, contig, pos AS start, pos + length(q) AS stop, strand FROM turned JOIN c ON left(q, {SHARED_K}) = substring(seq, pos + 1, {SHARED_K}) WHERE substring(seq, pos + 1, length(q)) = q)
SELECT id, genome, contig, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", strand, 0 AS mismatches, CAST(1 AS DOUBLE) AS homology
FROM places WHERE id NOT IN (SELECT id FROM places GROUP BY id, genome HAVING count(*) > 3)"""
)
def q_instances(spark, d):
    """F8, F9: places of the shared elements, of those that occur at most three times in a genome."""
    return find.find_instances(sequences(spark, d), Params(min_length=SHARED_LENGTH, kmer=SHARED_K, kmer_threshold=SHARED_SHARE, max_occurrences=3))


@query(
    """WITH s AS (SELECT source AS genome, CAST(doc_id AS VARCHAR) AS contig, text FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS q FROM benchmark)
SELECT id, genome, contig, CAST(strpos(text, q) - 1 AS BIGINT) AS start FROM s JOIN b ON contains(text, q)"""
)
def j2_benchmark_places(spark, d):
    """First exact place of each benchmark text in each document, from all places that the seeds find."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("genome"), F.col("doc_id").cast("string").alias("contig"), F.col("text").alias("seq"))
    known = _table(spark, d, "benchmark").where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("seq"))
    found = locate.locate(known, docs, 0, seed=24).where("strand = '+'")
    return found.groupBy("id", "genome", "contig").agg(F.min("start").cast("long").alias("start"))


MISMATCHED = (
    """WITH s AS (SELECT source AS genome, CAST(doc_id AS VARCHAR) AS contig, text FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS q FROM benchmark WHERE length(text) > 0),
both_strands AS (SELECT id, '+' AS strand, q FROM b UNION ALL SELECT id, '-', reverse(translate(q, 'ACGT', 'TGCA')) FROM b),
seeds AS (SELECT id, strand, q, CAST(part * (length(q) // 4) AS BIGINT) AS off, substring(q, CAST(part * (length(q) // 4) + 1 AS BIGINT), 16) AS kmer FROM both_strands, range(4) t(part)),
w AS (SELECT genome, contig, text, unnest(range(length(text) - 15)) AS pos FROM s WHERE length(text) >= 16),
d AS (SELECT DISTINCT id, strand, q, genome, contig, text, pos - off AS start FROM w JOIN seeds ON substring(text, pos + 1, 16) = kmer WHERE pos >= off AND pos - off + length(q) <= length(text)),
m AS (SELECT *, (SELECT count(*) FROM range(length(q)) r(i) WHERE substring(q, i + 1, 1) <> substring(text, start + i + 1, 1)) AS mismatches FROM d)
"""
)


@query(MISMATCHED + 'SELECT id, genome, contig, start, start + length(q) AS "end", strand, mismatches FROM m WHERE mismatches <= 3')
def j3_benchmark_mismatches(spark, d):
    """Places of benchmark texts with at most three mismatches, either strand."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("genome"), F.col("doc_id").cast("string").alias("contig"), F.col("text").alias("seq"))
    known = _table(spark, d, "benchmark").where("length(text) > 0").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("seq"))
    return rounded(locate.locate_all(known, docs, 3, seed=24))


@query(
    MISMATCHED
    + """, best AS (SELECT genome, id, max((length(q) - mismatches) / length(q)) AS best FROM m WHERE mismatches <= 3 GROUP BY genome, id)
SELECT genome, count(*) FILTER (best >= 0.98) AS valid, (SELECT count(*) FROM b) - count(*) FILTER (best >= 0.98) AS failed, round(min(best), 6) AS lowest FROM (SELECT DISTINCT genome FROM s) LEFT JOIN best USING (genome) GROUP BY genome"""
)
def n_validated_elements(spark, d):
    """How many benchmark texts have a place of homology 0.98 in the documents of a source."""
    known = _table(spark, d, "benchmark").where("length(text) > 0").select(F.col("item_id").cast("string").alias("id"))
    length = F.col("end") - F.col("start")
    found = j3_benchmark_mismatches(spark, d).withColumn("homology", (length - F.col("mismatches")) / length)
    return rounded(assess.validated(known, found, _table(spark, d, "documents").select(F.col("source").alias("genome")), 0.98))


@query(
    """WITH s AS (SELECT source AS genome, CAST(doc_id AS VARCHAR) AS contig, text FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS q FROM benchmark WHERE length(text) > 2),
both_strands AS (SELECT id, '+' AS strand, q FROM b UNION SELECT id, '-', reverse(translate(q, 'ACGT', 'TGCA')) FROM b WHERE q <> reverse(translate(q, 'ACGT', 'TGCA'))),
seeds AS (SELECT id, strand, q, CAST(part * (length(q) // 3) AS BIGINT) AS off, substring(q, CAST(part * (length(q) // 3) + 1 AS BIGINT), 16) AS kmer FROM both_strands, range(3) t(part)),
w AS (SELECT genome, contig, text, unnest(range(length(text) - 15)) AS pos FROM s WHERE length(text) >= 16),
d AS (SELECT DISTINCT id, strand, q, genome, contig, text, pos - off AS start FROM w JOIN seeds ON substring(text, pos + 1, 16) = kmer),
spans AS (SELECT DISTINCT id, strand, q, genome, contig, text, start + x AS a, start + length(q) + y AS z FROM d, range(-2, 3) t(x), range(-2, 3) u(y) WHERE start + x >= 0 AND start + length(q) + y <= length(text)),
e AS (SELECT id, strand, genome, contig, z, min(levenshtein(q, substring(text, a + 1, z - a))) AS edits FROM spans GROUP BY ALL HAVING min(levenshtein(q, substring(text, a + 1, z - a))) <= 2),
r AS (SELECT *, z - row_number() OVER (PARTITION BY id, strand, genome, contig ORDER BY z) AS run FROM e)
SELECT id, genome, contig, CAST(arg_min(z, (edits, z)) AS BIGINT) AS "end", strand, min(edits) AS edits FROM r GROUP BY id, strand, genome, contig, run"""
)
def j2_gapped_places(spark, d):
    """Ends of the places of benchmark texts (of more than two characters) with at most two edits, either strand."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("genome"), F.col("doc_id").cast("string").alias("contig"), F.col("text").alias("seq"))
    known = _table(spark, d, "benchmark").where("length(text) > 2").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("seq"))
    return rounded(gapped.locate_gapped_all(known, docs, 2, seed=24).select("id", "genome", "contig", "end", "strand", "edits"))


# ---- alignments ------------------------------------------------------------------------------------------------

ALN = """
WITH r AS (
  SELECT l_linestatus AS assembly, 'u' || l_partkey AS query,
    CASE l_linenumber WHEN 6 THEN 4 WHEN 7 THEN 2048 ELSE CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 16 ELSE 256 END END AS flag,
    'chr' || (l_suppkey % 7) AS contig, l_orderkey AS pos, l_linenumber * 10 AS mapq, CAST(l_quantity AS BIGINT) % 25 + 1 AS q, l_linenumber AS i,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS score, l_discount,
    lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') || l_returnflag || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS line
  FROM lineitem),
a AS (
  SELECT assembly, query, flag, contig, pos, mapq, score, line,
    CASE WHEN l_discount < 0.03 THEN '32M' ELSE q || 'M' || i || 'I2D' || CASE WHEN 32 - q - i > 0 THEN (32 - q - i) || 'X' ELSE '' END END AS cigar,
    q || 'A' || i AS md,
    CASE WHEN flag = 256 THEN NULL ELSE translate(md5(query), '0123456789abcdef', 'ACGTACGTACGTACGT') END AS seq
  FROM r)
"""
MM = "32 - CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[M=]', 1), lambda x: CAST(x AS INT))) AS BIGINT)"
SPAN = "CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS INT))) AS BIGINT)"


def records(spark: SparkSession, d: str) -> DataFrame:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    flag = F.when(F.col("l_linenumber") == 6, 4).when(F.col("l_linenumber") == 7, 2048).otherwise(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 16).otherwise(256))
    q, i = F.col("l_quantity").cast("long") % 25 + 1, F.col("l_linenumber").cast("long")
    rest = F.when(32 - q - i > 0, F.concat((32 - q - i).cast("string"), F.lit("X"))).otherwise("")
    cigar = F.when(F.col("l_discount") < 0.03, "32M").otherwise(F.concat(q.cast("string"), F.lit("M"), i.cast("string"), F.lit("I2D"), rest))
    name = F.concat(F.lit("u"), F.col("l_partkey").cast("string"))
    line = F.concat(pad(F.col("l_orderkey"), 12), pad(i, 2), pad(F.col("l_partkey"), 10), pad(F.col("l_suppkey"), 10), pad(cents, 12), F.col("l_returnflag"), F.round(F.col("l_discount") * 100).cast("long").cast("string"))
    rows = _table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("assembly"), name.alias("query"), flag.alias("flag"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 7).cast("string")).alias("contig"), F.col("l_orderkey").alias("pos"),
        (i * 10).alias("mapq"), cents.alias("score"), line.alias("line"), cigar.alias("cigar"), F.concat(q.cast("string"), F.lit("A"), i.cast("string")).alias("md"),
    )
    return rows.withColumn("seq", F.when(F.col("flag") != 256, F.translate(F.md5("query"), "0123456789abcdef", "ACGTACGTACGTACGT")))


@query(ALN + f"SELECT cigar, md, {MM} AS mismatches, 32 - CAST(list_sum(list_transform(regexp_extract_all(md, '([0-9]+)', 1), lambda x: CAST(x AS INT))) AS BIGINT) AS md_mismatches, count(*) AS n FROM a GROUP BY ALL")
def c7_c8_mismatches(spark, d):
    n = F.lit(32)
    rows = records(spark, d).select("cigar", "md", S.cigar_mismatches(F.col("cigar"), n).alias("mismatches"), S.md_mismatches(F.col("md"), n).alias("md_mismatches"))
    return rounded(rows.groupBy("cigar", "md", "mismatches", "md_mismatches").agg(F.count(F.lit(1)).alias("n")))


@query(
    ALN
    + f""", p AS (SELECT query, arg_min(seq, line) AS p_seq, arg_min(flag, line) AS p_flag FROM a WHERE flag IN (0, 16, 4) AND seq IS NOT NULL GROUP BY query)
SELECT assembly, query, flag, contig, pos, coalesce(seq, CASE WHEN (flag & 16) = (p_flag & 16) THEN p_seq ELSE {RC.format("p_seq")} END) AS seq, {MM} AS mismatches
FROM a LEFT JOIN p USING (query) WHERE flag <> 4 AND {MM} <= 20 AND (seq IS NOT NULL OR p_seq IS NOT NULL)"""
)
def s10_j4_alignments(spark, d):
    out = alignments.within_mismatches(alignments.with_sequences(records(spark, d)), 20)
    return out.select("assembly", "query", "flag", "contig", "pos", "seq", F.col("mismatches").cast("long").alias("mismatches"))


@query(ALN + "SELECT assembly, query, contig, pos FROM a WHERE flag NOT IN (4, 2048) AND cigar IN ('32M', '32=')")
def s11_f2_exact_hits(spark, d):
    return alignments.kmer_hits(records(spark, d), 32, 0).select("assembly", "query", "contig", "pos")


@query(ALN + f"SELECT query, arg_max(contig, line) AS contig, arg_max(pos, line) AS start, arg_max(pos + {SPAN}, line) AS \"end\" FROM a WHERE flag <> 4 GROUP BY query")
def s12_c17_last_positions(spark, d):
    return alignments.last_positions(records(spark, d))


@query(ALN + f"SELECT contig, pos AS start, pos + {SPAN} AS \"end\", query AS name, mapq AS score, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM a WHERE flag <> 4")
def s17_bed(spark, d):
    return alignments.to_bed(records(spark, d))


@query(ALN + f", f AS (SELECT query FROM a WHERE assembly = 'F' AND flag <> 4 AND {MM} = 0 AND seq IS NOT NULL), o AS (SELECT query FROM a WHERE assembly = 'O' AND flag <> 4 AND {MM} = 0 AND seq IS NOT NULL) SELECT query FROM f INTERSECT SELECT query FROM o")
def j15_u2_shared_exact(spark, d):
    rows = records(spark, d)
    return alignments.shared_exact(rows.where("assembly = 'F'"), rows.where("assembly = 'O'"))


@query(ALN + f", x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {MM}, contig, pos, line) AS rank FROM a WHERE flag <> 4) SELECT query, contig, pos, line, rank FROM x WHERE rank <= 4")
def w7_best_hits(spark, d):
    rows = records(spark, d).where("flag <> 4").withColumn("mm", S.cigar_mismatches(F.col("cigar"), F.lit(32)))
    return rounded(locate.best_hits(rows, ["query"], ["mm", "contig", "pos", "line"], 3).select("query", "contig", "pos", "line", "rank"))


HIT = ALN + f", h AS (SELECT assembly, query AS id, contig, pos, score, {MM} AS mismatches FROM a WHERE flag NOT IN (4, 2048))"


def element_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).where("flag NOT IN (4, 2048)")
    return rows.select("assembly", F.col("query").alias("id"), "contig", "pos", "score", S.cigar_mismatches(F.col("cigar"), F.lit(32)).cast("long").alias("mismatches"))


def known_ids(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("id"))


def _described(x: str) -> str:
    return f"avg({x}) AS {x}_mean, median({x}) AS {x}_median, stddev_pop({x}) AS {x}_sd, min({x}) AS {x}_min, max({x}) AS {x}_max, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS {x}_iqr"


def _rounding(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    HIT
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY assembly, id ORDER BY mismatches, contig, pos, score) AS k FROM h WHERE id IN (SELECT 'u' || p_partkey FROM part)),
x AS (SELECT assembly, count(*) AS hits, count(*) FILTER (mismatches = 0) AS exact, {_described("mismatches")}, {_described("score")} FROM ranked WHERE k = 1 GROUP BY assembly)
SELECT assembly, hits, exact, mismatches_min, mismatches_max, score_min, score_max, (SELECT count(*) FROM part) - hits AS missing, {_rounding([f"{a}_{b}" for a in ("mismatches", "score") for b in ("mean", "median", "sd", "iqr")])} FROM x"""
)
def a10_completeness(spark, d):
    return rounded(assess.completeness(known_ids(spark, d), element_hits(spark, d)))


@query(
    HIT
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY assembly, id ORDER BY mismatches, contig, pos, score) AS k FROM h WHERE id IN (SELECT 'u' || p_partkey FROM part))
SELECT assembly, id, mismatches, score, mismatches = 0 AS is_exact FROM ranked WHERE k = 1"""
)
def k7_element_report(spark, d):
    return order.element_report(known_ids(spark, d), element_hits(spark, d))


@query(HIT + "SELECT assembly, contig, pos, arg_min(id, (mismatches, id)) AS id, min(mismatches) AS mismatches FROM h GROUP BY assembly, contig, pos")
def n_best_by_place(spark, d):
    return alignments.best_by_place(element_hits(spark, d))


@query(HIT + "SELECT assembly, id, contig, pos, round(100 * (32 - mismatches) / 32, 6) AS identity, round(log10(score), 6) AS log_score, round(ln(score), 6) AS ln_score, CAST(floor(score / 1000) AS BIGINT) AS step, mismatches = 0 AS is_exact, CASE assembly WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS kind FROM h WHERE regexp_matches(contig, '^chr[1-6]$') AND assembly IN ('F', 'O') AND score IS NOT NULL")
def c24_f16_derived(spark, d):
    """Derived columns of the hits on contigs whose names match."""
    rows = element_hits(spark, d).where(F.col("contig").rlike("^chr[1-6]$") & F.col("assembly").isin("F", "O") & F.col("score").isNotNull())
    kinds = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    out = rows.select("assembly", "id", "contig", "pos", (100 * (32 - F.col("mismatches")) / 32).alias("identity"), F.log10("score").alias("log_score"), F.ln("score").alias("ln_score"), F.floor(F.col("score") / 1000).alias("step"), (F.col("mismatches") == 0).alias("is_exact"), kinds[F.col("assembly")].alias("kind"))
    return rounded(out)


@query("WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, count(*) AS n, round(max(l_extendedprice), 4) AS most FROM lineitem JOIN g USING (l_returnflag, l_linestatus) WHERE abs((l_extendedprice - m) / sd) < 2 GROUP BY ALL")
def f16_inliers(spark, d):
    """Line items whose price is less than two deviations from their group's mean."""
    by = ["l_returnflag", "l_linestatus"]
    rows = stats.inliers(_table(spark, d, "lineitem").select(*by, "l_extendedprice"), "l_extendedprice", by, 2)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("l_extendedprice"), 4).alias("most"))


@query(HIT + "SELECT 'u' || p_partkey AS id FROM part EXCEPT SELECT id FROM h WHERE mismatches = 0 AND assembly = 'F'")
def j11_missing(spark, d):
    return assess.missing(known_ids(spark, d), element_hits(spark, d).where("mismatches = 0 AND assembly = 'F'"))


@query(HIT + ", n AS (SELECT id, assembly, count(*) AS n FROM h GROUP BY ALL) SELECT id, max(n) AS most FROM n GROUP BY id HAVING max(n) <= 8")
def f9_a13_occurrences(spark, d):
    return locate.not_repeated(element_hits(spark, d).withColumnRenamed("assembly", "genome"), 8)


# ---- order -----------------------------------------------------------------------------------------------------

DAY = "CAST(datediff('day', TIMESTAMP '1992-01-01', l_shipdate) AS BIGINT)"
ANC = f"""
WITH x AS (SELECT o_orderpriority AS genome, l_returnflag || l_linestatus AS contig, p_brand AS id, {DAY} AS start, l_orderkey
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
anchors AS (SELECT genome, contig, id, min(start) AS start FROM x GROUP BY ALL)
"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    line, orders, part = (_table(spark, d, t) for t in ("lineitem", "orders", "part"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    rows = rows.select(F.col("o_orderpriority").alias("genome"), F.concat("l_returnflag", "l_linestatus").alias("contig"), F.col("p_brand").alias("id"), day.alias("start"))
    # few rows of a large join, read many times, and each time with other filters: so they are made once
    return cut(rows.groupBy("genome", "contig", "id").agg(F.min("start").alias("start")))


GENOMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
COMBOS = (
    ANC
    + ", c AS (SELECT g0.id, [g0.contig, g1.contig, g2.contig, g3.contig, g4.contig] AS contigs, [g0.start, g1.start, g2.start, g3.start, g4.start] AS starts FROM "
    + " JOIN ".join(f"(SELECT * FROM anchors WHERE genome = '{g}') g{i}" + (f" ON g{i}.id = g0.id" if i else "") for i, g in enumerate(GENOMES))
    + ")"
)


@query(COMBOS + "SELECT id, array_to_string(contigs, ',') AS contigs, array_to_string(starts, ',') AS starts FROM c")
def j9_f11_combinations(spark, d):
    c = synteny.contig_combinations(anchors(spark, d), GENOMES)
    return c.select("id", F.array_join("contigs", ",").alias("contigs"), F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"))


DOWN = ANC.replace("l_returnflag || l_linestatus", "l_linestatus") + COMBOS[len(ANC) :]
PAIRS = (
    DOWN
    + """, p AS (SELECT a.contigs, a.id AS src, b.id AS dst, list_filter(list_transform(list_zip(b.starts, a.starts), lambda z: z[1] - z[2]), lambda v: v > 0) AS ahead FROM c a JOIN c b ON a.contigs = b.contigs AND a.id <> b.id),
pairs AS (SELECT array_to_string(contigs, ',') AS contigs, src, dst, CAST(len(ahead) AS BIGINT) AS support, list_sum(ahead) / len(ahead) AS dist FROM p WHERE len(ahead) >= 4)
"""
)


def by_status(spark: SparkSession, d: str) -> DataFrame:
    """Anchors on two contigs, one for each line status."""
    rows = anchors(spark, d).withColumn("contig", F.substring(F.col("contig"), F.lit(2), F.lit(1)))
    return rows.groupBy("genome", "contig", "id").agg(F.min("start").alias("start"))


def pairs(at: DataFrame, least: int) -> DataFrame:
    return synteny.order_support(synteny.contig_combinations(at, GENOMES), least)


@query(PAIRS + "SELECT contigs, src, dst, support, round(dist, 6) AS dist FROM pairs")
def j8_a6_order_support(spark, d):
    return rounded(pairs(by_status(spark, d), 4).withColumn("contigs", F.array_join("contigs", ",")))


@query(PAIRS + "SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS score FROM pairs")
def a7_support_map(spark, d):
    return rounded(synteny.support_map(pairs(by_status(spark, d), 4)))


ALL5 = PAIRS + ", e AS (SELECT contigs, src, dst FROM pairs WHERE support = 5), red AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.contigs = y.contigs AND x.dst = y.src WHERE x.contigs = e.contigs AND x.src = e.src AND y.dst = e.dst))"


def reduced(at: DataFrame) -> DataFrame:
    return graph.transitive_reduction(pairs(at, 5).select(F.array_join("contigs", ",").alias("contigs"), "src", "dst"), ["contigs"], transitive=True)


@query(ALL5 + "SELECT * FROM red")
def g3_transitive_reduction(spark, d):
    return reduced(by_status(spark, d))


PATHS = ALL5.replace("WITH x AS", "WITH RECURSIVE x AS", 1) + """, walk AS (
  SELECT contigs, src AS node, [src] AS path FROM red WHERE NOT EXISTS (SELECT 1 FROM red r WHERE r.contigs = red.contigs AND r.dst = red.src)
  UNION SELECT w.contigs, r.dst, list_append(w.path, r.dst) FROM walk w JOIN red r ON r.contigs = w.contigs AND r.src = w.node),
paths AS (SELECT contigs, path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM red r WHERE r.contigs = w.contigs AND r.src = w.node))
"""


@query(PATHS + "SELECT contigs, array_to_string(path, ',') AS path FROM paths WHERE len(path) >= 2")
def g4_f13_paths(spark, d):
    return graph.source_to_sink_paths(reduced(by_status(spark, d)), ["contigs"], 2).select("contigs", F.array_join("path", ",").alias("path"))


@query(
    PATHS
    + """, ranked AS (SELECT path, row_number() OVER (ORDER BY -len(path), path) AS k FROM (SELECT DISTINCT path FROM paths WHERE len(path) >= 2)),
greedy AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR[]) AS path
  UNION ALL SELECT r.k, CASE WHEN list_has_any(g.used, r.path) THEN g.used ELSE list_concat(g.used, r.path) END, CASE WHEN list_has_any(g.used, r.path) THEN NULL ELSE r.path END FROM greedy g JOIN ranked r ON r.k = g.k + 1)
SELECT array_to_string(path, ',') AS path FROM greedy WHERE path IS NOT NULL"""
)
def g5_disjoint_cover(spark, d):
    """t4 and g5: the longest-first disjoint blocks among all collinear ones."""
    return order.syntenic_blocks(by_status(spark, d), 1.0, 2, minimise=True).select(F.array_join("path", ",").alias("path"))


def _closed(steps: int, edges: str = "w", name: str = "b") -> str:
    """For each two nodes of a combination the path whose weakest rank is greatest, by doubling."""
    out = f", {name}0 AS (SELECT contigs, src, dst, r FROM {edges})"
    for i in range(steps):
        k = f"{name}{i}"
        out += f", {name}{i + 1} AS (SELECT contigs, src, dst, max(r) AS r FROM (SELECT * FROM {k} UNION ALL SELECT x.contigs, x.src, y.dst, least(x.r, y.r) FROM {k} x JOIN {k} y ON x.contigs = y.contigs AND x.dst = y.src) GROUP BY contigs, src, dst)"
    return out


# the edges up to the weakest rank of the cycle that lasts longest go
@query(
    PAIRS.replace(">= 4", ">= 3")
    + ", w AS (SELECT contigs, src, dst, support, CASE WHEN support = 5 THEN 1000000000 ELSE row_number() OVER (PARTITION BY contigs ORDER BY support, src, dst) END AS r FROM pairs)"
    + _closed(6)
    + " SELECT contigs, src, dst, support FROM w LEFT JOIN (SELECT contigs, max(r) AS t FROM b6 WHERE src = dst GROUP BY contigs) USING (contigs) WHERE r > coalesce(t, 0)"
)
def g2_reduce_until_acyclic(spark, d):
    """Order pairs of at least three genomes without the weakest ones that close cycles."""
    return graph.reduce_until_acyclic(pairs(by_status(spark, d), 3), len(GENOMES)).select(F.array_join("contigs", ",").alias("contigs"), "src", "dst", F.col("support").cast("long").alias("support"))


@query(
    PAIRS.replace(">= 4", ">= 3")
    + ", w AS (SELECT contigs, src, dst, 1 AS r FROM pairs)"
    + _closed(6)
    + " SELECT contigs, count(*) FILTER (WHERE src = dst) = 0 AS acyclic FROM b6 GROUP BY contigs"
)
def g1_acyclic(spark, d):
    """Whether the order pairs of at least three genomes have no cycle, for each combination of contigs."""
    return graph.is_acyclic(pairs(by_status(spark, d), 3).select(F.array_join("contigs", ",").alias("contigs"), "src", "dst"), ["contigs"])


# the closure of what g2 leaves; an edge stays if no other edge of its source has a way to its end
@query(
    PAIRS.replace(">= 4", ">= 3")
    + ", w AS (SELECT contigs, src, dst, support, CASE WHEN support = 5 THEN 1000000000 ELSE row_number() OVER (PARTITION BY contigs ORDER BY support, src, dst) END AS r FROM pairs)"
    + _closed(6)
    + ", e AS (SELECT contigs, src, dst, 1 AS r FROM w LEFT JOIN (SELECT contigs, max(r) AS t FROM b6 WHERE src = dst GROUP BY contigs) USING (contigs) WHERE r > coalesce(t, 0))"
    + _closed(6, "e", "k")
    + " SELECT contigs, src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e f JOIN k6 k ON k.contigs = f.contigs AND k.src = f.dst WHERE f.contigs = e.contigs AND f.src = e.src AND k.dst = e.dst)"
)
def g3_reduction_by_ways(spark, d):
    """Order pairs of at least three genomes, acyclic and reduced by ways of any length."""
    left = graph.reduce_until_acyclic(pairs(by_status(spark, d), 3), len(GENOMES)).select(F.array_join("contigs", ",").alias("contigs"), "src", "dst")
    return graph.transitive_reduction(left, ["contigs"])


@query(
    PATHS
    + """, b AS (SELECT DISTINCT array_to_string(path, ',') AS block, path FROM paths WHERE len(path) >= 2),
spot AS (SELECT genome || '/' || contig AS contig, id, start FROM anchors),
step AS (SELECT b.block, a.contig, 1 AS i, min(a.start) AS last FROM b JOIN spot a ON a.id = b.path[1] GROUP BY ALL
  UNION SELECT s.block, s.contig, s.i + 1, (SELECT min(a.start) FROM spot a WHERE a.contig = s.contig AND a.id = b.path[s.i + 1] AND a.start > s.last) FROM step s JOIN b ON b.block = s.block WHERE s.i < len(b.path) AND s.last IS NOT NULL)
SELECT b.block, EXISTS (SELECT 1 FROM step s WHERE s.block = b.block AND s.i = len(b.path) AND s.last IS NOT NULL) AS valid FROM b"""
)
def g7_f15_intact_blocks(spark, d):
    at = by_status(spark, d)
    return graph.intact_blocks(named_blocks(at), at.select(F.concat_ws("/", "genome", "contig").alias("contig"), "id", "start"))


@query(PATHS + "SELECT genome, contig, id, start FROM anchors WHERE id IN (SELECT unnest(path) FROM paths WHERE len(path) >= 2)")
def f15_in_blocks(spark, d):
    """Anchors that some block refers to."""
    at = by_status(spark, d)
    return synteny.in_blocks(at, graph.source_to_sink_paths(reduced(at), ["contigs"], 2))


def named_blocks(at: DataFrame) -> DataFrame:
    paths = graph.source_to_sink_paths(reduced(at), ["contigs"], 2).select("path").distinct()
    return paths.select(F.array_join("path", ",").alias("block"), "path")


@query(
    PATHS
    + """, b AS (SELECT DISTINCT array_to_string(path, ',') AS block, path FROM paths WHERE len(path) >= 2)
SELECT f.genome, f.contig, b.block, f.start, l.start AS "end" FROM b JOIN anchors f ON f.id = b.path[1] JOIN anchors l ON l.id = b.path[-1] AND l.genome = f.genome AND l.contig = f.contig"""
)
def n_block_ends(spark, d):
    """Where blocks begin and end on the contigs that hold both ends."""
    at = by_status(spark, d)
    return synteny.block_ends(named_blocks(at), at)


@query(
    PATHS
    + """, b AS (SELECT DISTINCT array_to_string(path, ',') AS block, path FROM paths WHERE len(path) >= 2),
step AS (SELECT b.block, a.genome, a.contig, 1 AS i, min(a.start) AS last FROM b JOIN anchors a ON a.id = b.path[1] GROUP BY ALL
  UNION SELECT s.block, s.genome, s.contig, s.i + 1, (SELECT min(a.start) FROM anchors a WHERE a.genome = s.genome AND a.contig = s.contig AND a.id = b.path[s.i + 1] AND a.start > s.last) FROM step s JOIN b ON b.block = s.block WHERE s.i < len(b.path) AND s.last IS NOT NULL),
good AS (SELECT DISTINCT s.genome, s.block FROM step s JOIN b ON b.block = s.block WHERE s.i = len(b.path) AND s.last IS NOT NULL)
SELECT g.genome, count(good.block) AS valid, (SELECT count(*) FROM b) - count(good.block) AS invalid FROM (SELECT DISTINCT genome FROM anchors) g LEFT JOIN good USING (genome) GROUP BY g.genome"""
)
def k10_contiguity(spark, d):
    """How many blocks each genome holds in their order."""
    at = by_status(spark, d)
    return order.assembly_contiguity(named_blocks(at), at)


EVENTS = """
WITH anchors AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS genome, 'day' AS contig, event_type AS id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS start FROM events),
u AS (SELECT *, count(*) OVER (PARTITION BY genome, id) AS n FROM anchors),
adj AS (SELECT genome, contig, id AS src, lead(id) OVER w AS dst, lead(start) OVER w - start AS dist FROM u WHERE n = 1 WINDOW w AS (PARTITION BY genome, contig ORDER BY start, id)),
con AS (SELECT src, dst, count(*) AS weight, avg(dist) AS dist FROM adj WHERE dst IS NOT NULL GROUP BY src, dst)
"""


def event_anchors(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return _table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("genome"), F.lit("day").alias("contig"), F.col("event_type").alias("id"), at.alias("start"))


def event_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return synteny.adjacency(synteny.unique_ids(event_anchors(spark, d)))


@query(EVENTS + "SELECT genome, contig, src, dst, dist FROM adj WHERE dst IS NOT NULL")
def w3_f10_adjacency(spark, d):
    return event_adjacency(spark, d)


@query(EVENTS + "SELECT src, dst, weight, round(dist, 3) AS dist FROM con")
def a8_u3_consensus(spark, d):
    return rounded(synteny.consensus(event_adjacency(spark, d)), 3)


STRONG = EVENTS.replace("WITH anchors", "WITH RECURSIVE anchors", 1) + """, e AS (SELECT src, dst, weight FROM con WHERE weight > (SELECT avg(weight) FROM con)),
q AS (SELECT DISTINCT src, dst FROM adj WHERE dst IS NOT NULL),
walk AS (SELECT src AS a, src AS node, 1 AS n, CAST(NULL AS DOUBLE) AS lo, CAST(0 AS DOUBLE) AS total FROM (SELECT DISTINCT src FROM q)
  UNION SELECT w.a, e.dst, w.n + 1, least(coalesce(w.lo, e.weight), e.weight), w.total + e.weight FROM walk w JOIN e ON e.src = w.node WHERE w.n < 5),
short AS (SELECT a, node, min(n) AS n FROM walk WHERE n > 1 AND node <> a GROUP BY a, node),
best AS (SELECT w.a, w.node, w.n, max(w.lo) AS lo, max(w.total / (w.n - 1)) AS mean FROM walk w JOIN short s ON s.a = w.a AND s.node = w.node AND s.n = w.n GROUP BY ALL),
g AS (SELECT q.src, q.dst, CAST(b.n AS BIGINT) AS n_nodes, b.lo AS min_weight, round(b.mean, 6) AS avg_weight, round(b.lo / b.n, 6) AS score FROM q JOIN best b ON b.a = q.src AND b.node = q.dst)
"""


def strong_edges(spark: SparkSession, d: str) -> DataFrame:
    con = cut(synteny.consensus(event_adjacency(spark, d)))
    mean = con.agg(F.avg("weight")).first()[0] or 0
    return con.where(F.col("weight") > mean)


@query(STRONG + "SELECT * FROM g")
def g6_f14_bounded_paths(spark, d):
    return rounded(graph.bounded_paths(event_adjacency(spark, d), strong_edges(spark, d), 3))


@query(
    STRONG
    + """, users AS (SELECT split_part(genome, '/', 1) AS genome, src, dst FROM adj WHERE dst IS NOT NULL)
SELECT genome, count(*) AS total, count(score) AS valid, round(sum(score), 6) AS score, round(avg(avg_weight), 4) AS avg_consensus FROM users LEFT JOIN g USING (src, dst) GROUP BY genome"""
)
def a12_w4_pair_scores(spark, d):
    near = event_adjacency(spark, d).withColumn("genome", F.substring_index("genome", "/", 1))
    paths = rounded(graph.bounded_paths(near, strong_edges(spark, d), 3)).select("src", "dst", "score", "avg_weight")
    out = graph.pair_scores(near, paths)
    return out.select("genome", "total", "valid", F.round("score", 6).alias("score"), F.round("avg_consensus", 4).alias("avg_consensus"))


@query(EVENTS + "SELECT src AS id FROM con UNION SELECT dst FROM con")
def u3_nodes(spark, d):
    return graph.nodes(synteny.consensus(event_adjacency(spark, d)))


@query(
    STRONG
    + """, placed AS (SELECT genome, contig, id AS src, start AS src_start, lead(id) OVER w AS dst, lead(start) OVER w AS dst_start FROM u WHERE n = 1 WINDOW w AS (PARTITION BY genome, contig ORDER BY start, id))
SELECT genome, contig, src, src_start, dst, dst_start, n_nodes, min_weight, avg_weight, score FROM placed JOIN g USING (src, dst)"""
)
def k8_pair_report(spark, d):
    """Neighbouring events of a user's day that the strong part of the consensus joins."""
    return rounded(order.pair_report(event_anchors(spark, d), strong_edges(spark, d)))


@query(
    STRONG
    + """, ids AS (SELECT genome, count(DISTINCT id) FILTER (n = 1) AS unique_ids, count(DISTINCT id) FILTER (n > 1) AS repeated_ids FROM u GROUP BY genome),
scored AS (SELECT genome, count(*) AS total, count(score) AS valid, sum(score) AS score, avg(avg_weight) AS avg_consensus FROM adj LEFT JOIN g USING (src, dst) WHERE dst IS NOT NULL GROUP BY genome)
SELECT genome, coalesce(total, 0) AS total, coalesce(valid, 0) AS valid, round(score, 4) AS score, round(avg_consensus, 4) AS avg_consensus, unique_ids, repeated_ids FROM ids LEFT JOIN scored USING (genome)"""
)
def k8_pair_summary(spark, d):
    """Pairs of each user's day in the consensus, with how many of its events are of unique types."""
    return rounded(order.pair_summary(event_anchors(spark, d), strong_edges(spark, d)), 4)


@query(
    STRONG
    + """, users AS (SELECT split_part(genome, '/', 1) AS genome, src, dst FROM adj WHERE dst IS NOT NULL)
SELECT genome, max_gap, count(*) AS total, count(score) FILTER (n_nodes <= max_gap + 2) AS valid, round(sum(score) FILTER (n_nodes <= max_gap + 2), 3) AS score FROM users LEFT JOIN g USING (src, dst), (SELECT unnest(range(4)) AS max_gap) GROUP BY genome, max_gap"""
)
def n_pair_sweep(spark, d):
    """Pairs of each user in the consensus for every gap from 0 to 3."""
    near = event_adjacency(spark, d).withColumn("genome", F.substring_index("genome", "/", 1))
    paths = graph.bounded_paths(near, strong_edges(spark, d), 3).select("src", "dst", "n_nodes", "score")
    return rounded(graph.pair_scores_by_gap(near, paths, [0, 1, 2, 3]), 3)


@query(EVENTS + "SELECT genome, contig, string_agg(id, ',' ORDER BY start, id) AS path FROM u WHERE n = 1 GROUP BY ALL")
def g8_contig_paths(spark, d):
    return synteny.contig_paths(synteny.unique_ids(event_anchors(spark, d))).select("genome", "contig", F.array_join("path", ",").alias("path"))


ALIGNED = (
    STRONG
    + """, paths AS (SELECT genome, contig, list(id ORDER BY start, id) AS p FROM u WHERE n = 1 GROUP BY ALL),
both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
near AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT n.a, x.b FROM near n JOIN both_ways x ON x.a = n.b),
parts AS (SELECT a AS node, min(b) AS part FROM near GROUP BY a),
own AS (SELECT DISTINCT genome, contig, p, part FROM (SELECT genome, contig, p, unnest(p) AS node FROM paths) JOIN parts USING (node)),
cells AS (SELECT genome, contig, part, p, 1 AS i, node, CASE WHEN p[1] = node THEN 7 ELSE -3 END AS score, [node] AS way FROM own JOIN parts USING (part)
  UNION ALL SELECT genome, contig, part, p, i + 1, node, CASE WHEN above > step THEN above ELSE step END, CASE WHEN above > step THEN way_above WHEN way_before IS NULL THEN [node] WHEN list_contains(way_before, node) THEN way_before ELSE list_append(way_before, node) END
  FROM (SELECT c.genome, c.contig, c.part, c.p, c.i, t.node, CASE WHEN c.p[c.i + 1] = t.node THEN 7 ELSE -3 END + coalesce(max(c.score) FILTER (e.src IS NOT NULL), 0) AS step, arg_min(c.way, (-c.score, c.node)) FILTER (e.src IS NOT NULL) AS way_before,
    max(c.score) FILTER (c.node = t.node) - 1 AS above, arg_min(c.way, c.node) FILTER (c.node = t.node) AS way_above
    FROM cells c JOIN parts t ON t.part = c.part LEFT JOIN e ON e.src = c.node AND e.dst = t.node WHERE c.i < len(c.p) GROUP BY c.genome, c.contig, c.part, c.p, c.i, t.node)),
ends AS (SELECT genome, contig, part, max(score) AS score, arg_min(way, (-score, -i, node)) AS way FROM cells GROUP BY ALL),
aligned AS (SELECT genome, contig, arg_max({'score': score, 'way': way}, (score, len(way), way)) AS x FROM ends GROUP BY ALL)
"""
)


@query(ALIGNED + "SELECT genome, contig, CAST(x.score AS BIGINT) AS score, len(x.way) AS path_len, array_to_string(x.way, ',') AS path FROM aligned")
def g9_g10_alignment(spark, d):
    """Each user's day aligned to the strong part of the consensus."""
    edges = strong_edges(spark, d)
    found = align.align(synteny.contig_paths(synteny.unique_ids(event_anchors(spark, d))), edges, graph.connected(edges))
    return found.withColumn("path", F.array_join("path", ","))


@query(
    ALIGNED
    + """, spans AS (SELECT a.genome, CAST(a.x.score AS BIGINT) AS score, len(a.x.way) AS path_len FROM aligned a JOIN u f ON f.n = 1 AND f.genome = a.genome AND f.id = a.x.way[1] JOIN u l ON l.n = 1 AND l.genome = a.genome AND l.id = a.x.way[-1] WHERE f.contig = l.contig)
SELECT genome, count(*) AS n_blocks, avg(path_len) AS path_len_mean, median(path_len) AS path_len_median, min(path_len) AS path_len_min, max(path_len) AS path_len_max, avg(score) AS score_mean, median(score) AS score_median, min(score) AS score_min, max(score) AS score_max FROM spans GROUP BY genome"""
)
def g11_a11_block_summary(spark, d):
    """Summary of the spans of all users' days."""
    edges = strong_edges(spark, d)
    at = event_anchors(spark, d).withColumn("end", F.col("start") + 1)
    _, summary = order.assembly_blocks(at, edges)
    return summary


@query(
    """WITH m AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS new FROM events),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
SELECT user_id, run, min(event_id) AS first_id, count(*) AS n, max(t) - min(t) AS span FROM r GROUP BY ALL"""
)
def w5_event_runs(spark, d):
    t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    rows = _table(spark, d, "events").select("user_id", "event_id", t.alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    runs = regions.islands(rows, ["user_id"], ["t", "event_id"], F.col("t") - F.lag("t").over(w) > 21_600_000_000, "run")
    return runs.groupBy("user_id", "run").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"))


@query(
    ANC
    + """, f AS (SELECT id, min(start) FILTER (genome = '1-URGENT') AS s1, arg_min(contig, (start, contig)) FILTER (genome = '1-URGENT') AS c1, min(start) FILTER (genome = '5-LOW') AS s2, arg_min(contig, (start, contig)) FILTER (genome = '5-LOW') AS c2 FROM anchors GROUP BY id),
m AS (SELECT *, CASE WHEN c1 <> lag(c1) OVER w OR s1 < lag(s1) OVER w OR c2 <> lag(c2) OVER w OR s2 < lag(s2) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY c1 ORDER BY id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY c1 ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
SELECT c1 AS contig, run, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 1"""
)
def w5_collinear_runs(spark, d):
    a = anchors(spark, d)
    first = lambda g: F.min(F.when(F.col("genome") == g, F.struct("start", "contig")))
    rows = a.groupBy("id").agg(first("1-URGENT").alias("a"), first("5-LOW").alias("b"))
    rows = rows.select("id", F.col("a.contig").alias("u_contig"), F.col("a.start").alias("u_start"), F.col("b.contig").alias("l_contig"), F.col("b.start").alias("l_start"))
    return regions.collinear_runs(rows, ["u", "l"], 1)


# ---- comparison ------------------------------------------------------------------------------------------------

SETS = f"""
WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, upper(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '[^ACGTacgt]+', '', 'g')) AS seq FROM documents),
a AS (SELECT md5(seq) AS id, seq FROM x WHERE seq <> '' GROUP BY seq),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]+', '', 'g')) AS seq FROM benchmark WHERE regexp_matches(text, '[ACGTacgt]')),
m AS (SELECT a.id AS id_a, b.id AS id_b FROM a JOIN b ON contains(CASE WHEN length(a.seq) < length(b.seq) THEN b.seq ELSE a.seq END, CASE WHEN length(a.seq) < length(b.seq) THEN a.seq ELSE b.seq END)
  OR contains(CASE WHEN length(a.seq) < length(b.seq) THEN b.seq ELSE a.seq END, {RC.format("CASE WHEN length(a.seq) < length(b.seq) THEN a.seq ELSE b.seq END")}))
"""


def element_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Distinct lines of all documents, and the benchmark texts, as sequences."""
    lines = _table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select(S.dna(F.col("line")).alias("seq")).where("seq <> ''").distinct()
    known = _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), S.dna(F.coalesce("text", F.lit(""))).alias("seq")).where("seq <> ''")
    return lines.select(F.md5("seq").alias("id"), "seq"), known


@query(SETS + "SELECT * FROM m")
def j6_c23_contained(spark, d):
    a, b = element_sets(spark, d)
    return compare.contained_pairs(a, b, K)


@query(SETS + "SELECT id_a, min(id_b) AS id_b FROM m GROUP BY id_a")
def j14_first_match(spark, d):
    a, b = element_sets(spark, d)
    return compare.first_match(compare.contained_pairs(a, b, K))


@query(SETS + ", n AS (SELECT (SELECT count(*) FROM a) AS expected, (SELECT count(*) FROM b) AS actual, (SELECT count(DISTINCT id_a) FROM m) AS found, (SELECT count(DISTINCT id_b) FROM m) AS matched) SELECT *, round(found / expected, 6) AS recall, round(matched / actual, 6) AS \"precision\" FROM n")
def k12_recall_precision(spark, d):
    a, b = element_sets(spark, d)
    return rounded(compare.recall_precision(compare.contained_pairs(a, b, K), a, b))


@query(SETS.split(",\nm AS")[0] + " SELECT id, seq FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE length(y.seq) > length(x.seq) AND contains(y.seq, x.seq))")
def j7_minimal_set(spark, d):
    """Lines of documents that are not part of another line."""
    a, _ = element_sets(spark, d)
    return compare.minimal_set(a, K)


SPANS = f"WITH x AS (SELECT l_linestatus AS s, 'p' || l_partkey AS contig, {DAY} AS start, {DAY} + CAST(l_quantity AS BIGINT) AS \"end\", l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS id FROM lineitem)"


def spans(spark: SparkSession, d: str, status: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")])
    rows = _table(spark, d, "lineitem").where(F.col("l_linestatus") == status)
    return rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("contig"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), name.alias("id"))


@query(SPANS + " SELECT a.contig, greatest(a.start, b.start) AS start, least(a.\"end\", b.\"end\") AS \"end\", a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON a.contig = b.contig AND a.start < b.\"end\" AND b.start < a.\"end\" WHERE a.s = 'F' AND b.s = 'O'")
def j10_overlaps(spark, d):
    return compare.overlaps(spans(spark, d, "F"), spans(spark, d, "O"), 64)


@query("SELECT l_returnflag AS genome, round(sum(l_quantity) / sum(CAST(p_size AS DOUBLE)), 6) AS covered FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def a18_coverage(spark, d):
    line, part = _table(spark, d, "lineitem"), _table(spark, d, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_returnflag").alias("genome"), F.lit(0).alias("start"), F.col("l_quantity").alias("end"), F.col("p_size").cast("double").alias("length"))
    return rounded(assess.coverage(rows, rows))


# ---- statistics ------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT corr(l_quantity, l_extendedprice) AS r1, corr(l_quantity, l_discount) AS r2, corr(l_quantity, l_tax) AS r3, corr(l_extendedprice, l_discount) AS r4, corr(l_extendedprice, l_tax) AS r5, corr(l_discount, l_tax) AS r6, count(*) AS n FROM lineitem),
x AS (SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_discount']) AS x, unnest(['l_extendedprice', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS y, unnest([r1, r2, r3, r4, r5, r6]) AS r, n FROM p)
SELECT x, y, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 3) AS t FROM x"""
)
def a15_correlations(spark, d):
    out = stats.correlations(_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("x", "y", F.round("r", 6).alias("r"), "n", F.round("t", 3).alias("t"))


def _beyond(t: str, v: str, by: str, rows: str) -> str:
    """SQL: (by, tail), the area of Student's density beyond t, in place of its angle x, with v degrees of freedom."""
    weight = "CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""ang AS (SELECT {by}, {v} AS v, atan({t} / sqrt({v})) AS x FROM {rows}),
tails AS (SELECT {by}, exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi()) * sum({weight} * pow(greatest(cos(x + i * (pi() / 2 - x) / 20000), 0), v - 1)) * (pi() / 2 - x) / 60000 AS tail FROM ang, range(20001) q(i) GROUP BY {by}, v, x)\n"""


@query(
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r1, corr(l_quantity, l_discount) AS r2, corr(l_quantity, l_tax) AS r3, corr(l_extendedprice, l_discount) AS r4, corr(l_extendedprice, l_tax) AS r5, corr(l_discount, l_tax) AS r6, count(*) AS n FROM lineitem),
u AS (SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_discount']) AS x0, unnest(['l_extendedprice', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS y0, unnest([r1, r2, r3, r4, r5, r6]) AS r, n FROM c),
"""
    + _beyond("(abs(r) * sqrt((n - 2) / (1 - r * r)))", "(n - 2)", "x0, y0", "u")
    + "SELECT x0 AS x, y0 AS y, round(r, 6) AS r, round(2 * tail, 6) AS p, 2 * tail < 0.001 AND abs(r) >= 0.7 AS marked FROM u JOIN tails USING (x0, y0)"
)
def a15_p_values(spark, d):
    """Correlations of the numbers of line items with their p values, the strong ones marked."""
    out = stats.marked(stats.correlations(_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    return rounded(out.select("x", "y", "r", "p", "marked"))


@query(
    "WITH g AS (SELECT c_mktsegment, count(c_acctbal) AS n, (avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(c_acctbal))) AS t FROM customer GROUP BY c_mktsegment),\n"
    + _beyond("t", "(n - 1)", "c_mktsegment", "g")
    + "SELECT c_mktsegment, round(t, 6) AS t, round(tail, 6) AS p_greater, round(2 * least(tail, 1 - tail), 6) AS p FROM g JOIN tails USING (c_mktsegment)"
)
def a16_one_sample_p(spark, d):
    """Whether a segment's balances are above 4500 on average: one-sided and two-sided p values."""
    out = stats.one_sample_t(_table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], 4500)
    df = F.col("n") - 1
    return rounded(out.select("c_mktsegment", "t", stats.p_value(F.col("t"), df, "greater").alias("p_greater"), stats.p_value(F.col("t"), df).alias("p")))


@query(
    """WITH g AS (SELECT o_orderpriority, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(x) FILTER (f) AS m1, avg(x) FILTER (NOT f) AS m2, var_samp(x) FILTER (f) AS v1, var_samp(x) FILTER (NOT f) AS v2
FROM (SELECT o_orderpriority, o_totalprice AS x, o_orderstatus = 'F' AS f FROM orders) GROUP BY o_orderpriority),
h AS (SELECT o_orderpriority, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM g),
"""
    + _beyond("t", "df", "o_orderpriority", "h")
    + "SELECT o_orderpriority, df, round(tail, 6) AS p_greater, round(1 - tail, 6) AS p_less FROM h JOIN tails USING (o_orderpriority)"
)
def a16_two_sample_p(spark, d):
    """Whether finished orders are dearer, or cheaper, than the others of their priority: one-sided p values."""
    out = stats.two_sample_t(_table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", ["o_orderpriority"])
    sides = [stats.p_value(F.col("t"), F.col("df"), side).alias(f"p_{side}") for side in ("greater", "less")]
    return rounded(out.select("o_orderpriority", "df", *sides))


@query("SELECT c_mktsegment, count(c_acctbal) AS n, round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(c_acctbal))), 6) AS t FROM customer GROUP BY c_mktsegment")
def a16_one_sample_t(spark, d):
    return rounded(stats.one_sample_t(_table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], 4500))


@query(
    """WITH g AS (SELECT o_orderpriority, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(x) FILTER (f) AS m1, avg(x) FILTER (NOT f) AS m2, var_samp(x) FILTER (f) AS v1, var_samp(x) FILTER (NOT f) AS v2
FROM (SELECT o_orderpriority, o_totalprice AS x, o_orderstatus = 'F' AS f FROM orders) GROUP BY o_orderpriority)
SELECT o_orderpriority, n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, n1 + n2 - 2 AS df FROM g"""
)
def a16_two_sample_t(spark, d):
    return rounded(stats.two_sample_t(_table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", ["o_orderpriority"]))


@query("SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope1, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def a17_regression(spark, d):
    out = stats.regression(_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return out.select("l_returnflag", F.round("intercept", 3).alias("intercept"), F.round("slope1", 6).alias("slope1"), F.round("r2", 6).alias("r2"))


@query(
    """WITH m AS (SELECT l_returnflag, var_samp(l_quantity) AS aa, var_samp(l_discount) AS bb, covar_samp(l_quantity, l_discount) AS ab, covar_samp(l_quantity, l_extendedprice) AS ay, covar_samp(l_discount, l_extendedprice) AS b_y, var_samp(l_extendedprice) AS yy FROM lineitem GROUP BY l_returnflag),
s AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS s1, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS s2 FROM m)
SELECT l_returnflag, round(s1, 4) AS slope1, round(s2, 2) AS slope2, round((s1 * ay + s2 * b_y) / yy, 6) AS r2 FROM s"""
)
def a17_regression_two(spark, d):
    out = stats.regression(_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope1", 4).alias("slope1"), F.round("slope2", 2).alias("slope2"), F.round("r2", 6).alias("r2"))


@query(
    """SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS diff, round((o_totalprice - lag(o_totalprice) OVER w) / lag(o_totalprice) OVER w, 6) AS pct_change,
round((o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)) / stddev_samp(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def w6_f16_differences(spark, d):
    out = stats.differences(_table(spark, d, "orders"), "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.round("diff", 4).alias("diff"), F.round("pct_change", 6).alias("pct_change"), F.round("z", 4).alias("z"))


@query("WITH s AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS members FROM lineitem GROUP BY l_partkey) SELECT members, count(*) AS n FROM s GROUP BY members")
def a19_set_memberships(spark, d):
    rows = _table(spark, d, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("set"))
    return stats.set_memberships(rows, "l_partkey", "set")


@query(
    """WITH g AS (SELECT * FROM (SELECT unnest([10, 20, 30, 40]) AS min_length) CROSS JOIN (SELECT unnest([0.9, 0.95, 1.0]) AS min_identity) CROSS JOIN (SELECT unnest([1, 2, 3]) AS min_appearances))
SELECT CAST(min_length AS BIGINT) AS min_length, CAST(min_identity AS DOUBLE) AS min_identity, CAST(min_appearances AS BIGINT) AS min_appearances, count(*) FILTER (l_quantity >= min_length AND 1 - l_discount >= min_identity AND l_linenumber >= min_appearances) AS n FROM lineitem, g GROUP BY ALL"""
)
def a20_sweep(spark, d):
    counted = (F.col("l_quantity") >= F.col("min_length")) & (1 - F.col("l_discount") >= F.col("min_identity")) & (F.col("l_linenumber") >= F.col("min_appearances"))
    out = stats.sweep({"min_length": [10, 20, 30, 40], "min_identity": [0.9, 0.95, 1.0], "min_appearances": [1, 2, 3]}, _table(spark, d, "lineitem"), counted)
    return out.select(F.col("min_length").cast("long").alias("min_length"), "min_identity", F.col("min_appearances").cast("long").alias("min_appearances"), "n")


@query(
    """SELECT o_custkey, min(o_orderdate) AS first_date, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_custkey"""
)
def a14_group_summary(spark, d):
    rows = _table(spark, d, "orders").groupBy("o_custkey")
    return rows.agg(F.min("o_orderdate").alias("first_date"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("priorities"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_key"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("statuses"))


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def p1_unpivot(spark, d):
    rows = _table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return stats.long(rows, ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    """WITH s AS (SELECT l_returnflag, sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_returnflag)
SELECT 'quantity' AS field, sum(quantity) FILTER (l_returnflag = 'A') AS "A", sum(quantity) FILTER (l_returnflag = 'N') AS "N", sum(quantity) FILTER (l_returnflag = 'R') AS "R" FROM s
UNION ALL SELECT 'n', sum(n) FILTER (l_returnflag = 'A'), sum(n) FILTER (l_returnflag = 'N'), sum(n) FILTER (l_returnflag = 'R') FROM s"""
)
def p2_transpose(spark, d):
    rows = _table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("n"))
    return stats.transposed(rows, "l_returnflag", ["A", "N", "R"])


@query("SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier")
def p3_concat(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = _table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return stats.tagged({"customer": c, "supplier": s}, "kind").select("kind", "name", "balance", "segment")


@query(
    """WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.q AS q_x, b.q AS q_y FROM a FULL JOIN b ON a.k = b.k"""
)
def j12_outer_merge(spark, d):
    line = _table(spark, d, "lineitem")
    side = lambda s, n: line.where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias(n))
    return side("F", "q_x").join(side("O", "q_y"), "k", "full_outer")


@query(
    """WITH o AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM o WHERE before IS NULL OR before <> event_type)
SELECT event_type AS stage, count(*) AS n, CAST(sum(epoch_us(until) - epoch_us(ts)) AS BIGINT) AS total FROM s WHERE until IS NOT NULL GROUP BY event_type"""
)
def s22_stage_times(spark, d):
    """The time that each stage takes, from an event to the next one of another kind."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).where("before IS NULL OR before <> event_type")
    rows = rows.withColumn("until", F.lead("ts").over(w)).where("until IS NOT NULL")
    return rows.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("until"))).alias("total"))
