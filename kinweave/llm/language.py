"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

Counting. A task encodes its documents in blocks: each token as an index into the block's own vocabulary. Only the
vocabularies travel: counts over all training tokens are summed by word, within tasks first, and joined back to the
blocks' words. Documents are never spread out into tokens across the cluster.

Model. The WORDS most frequent words by their counts over all blocks (ties by the word), the end, and BUCKETS buckets
of all other words (by their last two bytes) are the classes. The two classes before a token, each by its own
vectors, add up to a context vector; its products with the class vectors, plus a bias, are the class logits. Scores
are normalised over all classes, by one matrix product over the distinct contexts of a batch; a word of a bucket has
the add-one share of its count in the bucket, where one more place is for all unknown words.

Training takes every training token once, in ROUNDS rounds. Documents are dealt into shards of about SHARD_TOKENS
tokens (more where there would be over MOST_SHARDS) and ordered there by a hash of their id and text; each shard
descends from common parameters, which are then averaged by tokens. How the input is partitioned has no part in it.

Edge cases: null or empty text is one end token; a null doc_id is learned from; repeated rows count each, and are of
one shard, which streams; a text longer than a block is a block, one longer than a step a step; ties in the hash of a
shard are equal rows; with no training documents N and V are 0 and both models are uniform over what they know; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, mix64, parts_for, table, texts_of

BLOCK_BYTES = 16 << 20
WORDS, BUCKETS = 960, 61
#: Classes: words by rank, buckets, the end; one more as context only, the start.
END, START = WORDS + BUCKETS, WORDS + BUCKETS + 1
CLASSES = WORDS + BUCKETS + 1
VECTOR, ROUNDS, BATCH, NOISE, RATE = 24, 2, 2048, 32, 0.5
#: Training tokens of a shard, shards at most, and tokens that a step of a shard mixes.
SHARD_TOKENS, MOST_SHARDS, STEP_TOKENS = 4_000_000, 4096, 1 << 18

_ENCODED = "block long, doc_id long, held_out boolean, ids binary, words string, train array<int>, buckets array<int>"


def bucket(word: bytes) -> int:
    code = int.from_bytes(word[-2:], "little") + 65536 * min(len(word), 2)
    return int(mix64(np.array([code], np.uint64))[0] % np.uint64(BUCKETS))


def _encoded(batches):
    """Documents as indexes into their block's vocabulary, and the vocabulary with counts in training documents. 0 is the end."""
    part, number = TaskContext.get().partitionId(), 0
    suffixes: dict[bytes, int] = {}
    docs: list[tuple] = []

    def block():
        nonlocal number
        number += 1
        at = (part << 32) + number
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        vocabulary[b""]
        ids = []
        for _, _, text in docs:
            words = text.lower().split()
            ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
        trained = [x for (_, held, _), x in zip(docs, ids) if not held]
        train = np.bincount(np.concatenate([*trained, np.zeros(len(trained), np.uint32)]), minlength=len(vocabulary)) if trained else np.zeros(len(vocabulary), np.int64)
        buckets = [suffixes[k] if (k := w[-2:]) in suffixes else suffixes.setdefault(k, bucket(w)) for w in vocabulary]
        n = len(docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at] * (n + 1), pa.int64()), pa.array([d[0] for d in docs] + [None], pa.int64()), pa.array([d[1] for d in docs] + [None], pa.bool_()), pa.array([x.tobytes() for x in ids] + [None], pa.binary()),
             pa.array([None] * n + [b" ".join(vocabulary).decode()], pa.string()), pa.array([None] * n + [train], pa.list_(pa.int32())), pa.array([None] * n + [buckets], pa.list_(pa.int32()))],
            [c.split()[0] for c in _ENCODED.split(", ")],
        )

    size = 0
    for batch in batches:
        for row in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts_of(batch)):
            docs.append(row)
            size += len(row[2])
            if size >= BLOCK_BYTES:
                yield from block()
                docs, size = [], 0
    if docs:
        yield from block()


_CLASSED = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, within_score double, classes binary"


def _classed(total: int, distinct: int, bucket_sizes: np.ndarray):
    """Of one block: documents as classes, with the base score and the part of the score within buckets."""

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("idx")
        c, cls = words["c"].to_numpy(), words["cls"].to_numpy()
        base = np.log10((c + 1) / (total + distinct + 1))
        rare = (cls >= WORDS) & (cls < END)
        within = np.where(rare, np.log10((c + 1) / bucket_sizes[np.where(rare, cls - WORDS, 0)]), 0.0)
        out = []
        for doc_id, held, ids in zip(docs["doc_id"], docs["held_out"], docs["ids"]):
            x = np.append(np.frombuffer(ids, np.uint32), np.uint32(0))
            out.append((doc_id, held, len(x), int((c[x] > 0).sum()), base[x].sum(), within[x].sum(), cls[x].astype(np.uint16).tobytes()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _CLASSED.split(", ")])

    return run


class LogBilinear:
    """Context vectors for one and two tokens back, class vectors and biases, as rows of one matrix."""

    def __init__(self, rows: np.ndarray):
        rows = rows.astype(np.float32)
        self.back1, self.back2, self.target, self.bias = (np.ascontiguousarray(rows[:, k * VECTOR : (k + 1) * VECTOR]) for k in (0, 1, 2, 3))
        self.bias = np.ascontiguousarray(rows[:, 3 * VECTOR])

    @classmethod
    def start(cls, unigram: np.ndarray) -> LogBilinear:
        draw = np.random.default_rng(11).standard_normal((CLASSES + 1, 3 * VECTOR)) * 0.05
        return cls(np.column_stack([draw, np.append(np.log(unigram), -30)]))

    def rows(self) -> np.ndarray:
        return np.column_stack([self.back1, self.back2, self.target, self.bias]).astype(np.float64)

    def train(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray, unigram: np.ndarray, draw: np.random.Generator) -> None:
        """Noise-contrastive steps; a batch shares its noise classes, so that their scores are one matrix product."""
        noise_cdf = np.cumsum(unigram)
        offset = np.log(NOISE * unigram).astype(np.float32)
        if not hasattr(self, "squares"):
            self.squares = [np.full(p.shape, 1e-2, np.float32) for p in (self.back1, self.back2, self.target, self.bias)]
        for a in range(0, len(tokens), BATCH):
            w, c1, c2 = tokens[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH]
            noise = np.minimum(np.searchsorted(noise_cdf, draw.random(NOISE)), CLASSES - 1)
            context = self.back1[c1] + self.back2[c2]
            target, noisy = self.target[w], self.target[noise]
            gain = 1 / (1 + np.exp(np.clip((context * target).sum(axis=1) + self.bias[w] - offset[w], -30, 30)))
            loss = -1 / (1 + np.exp(-np.clip(context @ noisy.T + (self.bias[noise] - offset[noise]), -30, 30)))
            d_context = gain[:, None] * target + loss @ noisy
            d_target = _scattered(w, gain[:, None] * context)
            np.add.at(d_target, noise, loss.T @ context)
            d_bias = np.bincount(w, gain, CLASSES + 1) + np.bincount(noise, loss.sum(axis=0), CLASSES + 1)
            steps = (_scattered(c1, d_context), _scattered(c2, d_context), d_target, d_bias)
            for parameter, square, step in zip((self.back1, self.back2, self.target, self.bias), self.squares, steps):
                step = (step / len(w)).astype(np.float32)
                square += step * step
                parameter += RATE * step / np.sqrt(square)

    def log_probabilities(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of the normalised class probabilities, by distinct context."""
        codes, at = np.unique(one.astype(np.int64) * (CLASSES + 1) + two, return_inverse=True)
        a, b = codes // (CLASSES + 1), codes % (CLASSES + 1)
        norm = np.empty(len(codes))
        for k in range(0, len(codes), 4096):
            context = self.back1[a[k : k + 4096]] + self.back2[b[k : k + 4096]]
            logits = context @ self.target[:CLASSES].T + self.bias[:CLASSES]
            top = logits.max(axis=1)
            norm[k : k + 4096] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
        out = np.empty(len(tokens))
        for k in range(0, len(tokens), 1 << 18):
            s = slice(k, k + (1 << 18))
            context = self.back1[one[s]] + self.back2[two[s]]
            out[s] = (context * self.target[tokens[s]]).sum(axis=1) + self.bias[tokens[s]] - norm[at[s]]
        return out


def _scattered(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], CLASSES + 1) for k in range(values.shape[1])], axis=1)


def contexts(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of documents end to end, one and two tokens back, and the documents' offsets."""
    parts = [np.frombuffer(d, np.uint16) for d in docs]
    tokens = np.concatenate(parts).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    one = np.concatenate(([START], tokens[:-1]))
    one[offsets[:-1]] = START
    two = np.concatenate(([START], one[:-1]))
    two[offsets[:-1]] = START
    return tokens, one, two, offsets


def _trained(rows: np.ndarray, unigram: np.ndarray, seed: int):
    """Over rows that come sorted by shard: the shards' parameters times their tokens, summed, by row; the tokens are the row's last value."""

    def shards(batches):
        shard, held, size = None, [], 0
        for batch in batches:
            for number, classes in zip(batch.column("shard").to_pylist(), batch.column("classes").to_pylist()):
                if held and (number != shard or size >= STEP_TOKENS):
                    yield shard, held
                    held, size = [], 0
                shard = number
                held.append(classes)
                size += len(classes) >> 1
        if held:
            yield shard, held

    def run(batches):
        total = 0
        for shard, steps in groupby(shards(batches), key=lambda x: x[0]):
            model, seen, draw = LogBilinear(rows), 0, np.random.default_rng([seed, shard])
            for _, docs in steps:
                tokens, one, two, _ = contexts(docs)
                mixed = draw.permutation(len(tokens))
                model.train(tokens[mixed], one[mixed], two[mixed], unigram, draw)
                seen += len(tokens)
            total = total + np.column_stack([model.rows(), np.ones(len(rows))]) * seen
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _row_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(pdf["row"].tolist(), axis=0)]})


def _scored(rows: np.ndarray, total: int):
    def run(batches):
        model = LogBilinear(rows)
        for batch in batches:
            tokens, one, two, offsets = contexts(batch.column("classes").to_pylist())
            logs = np.add.reduceat(model.log_probabilities(tokens, one, two), offsets[:-1]) / np.log(10)
            score = logs + batch.column("within_score").to_numpy()
            kept = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([total] * len(score), pa.int64()), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "train_tokens", "score"])

    return run


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; held_out is a column that tells which rows not to learn from."""
    spark = docs.sparkSession
    encoded = materialise(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(_encoded, _ENCODED), "encoded")
    own = encoded.where("words IS NOT NULL").select("block", "train", "buckets", F.posexplode(F.split("words", " ", -1)).alias("idx", "word"))
    counted = own.select("word", F.col("train")[F.col("idx")].alias("n"), F.col("buckets")[F.col("idx")].alias("bucket"))
    counted = materialise(counted.groupBy("word").agg(F.sum("n").alias("c"), F.min("bucket").alias("bucket")), "counted")  # equal words have equal buckets

    frequent = counted.where("word <> '' AND c > 0").orderBy(F.desc("c"), "word").select("word").limit(WORDS).collect()
    ranked = spark.createDataFrame([(r["word"], k) for k, r in enumerate(frequent)], "word string, rank int")  # WORDS rows at most
    cls = F.when(F.col("word") == "", END).otherwise(F.coalesce("rank", F.col("bucket") + WORDS))
    known = counted.join(F.broadcast(ranked), "word", "left").select("word", cls.alias("cls"), "c")
    parts = parts_for(encoded)
    classes = own.select("block", "idx", "word").join(known, "word").select("block", "idx", "cls", "c")

    sums = known.groupBy("cls").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).collect()  # a row a class
    total, distinct = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    bucket_sizes, unigram = np.ones(BUCKETS), np.full(CLASSES, 0.5)
    for r in sums:
        unigram[r["cls"]] += r["n"]
        if WORDS <= r["cls"] < END:
            bucket_sizes[r["cls"] - WORDS] = r["n"] + r["v"] + 1
    unigram /= unigram.sum()

    texts = encoded.where("words IS NULL").select(F.col("block").alias("of"), F.col("doc_id").cast("string").alias("doc_id"), "held_out", "ids")  # text, as pandas has no long with nulls
    grouped = texts.repartition(parts, "of").groupBy("of").cogroup(classes.repartition(parts, "block").groupBy("block"))
    classed = materialise(grouped.applyInPandas(_classed(total, distinct, bucket_sizes), _CLASSED), "classed")
    discard(encoded, counted)

    rows = LogBilinear.start(unigram).rows()
    shards = min(MOST_SHARDS, -(-total // SHARD_TOKENS))
    order = F.xxhash64("doc_id", "classes")
    dealt = classed.where("NOT held_out").select("classes", order.alias("order"), F.pmod(F.shiftright(order, 8), F.lit(max(1, shards))).alias("shard"))
    for k in range(ROUNDS if total else 0):
        turn = dealt.where(F.pmod("order", F.lit(ROUNDS)) == k).repartition(shards, "shard").sortWithinPartitions("shard", "order")
        parts = turn.select("shard", "classes").mapInArrow(_trained(rows, unigram, k), "i int, row array<double>")
        some = parts.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(64)).alias("k")).applyInPandas(_row_sum, "i int, row array<double>")
        summed = sorted((r["i"], r["row"]) for r in some.groupBy("i").applyInPandas(_row_sum, "i int, row array<double>").collect())  # a row a class
        if summed:
            values = np.array([r for _, r in summed])
            rows = values[:, :-1] / values[:, -1:]
    out = classed.mapInArrow(_scored(rows, total), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
