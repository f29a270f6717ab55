"""Quality classifier: random Fourier features on document statistics, ridge by normal equations, isotonic calibration.

Statistics are of whole texts. FEATURES random cosines approximate a Gaussian kernel on the standardised
statistics; every task sums its rows' normal equations, and the sums meet row by row of the matrix, so neither a
group nor the driver ever holds rows. Labelled rows are fitted with weight balance between the classes; an eighth
of them, which ridge has not seen, calibrates the scores by pool-adjacent-violators over BINS score bins.

A bounded sample of at most about MOST_LABELLED labelled rows is fitted (all of them while there are fewer). Labels
of rows whose crc32(doc_id) mod 4 is 2 are never used.

Edge cases: null or empty text has statistics 0 and is scored as such; a null doc_id is scored, never learned from;
several labels of one doc_id count by their mean; without any usable label the score is 0.5; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, texts_of

FEATURES, WIDTH, RIDGE, BINS = 192, 3.0, 1e-3, 512
MOST_LABELLED = 400_000
KEEP = 0.7

STATISTICS = ["words", "chars", "word_length", "long_words", "capitals", "digits", "symbols", "bars", "bangs", "stops", "other_bytes", "lines", "repeated_lines", "repeated_words", "repeated_runs", "stutters", "line_words"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([_class(c) for c in (bytes(range(65, 91)), b"0123456789", b"#*$%&<>@^~_=+\\{}[]", b"|", b"!", b".,;:?", bytes(range(128, 256)))], axis=1)


def statistics(text: bytes) -> list[float]:
    """STATISTICS of one text; shares are of words, letters or lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    capitals, digits, symbols, bars, bangs, stops, other = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    runs = [hash(x) for x in zip(words, words[1:], words[2:], words[3:])]
    return [
        np.log1p(n), np.log1p(size), lengths.sum() / n, (lengths > 12).sum() / n, capitals / size, digits / size, min(symbols / n, 3.0), min(bars / n, 3.0), min(bangs / n, 3.0), stops / n, other / size,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), 1 - len(set(words)) / n, 1 - len(set(runs)) / len(runs) if runs else 0.0, sum(map(bytes.__eq__, words, words[1:])) / n, np.log1p(n / len(lines)),
    ]


def _measured(batches):
    for batch in batches:
        values = [statistics(t) for t in texts_of(batch)]
        kept = [batch.column(c) for c in ("doc_id", "fold")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.list_(pa.float64()))], ["doc_id", "fold", "x"])


class Fourier:
    """z(x) = sqrt(2 / D) cos(W x + b) on standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        draw = np.random.default_rng(7)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = draw.standard_normal((len(mean), FEATURES)) / WIDTH
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z / 8, np.ones((len(x), 1))], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _normal_equations(fourier: Fourier, balance: tuple[float, float]):
    """Per task, rows (i, i-th row of Z'Z and of Z'y)."""

    def run(batches):
        total = None
        for batch in batches:
            z, y = fourier(_matrix(batch)), batch.column("y").to_numpy()
            weighted = z * (balance[1] * y + balance[0] * (1 - y))[:, None]
            part = np.column_stack([weighted.T @ z, weighted.T @ y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _row_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(pdf["row"].tolist(), axis=0)]})


def _summed(parts: DataFrame) -> DataFrame:
    """Sums of the tasks' rows: first of up to 64 tasks together, then of all."""
    some = parts.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(64)).alias("k")).applyInPandas(_row_sum, "i int, row array<double>")
    return some.groupBy("i").applyInPandas(_row_sum, "i int, row array<double>")


def isotonic(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, weight, sum of labels) in order of score: scores and rising probabilities."""
    blocks: list[list] = []
    for s, w, y in bins:
        blocks.append([[s], w, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    x = [s for b in blocks for s in b[0]]
    p = [(b[2] + 0.5) / (b[1] + 1) for b in blocks for _ in b[0]]
    return np.array(x), np.maximum.accumulate(np.array(p)) if p else np.array(p)


class Model:
    """Statistics to scores: random features, ridge weights, calibration; without a fit every score is 0.5."""

    def __init__(self, fourier: Fourier | None = None, beta: np.ndarray | None = None):
        self.fourier, self.beta = fourier, beta
        self.x, self.p = np.zeros(1), np.full(1, 0.5)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta if self.fourier else np.zeros(len(x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.x, self.p), 0, 1)


def _applied(model: Model):
    def run(batches):
        for batch in batches:
            x = _matrix(batch)
            kept = [batch.column(c) for c in ("doc_id", "fold")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.raw(x)), pa.array(model.scores(x))], ["doc_id", "fold", "raw", "score"])

    return run


_SCORED = "doc_id long, fold int, raw double, score double"


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, x) per row: fold 2 is held out, 1 calibrates, 0 is fitted, -1 has no doc_id."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    fold = F.when(F.col("doc_id").isNull(), -1).when(crc % 4 == 2, 2).when(F.floor(crc / 4) % 8 == 0, 1).otherwise(0)
    return docs.select("doc_id", fold.cast("int").alias("fold"), "text").mapInArrow(_measured, "doc_id long, fold int, x array<double>")


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """Learn from the measured rows outside the held-out fold that have a label."""
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    learned = materialise(measured.where("fold IN (0, 1)").join(truth, "doc_id").select("doc_id", "fold", "x", "y"), "labelled")
    by_fold = lambda rows: rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).collect()
    seen = by_fold(learned)
    total = sum(r["n"] for r in seen)
    if total > MOST_LABELLED:
        learned = learned.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MOST_LABELLED / total))
        seen = by_fold(learned)  # the ridge and the balance are those of the rows that are fitted
    rows, hold = learned.where("fold = 0"), learned.where("fold = 1")
    n, good = next(((r["n"], r["good"]) for r in seen if r["fold"] == 0), (0, 0))
    if not n:
        return Model()

    at = range(len(STATISTICS))
    moments = rows.agg(*[F.avg(F.col("x")[k]).alias(f"m{k}") for k in at], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in at]).first()
    fourier = Fourier(np.array([moments[f"m{k}"] for k in at]), np.array([moments[f"s{k}"] for k in at]))
    balance = (n / max(2 * (n - good), 1), n / max(2 * good, 1))
    sums = _summed(rows.select("x", "y").mapInArrow(_normal_equations(fourier, balance), "i int, row array<double>")).collect()  # as many rows as features
    system = np.array([r["row"] for r in sorted(sums, key=lambda r: r["i"])])
    model = Model(fourier, np.linalg.solve(system[:, :-1] + RIDGE * n * np.eye(len(system)) / len(system), system[:, -1]))

    raw = hold.select("doc_id", "fold", "x", "y").mapInArrow(_held(model), "raw double, y double")
    binned = raw.groupBy(F.round(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * (BINS / 2)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
    x, p = isotonic(sorted((r["bin"] * 2 / BINS, r["n"], r["good"]) for r in binned.collect()))  # BINS + 1 rows at most
    model.x, model.p = (x, p) if len(x) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def _held(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch))), batch.column("y").cast(pa.float64())], ["raw", "y"])

    return run


def _accepted(model: Model):
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.scores(x) >= KEEP))

    return run


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with predicted 1, unchanged; scored where they are, without a shuffle. All of them if nothing can be learned."""
    model = fit(materialise(measure(docs), "statistics"), labels)
    return docs.mapInArrow(_accepted(model), docs.schema) if model.fourier else docs


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs, learned from labels (doc_id, quality)."""
    measured = materialise(measure(docs), "statistics")
    scored = measured.mapInArrow(_applied(fit(measured, labels)), _SCORED)
    return scored.select("doc_id", (F.col("fold") == 2).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
