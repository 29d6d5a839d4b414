"""Quality classifier: kernel ridge regression through random Fourier features, isotonic calibration.

A text becomes document statistics (STATISTICS). Random Fourier features of the standardised
statistics approximate a Gaussian kernel; each partition sums its share of the normal equations,
which are as large as the number of features, and the ridge solution scores every document. Held-apart
labelled rows then say, bin by bin, how often a score means label 1, and pool-adjacent-violators
makes that a rising function from scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta
from foliospark.llm.language import crc_bucket
from foliospark.storage import Scratch

STATISTICS = ("log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "punctuation", "symbol", "blank", "wide", "line_breaks", "distinct_words", "distinct_pairs", "repeated_next", "bare_words", "sentence_ends", "capitals", "longest_repeat")
FEATURES, RIDGE, WIDTH, SEED = 256, 1e-5, 3.0, 17
#: The bounded sample of labelled rows that is fitted, and the partitions that sum it.
SAMPLE_ROWS, SAMPLE_PARTS = 100_000, 16
BINS = 1000
THRESHOLD = 0.3

_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = True
_CLASSES[3, list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_CLASSES[4] = ta.SPACE
_CLASSES[5, 128:] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return np.bincount(rows[new], minlength=n)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(STATISTICS)); an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    words = ta.Words(buf, offsets)
    count = words.counts
    some, many = np.maximum(size, 1), np.maximum(count, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    length = (words.ends - words.starts).astype(float)
    out[:, 2] = _sums(length, words.bounds) / many
    out[:, 3] = np.sqrt(np.maximum(0, _sums(length**2, words.bounds) / many - out[:, 2] ** 2))
    for k in range(6):
        out[:, 4 + k] = _sums(_CLASSES[k][buf], offsets) / some
    out[:, 10] = _sums(buf == 10, offsets) / many
    h, rows = words.hashes, words.rows()
    if len(h):
        out[:, 11] = _distinct(h, rows, n) / many
        pair = rows[1:] == rows[:-1]
        out[:, 12] = _distinct(ta.mix(h[:-1] * np.uint64(3) + h[1:])[pair], rows[:-1][pair], n) / np.maximum(count - 1, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & pair
        out[:, 13] = _sums(same, words.bounds) / many
        letters = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_LETTER[buf], out=letters[1:])
        out[:, 14] = _sums(letters[words.ends] == letters[words.starts], words.bounds) / many
        out[:, 15] = _sums(np.isin(buf[words.ends - 1], [33, 46, 63]), words.bounds) / many
        first = buf[words.starts]
        out[:, 16] = _sums(((first >= 65) & (first <= 90)) | (first == 0xC3), words.bounds) / many
        heads = np.flatnonzero(~same)
        runs = np.diff(np.append(heads, len(h)))
        np.maximum.at(out[:, 17], rows[heads], np.log1p(runs))
    return out


@dataclass
class Model:
    """Standardisation, projection, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    to: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.to), 0, 1) if len(self.at) else np.full(len(x), 0.5)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random features whose products approximate exp(-|z - w|^2 / (2 WIDTH^2)), and a constant."""
    rng = np.random.default_rng(SEED)
    directions, phases = rng.normal(size=(z.shape[1], FEATURES - 1)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES - 1)
    out = np.ones((len(z), FEATURES))
    out[:, 1:] = np.sqrt(2 / (FEATURES - 1)) * np.cos(np.clip(z, -8, 8) @ directions + phases)
    return out


def isotonic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: positions and rising shares of ones."""
    blocks: list[list[float]] = []
    for at, y, w in zip(x, ones, n, strict=True):
        blocks.append([y, w, at * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and stats (STATISTICS in order) of every whole text; a null text counts as empty.

    Repeated rows give equal rows; extra columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = ta.column(batch.column(1))
            for a, b in ta.row_slices(offsets):
                x = statistics(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["doc_id", "stats"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, stats array<double>")


def fit(measured: DataFrame, labels: DataFrame, learn: Column, scratch: Scratch) -> Model:
    """A model from the rows of labels (doc_id, quality 0 or 1) for which ``learn`` over doc_id holds.

    At most about SAMPLE_ROWS of them are drawn, by a hash of doc_id; a fourth of these calibrate. Of several labels of a
    document the greatest counts; without labels nothing is learned.
    """
    known = labels.where(learn & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("double").alias("y"))
    total = known.count()
    share = min(1.0, SAMPLE_ROWS / total) if total else 0.0
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)))
    rows = scratch.write(measured.join(drawn, F.col("doc_id") == F.col("id")).select("stats", "y", "part").repartition(SAMPLE_PARTS), "labelled")
    d = len(STATISTICS)
    sums = rows.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).collect()
    mean, scale = np.zeros(d), np.ones(d)
    for r in sums:
        mean[r[0]], scale[r[0]] = r[1], r[2] or 1.0
    model = Model(mean, np.maximum(scale, 1e-9), np.zeros(FEATURES), np.zeros(0), np.zeros(0))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((FEATURES, FEATURES)), np.zeros(FEATURES), 0
        for batch in batches:
            f, y = model.features(_matrix(batch.column(0))), np.asarray(batch.column(1))
            left, right, n = left + f.T @ f, right + f.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([n])], ["a", "b", "n"])

    parts = rows.where("part <> 0").select("stats", "y").mapInArrow(partial, "a binary, b binary, n long").collect()  # SAMPLE_PARTS rows at most
    if not parts:
        return model
    n = sum(r[2] for r in parts)
    left = sum(np.frombuffer(r[0]).reshape(FEATURES, FEATURES) for r in parts)
    right = sum(np.frombuffer(r[1]) for r in parts)
    model.weights = np.linalg.solve(left + RIDGE * n * np.eye(FEATURES), right)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(model.raw(_matrix(batch.column(0))), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((s + 1) / 3 * BINS).astype(np.int64)), batch.column(1)], ["bin", "y"])

    bins = rows.select("stats", "y", "part").where("part = 0").select("stats", "y").mapInArrow(scored, "bin long, y double").groupBy("bin").agg(F.sum("y"), F.count("*")).orderBy("bin").collect()
    if bins:
        at = np.array([r[0] for r in bins]) / BINS * 3 - 1
        model.at, model.to = isotonic(at, np.array([r[1] for r in bins]), np.array([float(r[2]) for r in bins]))
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id and score from 0 to 1; 0.5 for all if nothing was learned. Rows repeated give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id long, score double")


def op4_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole documents table; a null doc_id counts as not held out."""
    scratch = Scratch(spark, "quality")
    measured = scratch.write(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measured")
    model = fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_bucket("doc_id", 5) != 0, scratch)
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return score(measured, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
