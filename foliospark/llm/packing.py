"""Packing by non-negative least squares.

Documents become token ids and a final id; a document longer than a window is cut into whole windows
and a rest. Rests of FINE tokens or more are rounded up to classes of GRAIN tokens, shorter ones are
classes of their own length. All combinations of at most DEPTH classes of whole grains that fill a
window exactly are the columns of a least-squares problem whose right side is the histogram of
classes; its non-negative solution says how often each combination is used. Counts are rounded, cut
to what the histogram holds, and what remains, short pieces too, is packed greedily, largest class
first. Only the histogram and the plan (bounded by the window, not by the corpus) reach the
driver; the pieces find their place from their rank in their class, which is counted in parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta
from foliospark.llm import tokens
from foliospark.storage import Scratch

WINDOW, GRAIN, DEPTH, END_ID = 2048, 16, 3, 1
#: Pieces of fewer tokens take their own length, so that short texts fill a window to its last token.
FINE = 64
#: Pieces ranked by one group of tasks' rows; the number of groups grows with the corpus.
PART = 20_000


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most depth positive units that sum to units."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for u in range(min(left, most), 0, -1):
                if u * (depth - len(head)) >= left:
                    grow((*head, u), left - u, u)

    grow((), units, units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    gram, target = a.T @ a, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = target - gram @ x
        gain[passive] = -np.inf
        k = int(gain.argmax())
        if not gain[k] > tolerance:
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)
            x[at] += step.min() * (s - x[at])
            x[at[x[at] <= 1e-12]] = 0
            if not (gone := at[x[at] == 0]).size:
                gone = at[low]
            passive[gone] = False
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH, grain: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """(combination of classes, repeats) that uses up a histogram: histogram[c] pieces take c of a window's
    len(histogram) - 1 places, c >= 1. Least squares takes the classes that are multiples of grain."""
    left = histogram.astype(np.int64).copy()
    units = len(left) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    if left[units]:
        out.append(((units,), int(left[units])))
        left[units] = 0
    choices = [tuple(u * grain for u in c) for c in combinations(units // grain, depth) if len(c) > 1 and all(left[u * grain] for u in c)]
    if choices:
        a = np.zeros((units + 1, len(choices)))
        for k, c in enumerate(choices):
            for u in c:
                a[u, k] += 1
        x = nnls(a, left.astype(float))
        for k in np.argsort(-x, kind="stable").tolist():
            used, times = np.unique(choices[k], return_counts=True)
            repeats = min(int(x[k] + 0.5), int((left[used] // times).min()))
            if repeats > 0:
                out.append((choices[k], repeats))
                left[used] -= repeats * times
    while left.any():
        combo: list[int] = []
        rest, spare = left.copy(), units
        while spare > 0 and (fits := np.flatnonzero(rest[: spare + 1])).size:
            u = int(fits[-1])
            taken = min(int(rest[u]), spare // u)
            combo += [u] * taken
            rest[u] -= taken
            spare -= u * taken
        used, times = np.unique(combo, return_counts=True)
        repeats = int((left[used] // times).min())
        out.append((tuple(combo), repeats))
        left[used] -= repeats * times
    return out


def _pieces(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            buf, offsets, _ = ta.column(batch.column(1))
            for a, b in ta.row_slices(offsets):
                ids, bounds = encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, bounds[1:], END_ID).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                n = np.diff(bounds)
                parts = -(-n // WINDOW)
                row = np.repeat(np.arange(b - a), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = part * WINDOW
                length = np.minimum(WINDOW, n[row] - start)
                raw = memoryview(ids).cast("B")
                at = (bounds[row] + start).tolist()
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at, length.tolist(), strict=True)]
                out = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row])]
                if with_ids:
                    out.append(pa.array([bytes(raw[4 * x : 4 * (x + y)]) for x, y in zip(at, length.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


class _Places:
    """Where the rank of a piece in its class puts it."""

    def __init__(self, found: list[tuple[tuple[int, ...], int]], units: int):
        self.rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(units + 1)]
        self.upto: list[list[int]] = [[] for _ in range(units + 1)]
        base = 0
        for combo, repeats in found:
            for u in sorted(set(combo)):
                times = combo.count(u)
                start = self.upto[u][-1] if self.upto[u] else 0
                self.rows[u].append((start, base, times, combo.index(u)))
                self.upto[u].append(start + repeats * times)
            base += repeats

    def find(self, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        for u in np.unique(kind).tolist():
            at = np.flatnonzero(kind == u)
            rows = np.array(self.rows[u], np.int64)
            row = rows[np.searchsorted(np.array(self.upto[u], np.int64), rank[at], "right")]
            within = rank[at] - row[:, 0]
            sequence[at] = row[:, 1] + within // row[:, 2]
            slot[at] = row[:, 3] + within % row[:, 2]
        return sequence, slot


def pack(spark: SparkSession, documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of documents and their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``with_ids`` the ids as little-endian unsigned 32-bit numbers.

    A null or empty text has the end id alone. Rows repeated or without doc_id are documents of their
    own. Equal lengths are told apart by doc_id, start and checksum; rows equal in all of these are
    interchangeable. Extra columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "packing")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = scratch.write(docs.mapInArrow(ta.tidy(_pieces(path or tokens.default_path(), with_ids)), schema), "pieces")
    kind = F.when(F.col("length") < FINE, F.col("length")).otherwise(F.ceil(F.col("length") / GRAIN) * GRAIN).cast("int")
    histogram = np.zeros(WINDOW + 1, np.int64)
    for row in pieces.groupBy(kind.alias("kind")).count().collect():  # a row for each class at most
        histogram[row[0]] = row[1]
    places = _Places(plan(histogram, grain=GRAIN), WINDOW)

    parts = int(min(100_000, max(16, histogram.sum() // PART)))
    keyed = pieces.withColumn("kind", kind).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    counted = keyed.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = counted.select(F.col("kind").alias("kind_"), F.col("part").alias("part_"), (F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("kind", "part").orderBy("doc_id", "start", "ids_crc32", "length"))
    ranked = keyed.withColumn("within", within).join(before, (F.col("kind") == F.col("kind_")) & (F.col("part") == F.col("part_")))
    ranked = ranked.select(*pieces.columns, "kind", (F.col("before") + F.col("within") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            sequence, slot = places.find(np.asarray(batch.column(n - 2)).astype(np.int64), np.asarray(batch.column(n - 1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(slot)], [*batch.schema.names[:-2], "sequence_id", "slot"])

    placed = ranked.mapInArrow(ta.tidy(place), schema + ", sequence_id long, slot long")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole documents table."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of docs packed into sequences.

    A null or empty text is one piece of its end id; repeated rows are pieces of their own; extra columns
    are not read; an empty table gives no pieces.
    """
    return pack(spark, docs)
