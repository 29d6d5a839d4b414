"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

Sketch: T coordinates are filled in rounds. In round i < T every shingle is thrown into one of the
T bins by a hash and a bin that is still empty keeps the smallest value thrown into it; in round
T + b all shingles go to bin b. So all bins are filled after 2 T rounds whatever a document's size,
long documents are done after one, and coordinates agree with the probability of the Jaccard
similarity, as concentrated as independent ones (fast similarity sketching).

Banding: BANDS runs of ROWS coordinates; at similarity 0.75 a pair shares no band with probability
(1 - 0.75 ** 4) ** 32 < 6e-6. Bands only nominate: every link is confirmed on full shingle sets.

Documents with equal sets are one class. A bucket's centre is the class that shares most buckets, and
every class is compared with its best centre; buckets whose members are then still in several
components take their centre's own best centre as reference (twice, so that a group of copies meets
at its original), and all members are compared with it. So groups of copies close with comparisons in
proportion to their size.

What is left are buckets that hold several components for good: documents made of the same passages,
say, of which any two may share a band by chance. Their members are sketched again, with SHARP_BANDS
runs of SHARP_ROWS coordinates, which pairs of little similarity seldom share (at 0.33: 0.04 instead of
0.3); a linked pair shares none with probability (1 - 0.75 ** 7) ** 96 < 2e-6. Of the pairs of two
components that share a sharp band, those are compared that can be linked: x and y of one reference c
have at most min(|x and c|, |y and c|) shingles in common there, and outside c at most as many as the
bits that both set in a mask of MASK longs, and those that fell on one bit. No bucket is expanded into
all its pairs; what is compared at last follows the number of pairs that are almost linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta
from foliospark.operators.components import connected_components
from foliospark.storage import Scratch

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
T = BANDS * ROWS
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bands of the second sketch, which only documents take whose buckets hold several components.
SHARP_BANDS, SHARP_ROWS = 96, 7
#: Longs of the mask of a document's shingles that its reference has not.
MASK = 16
#: Bytes of shingle sets that are sketched so at once: a set of few shingles has 5 kB of coordinates.
SHARP_BYTES = 1 << 19
#: Bits of the filter that spares the texts of documents without any shared bucket.
BITMAP = 1 << 26

_U = np.uint64


def sketch(hashes: np.ndarray, bounds: np.ndarray, t: int = T) -> np.ndarray:
    """(rows, t) coordinates of sets given as flat distinct hashes; rows of empty sets are all ones."""
    n = len(bounds) - 1
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, empty, _U)
    row = np.repeat(np.arange(n), np.diff(bounds))
    x = hashes
    seeds = ta.numbers(101, 2 * t)
    unfilled = np.full(n, t)
    for i in range(2 * t):
        if not len(x):
            break
        v = ta.mix(x ^ seeds[i])
        place = row * t + (((v >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else i - t)
        free = out[place] == empty
        place = place[free]
        np.minimum.at(out, place, ta.mix(v[free]))
        unfilled -= np.bincount(np.unique(place) // t, minlength=n)
        keep = unfilled[row] > 0
        x, row = x[keep], row[keep]
    return out.reshape(n, t)


def bands(coordinates: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(rows, count) hashes of the bands of each sketch."""
    weights = ta.numbers(303, rows) | _U(1)
    parts = (coordinates.reshape(len(coordinates), count, rows) * weights).sum(2, dtype=_U)
    return ta.mix(parts ^ ta.numbers(404, count))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat distinct shingle hashes and bounds for each text."""
    return ta.distinct(*ta.shingles(ta.Words(buf, offsets), SHINGLE_WORDS), len(offsets) - 1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets, _ = ta.column(batch.column(1))
        for a, b in ta.row_slices(offsets):
            h, bounds = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            sums = [np.zeros(b - a, _U), np.zeros(b - a, _U)]
            for k in range(2):
                if len(full):
                    sums[k][full] = np.add.reduceat(ta.mix(h ^ ta.numbers(505 + k, 1)), bounds[full])
            named = bands(sketch(h, bounds))
            named = named[full].ravel()
            lengths = np.zeros(b - a + 1, np.int64)
            np.cumsum(np.where(sizes > 0, BANDS, 0), out=lengths[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), ta.signed(sums[0]), ta.signed(sums[1]), ta.lists(named, lengths, pa.int64())],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def _filtered(bits: bytes):
    """Sets of the rows whose slot is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits, np.uint8)
        for batch in batches:
            slot = np.asarray(batch.column(2)).astype(np.int64)
            picked = np.flatnonzero((wanted[slot >> 3] >> (slot & 7)) & 1)
            buf, offsets, _ = ta.column(batch.column(1).take(pa.array(picked)))
            ids = batch.column(0).take(pa.array(picked))
            for a, b in ta.row_slices(offsets):
                h, bounds = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([raw[8 * i : 8 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["id", "shingles"])

    return run


def wanted_bits(ids: DataFrame, column: str) -> bytes:
    """A bitmap of BITMAP bits, the same size for any corpus, with the slots of ids set."""
    slot = slot_of(column)
    rows = ids.groupBy(F.shiftright(slot, 15).cast("int").alias("k")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = bytearray(BITMAP // 8)
    for k, bits in rows:
        out[4096 * k : 4096 * k + len(bits)] = bits
    return bytes(out)


def slot_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BITMAP))


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; both are ascending."""
    if not len(y):
        return np.zeros(len(x), bool)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def _mask(own: np.ndarray) -> np.ndarray:
    """MASK longs with a bit set for each hash."""
    place = ta.mix(own ^ ta.numbers(606, 1)) % _U(64 * MASK)
    out = np.zeros(MASK, _U)
    np.bitwise_or.at(out, (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, m, linked, n, inter, mask) of pairs with both sets: m's size, what it shares with c, and the mask of the rest."""
    for batch in batches:
        c, m, cs, ms = (batch.column(k) for k in range(4))
        sizes, inters, linked, masks = [], [], [], []
        for k in range(batch.num_rows):
            x, y = np.frombuffer(cs[k].as_buffer(), _U), np.frombuffer(ms[k].as_buffer(), _U)
            here = _common(y, x)
            both = int(here.sum())
            sizes.append(len(y))
            inters.append(both)
            linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            masks.append(_mask(y[~here]))
        flat = np.concatenate([*masks, np.zeros(0, _U)])
        yield pa.RecordBatch.from_arrays([c, m, pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(inters, pa.int64()), ta.lists(flat, np.arange(batch.num_rows + 1) * MASK, pa.int64())], ["c", "m", "linked", "n", "inter", "mask"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (c, m) compared on their full shingle sets."""
    left, right = sets.select(F.col("id").alias("ic"), F.col("shingles").alias("xc")), sets.select(F.col("id").alias("im"), F.col("shingles").alias("xm"))
    both = pairs.join(right, F.col("m") == F.col("im")).join(left, F.col("c") == F.col("ic")).select("c", "m", "xc", "xm")
    return both.mapInArrow(ta.tidy(_compare), "c long, m long, linked boolean, n long, inter long, mask array<long>")


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select("c", "m")


def _sharp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, keys): the sharp bands of sets (id, shingles)."""
    for batch in batches:
        buf, offsets, _ = ta.column(batch.column(1))
        for a, b in ta.row_slices(offsets, SHARP_BYTES):
            h, bounds = np.frombuffer(buf[offsets[a] : offsets[b]].tobytes(), _U), (offsets[a : b + 1] - offsets[a]) // 8
            named = bands(sketch(h, bounds, SHARP_BANDS * SHARP_ROWS), SHARP_BANDS, SHARP_ROWS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), ta.lists(named.ravel(), np.arange(b - a + 1) * SHARP_BANDS, pa.int64())], ["id", "n", "keys"])


def across(known: DataFrame, sets: DataFrame, profile: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (c, m) that can be linked, of two components and with a sharp band in common.

    known: bucket, m, comp of all buckets that may hold several components; profile: comparisons with
    references. A document's reference is the one that most documents have, itself if it has none.
    """
    open_ = known.join(_several(known, "bucket"), F.col("bucket") == F.col("bucket_")).select("m", "comp").distinct()
    usual = profile.groupBy(F.col("c").alias("usual_c")).agg(F.count("*").alias("members"))
    best = profile.join(usual, F.col("c") == F.col("usual_c")).groupBy(F.col("m").alias("m_")).agg(F.max_by(F.struct("c", "inter", "mask"), F.struct("members", -F.col("c"))).alias("ref"))
    sharp = sets.join(open_, F.col("id") == F.col("m"), "left_semi").select("id", "shingles").mapInArrow(ta.tidy(_sharp), "id long, n long, keys array<long>")
    sharp = sharp.join(open_, F.col("id") == F.col("m")).join(best, F.col("id") == F.col("m_"), "left")
    own = F.struct(F.col("id").alias("c"), F.col("n").alias("inter"), F.array_repeat(F.lit(0).cast("long"), MASK).alias("mask"))
    sharp = scratch.write(sharp.withColumn("ref", F.coalesce("ref", own)).select("id", "n", "comp", "ref.*", "keys"), "sharp")
    keys = sharp.select("id", "comp", F.explode("keys").alias("key"))
    counts = keys.groupBy(F.col("key").alias("key_"), "comp").agg(F.count("*").alias("k"))
    shared = counts.groupBy("key_").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("key_", "main")
    keys = keys.join(scratch.write(shared, "sharp_several"), F.col("key") == F.col("key_")).select("key", "id", "main")
    held = sharp.select(F.col("id").alias("id_"), "n", "comp", "c", "inter", "mask", (F.col("n") - F.col("inter") - sum(F.bit_count(F.get("mask", F.lit(k))) for k in range(MASK))).alias("spare"))
    keyed = scratch.write(keys.join(held, F.col("id") == F.col("id_")).drop("id_"), "sharp_shared")
    # x is never of the component that holds most of the key, so that a large group is not joined with itself
    x, y = (rows.select(*[F.col(name).alias(f"{side}_{name}") for name in keyed.columns]) for side, rows in (("x", keyed.where("comp <> main")), ("y", keyed)))
    sizes = F.col("x_n") + F.col("y_n")
    outside = sum(F.bit_count(F.get("x_mask", F.lit(k)).bitwiseAND(F.get("y_mask", F.lit(k)))) for k in range(MASK)) + F.least("x_spare", "y_spare")
    most = F.when(F.col("x_c") == F.col("y_c"), F.least(F.least("x_inter", "y_inter") + outside, "x_n", "y_n")).otherwise(F.least("x_n", "y_n"))
    once = (F.col("y_comp") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
    near = (F.col("x_key") == F.col("y_key")) & (F.col("x_comp") != F.col("y_comp")) & once & ((100 + PERCENT) * most >= PERCENT * sizes)
    return scratch.write(x.join(y, near).select(F.least("x_id", "y_id").alias("c"), F.greatest("x_id", "y_id").alias("m")).distinct(), "across")


def _several(known: DataFrame, key: str) -> DataFrame:
    """The keys whose members are in more than one component."""
    return known.groupBy(F.col(key).alias(f"{key}_")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(f"{key}_")


def _labelled(df: DataFrame, node: str, labels: DataFrame, name: str) -> DataFrame:
    """df with a node's component; a node without links is its own."""
    known = labels.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(f"{name}_found"))
    return df.join(known, F.col(node) == known[f"{name}_node"], "left").withColumn(name, F.coalesce(f"{name}_found", node)).drop(f"{name}_node", f"{name}_found")


def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that can be reached over links between documents whose sets
    of five-word shingles have a Jaccard similarity of 0.75 or more; kept marks that document.

    A text that is null, empty or without words has no shingles and is linked with nothing. A row
    without doc_id takes its class's component, or none if no copy has an id, and is kept only then.
    Rows repeated with one doc_id and text are all kept or all dropped together; rows of one doc_id
    with different texts are one node. Ties go to the smaller id. Extra columns are not read; an
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "near-duplicates")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.write(docs.mapInArrow(ta.tidy(_sketches), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signed")
    key = ["set_a", "set_b", "n_shingles"]
    reps = scratch.write(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "reps")

    entries = reps.select(F.col("rep").alias("m"), F.explode("bands").alias("bucket"))
    shared = scratch.write(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("bucket", "bucket_"), "shared")
    members = scratch.write(entries.join(shared, F.col("bucket") == F.col("bucket_")).select("bucket", "m", "size"), "members")
    weight = scratch.write(members.groupBy(F.col("m").alias("m_")).agg(F.sum("size").alias("weight")), "weight")
    weighed = members.join(weight, F.col("m") == F.col("m_")).select("bucket", F.struct("weight", (-F.col("m")).alias("c")).alias("w"))
    centres = scratch.write(weighed.groupBy(F.col("bucket").alias("bucket_")).agg(F.max("w").alias("w")), "centres")
    placed = members.join(centres, F.col("bucket") == F.col("bucket_")).select("bucket", "m", (-F.col("w.c")).alias("c"), F.col("w.weight").alias("weight"))
    placed = scratch.write(placed, "placed")
    bits = wanted_bits(weight, "m_")
    sets = scratch.write(docs.where("doc_id is not null").withColumn("slot", slot_of("doc_id")).mapInArrow(ta.tidy(_filtered(bits)), "id long, shingles binary"), "sets")

    best = placed.where("c <> m").groupBy("m").agg(F.max(F.struct("weight", (-F.col("c")).alias("c"))).alias("w")).select((-F.col("w.c")).alias("c"), "m")
    best = scratch.write(best, "best")
    links = scratch.write(_linked(_compared(best, sets)), "links")
    labels = connected_components(links, "c", "m", scratch, "first")

    known = scratch.write(_labelled(placed, "m", labels, "comp"), "known")
    several = scratch.write(_several(known, "bucket"), "several")
    rest = known.join(several, F.col("bucket") == F.col("bucket_")).select("c", "m").distinct()
    hop = best.select(F.col("m").alias("from_"), F.col("c").alias("hop"))
    for _ in range(2):
        rest = rest.join(hop, F.col("c") == F.col("from_"), "left").select(F.coalesce("hop", "c").alias("c"), "m")
    rest = rest.where("c <> m").distinct()
    profile = scratch.write(_compared(rest, sets), "profile")
    links = scratch.write(links.union(_linked(profile)).distinct(), "links2")
    labels = connected_components(links, "c", "m", scratch, "second")

    known = scratch.write(_labelled(placed.select("bucket", "m").join(several, F.col("bucket") == F.col("bucket_"), "left_semi"), "m", labels, "comp"), "known2")
    more = scratch.write(_linked(_compared(across(known, sets, profile, scratch), sets)), "more")
    if not more.isEmpty():
        labels = connected_components(links.union(more), "c", "m", scratch, "third")
    scratch.drop("shared", "members", "weight", "centres", "placed", "best", "sets", "known", "several", "known2", "profile", "sharp", "sharp_several", "sharp_shared", "across")

    classes = reps.select(F.col("set_a").alias("a_"), F.col("set_b").alias("b_"), F.col("n_shingles").alias("n_"), "rep")
    classes = scratch.write(_labelled(classes, "rep", labels, "comp"), "classes")
    found = signed.drop("bands").join(classes, (F.col("set_a") == F.col("a_")) & (F.col("set_b") == F.col("b_")) & (F.col("n_shingles") == F.col("n_")), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole documents table."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that repeat or nearly repeat another: the smallest id of each group stays.

    Rows without doc_id stay unless a kept document holds the same text. Columns stay as they are.
    """
    gone = near_duplicates(spark, docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
