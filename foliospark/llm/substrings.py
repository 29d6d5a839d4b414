"""Substring dedup by sliding sentence spans.

A text is cut into sentences: runs of words that end with ``. ! ? ; : ,`` or before a line break. More
than QUIET words after the last of these, a run also ends after each word whose hash says so: the same
words are cut at the same places wherever they stand, be the passage cut in mid-sentence or unpunctuated.
From every sentence starts one span: the fewest consecutive sentences, MIN_SENTENCES at least, that
have MIN_WORDS words; at every sentence ends one, chosen likewise backwards. Together they cover each
longer run of sentences exactly, its last ones too. Spans are hashed over their words (in small letters A-Z,
without ASCII punctuation), joined over all documents, and every sentence that a span covers is removed unless the span is its hash's first, in
order of doc_id and place. So a passage stays where it stands first and goes everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta
from foliospark.storage import Scratch

MIN_SENTENCES, MIN_WORDS = 3, 20
#: Words without an end of sentence after which words end one by their hash, one word in ONE_IN.
QUIET, ONE_IN = 8, 4

_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?;:,")] = True


class Sentences:
    """Sentences of a block of texts and the spans that start or end at them.

    first: the word each sentence starts with; row: its text; bounds: sentences of row i are
    bounds[i]:bounds[i + 1]; at, upto, hashes: the span from sentence at[k] to before upto[k], ascending;
    spans of row i are spans[i]:spans[i + 1].
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        words = ta.Words(buf, offsets, bare=True)
        n = len(words.starts)
        self.words = words
        if not n:
            self.first = self.row = self.at = self.upto = np.zeros(0, np.int64)
            self.bounds = self.spans = np.zeros(len(offsets), np.int64)
            self.hashes = np.zeros(0, np.uint64)
            return
        breaks = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(buf == 10, out=breaks[1:])
        row = words.rows()
        starts = np.ones(n, bool)
        starts[1:] = _STOPS[buf[words.ends[:-1] - 1]] | (breaks[words.starts[1:]] > breaks[words.ends[:-1]]) | (row[1:] != row[:-1])
        since_stop = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        starts[1:] |= (since_stop[:-1] >= QUIET) & (ta.mix(words.hashes[:-1]) % np.uint64(ONE_IN) == 0)
        self.first = np.flatnonzero(starts)
        self.row = row[self.first]
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))
        ends = np.append(self.first[1:], n)
        k = np.arange(len(ends))
        upto = np.maximum(np.searchsorted(ends, self.first + MIN_WORDS), k + MIN_SENTENCES - 1) + 1
        forward = np.flatnonzero(upto <= self.bounds[self.row + 1])
        # the shortest span that ends with each sentence: the last start that leaves enough words and sentences
        since = np.minimum(np.searchsorted(self.first, ends - MIN_WORDS, "right") - 1, k - MIN_SENTENCES + 1)
        backward = np.flatnonzero(since >= self.bounds[self.row])
        both = np.unique(np.concatenate([forward * (len(k) + 1) + upto[forward], since[backward] * (len(k) + 1) + backward + 1]))
        self.at, self.upto = both // (len(k) + 1), both % (len(k) + 1)
        self.spans = np.searchsorted(self.row[self.at], np.arange(len(offsets)))
        # a word of punctuation alone is a word too: spans with and without it differ
        solid = np.where(words.hashes == 0, ta.numbers(707, 1)[0], words.hashes)
        self.hashes = ta.Ranges(solid).hash(self.first[self.at], ends[self.upto - 1])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets, _ = ta.column(batch.column(1))
        check = np.asarray(batch.column(2)).astype(np.int64)
        for a, b in ta.row_slices(offsets):
            s = Sentences(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row = s.row[s.at]
            place = (check[a:b][row] << 32) | (np.arange(len(row)) - s.spans[row])
            yield pa.RecordBatch.from_arrays([ta.signed(s.hashes), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(place)], ["hash", "doc_id", "place"])


def _cut(text: int, names: tuple[str, ...]):
    """Rows with the text cut, the positions that follow the row's own columns taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, null = ta.column(batch.column(text))
            gone = batch.column(batch.num_columns - 1)
            texts, counts, removed = [], [], []
            for a, b in ta.row_slices(offsets):
                marked = [k for k in range(a, b) if gone[k].is_valid]
                s = Sentences(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if marked else None
                wanted = set(marked)
                for k in range(a, b):
                    whole = buf[offsets[k] : offsets[k + 1]].tobytes()
                    if k not in wanted:
                        texts.append(None if null[k] else whole)
                        counts.append(0)
                        removed.append([])
                        continue
                    lo, hi = s.bounds[k - a], s.bounds[k - a + 1]
                    at = np.array(gone[k].as_py(), np.int64) + s.spans[k - a]
                    change = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(change, s.at[at] - lo, 1)
                    np.add.at(change, s.upto[at] - lo, -1)
                    drop = np.cumsum(change[:-1]) > 0
                    edges = np.append(s.words.starts[s.first[lo:hi]], offsets[k + 1] - offsets[a]) - (offsets[k] - offsets[a])
                    edges[0] = 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                    runs = list(zip(edges[turns[::2]].tolist(), edges[turns[1::2]].tolist(), strict=True))
                    keep, p = [], 0
                    for x, y in runs:
                        keep.append(whole[p:x])
                        p = y
                    texts.append(b"".join([*keep, whole[p:]]))
                    counts.append(int(drop.sum()))
                    removed.append([{"start": x, "end": y} for x, y in runs])
            out = list(batch.columns[:-1])
            out[text] = pa.array(texts, pa.binary()).cast(pa.string())
            if names:
                spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int64()), spans], [*batch.schema.names[:-1], *names])
            else:
                yield pa.RecordBatch.from_arrays(out, batch.schema.names[:-1])

    return run


def _marked(documents: DataFrame) -> DataFrame:
    """documents and, in a last column, the numbers of its non-first repeated spans (else null)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "substrings")
    check = F.crc32(F.col("text").cast("string").cast("binary"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.shiftright(F.coalesce(check, F.lit(0)), 1)).alias("check"))
    spans = docs.mapInArrow(ta.tidy(_spans), "hash long, doc_id long, place long")
    repeated = spans.groupBy("hash").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = scratch.write(repeated.select(F.col("hash").alias("hash_"), F.col("first.doc_id").alias("first_id"), F.col("first.place").alias("first_place")), "repeated")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first_place")))
    hits = spans.where("doc_id is not null").join(repeated, spans.hash == repeated.hash_).where(later)
    gone = hits.groupBy(F.col("doc_id").alias("__id"), F.shiftright("place", 32).alias("__check")).agg(F.sort_array(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)))).alias("__spans"))
    gone = scratch.write(gone, "gone")
    own = F.shiftright(F.coalesce(F.crc32(documents["text"].cast("string").cast("binary")), F.lit(0)), 1)
    return documents.join(gone, (documents["doc_id"].cast("long") == gone["__id"]) & (own == gone["__check"]), "left").drop("__id", "__check")


def remove_repeated_spans(documents: DataFrame, report: tuple[str, str] | tuple[()] = ("n_removed", "removed")) -> DataFrame:
    """All rows of documents with the sentences of non-first repeated spans taken out of text.

    ``report`` names two columns that follow (none if it is empty): the number of sentences taken out
    and their byte ranges in the old text; they must be names that documents has not. A text with fewer than MIN_SENTENCES sentences or MIN_WORDS
    words has no span and stays. A repetition within one text counts like one across texts. Rows
    without doc_id come first of all and are not cut, null texts stay null, a text that is removed
    whole becomes empty. Rows repeated with one doc_id and text are one occurrence and are cut alike.
    Extra columns stay; an empty table gives an empty result.
    """
    marked = _marked(documents)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    extra = f", `{report[0]}` bigint, `{report[1]}` array<struct<start: bigint, end: bigint>>" if report else ""
    return marked.mapInArrow(ta.tidy(_cut(documents.columns.index("text"), report)), schema + extra)


def op3_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_removed, removed (byte ranges), and the text that is left."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_spans(documents).select("doc_id", "n_removed", "removed", "text")


def stage_sentence_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated passages taken out of text and n_chars, where it is there, counted again.

    A document of which nothing but white space is left is dropped; documents that had no words before stay.
    """
    out = remove_repeated_spans(docs, ("__n_removed", "__removed"))
    cut = F.col("__n_removed") > 0
    rest = out.where(~(cut & (F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", "") == "")))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rest.select(docs.columns)
