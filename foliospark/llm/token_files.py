"""Token counts of flat, unindexed token files by a scan for separators.

A file holds little-endian ids of one width, documents one after another, each ended by the separator
id; nothing says where they begin. Files are read in blocks that know nothing of documents. A block
gives the places of its separators, found by one vector comparison; a prefix scan over the blocks of a
file then says how many documents ended before a block and where the last of them did, so that a
document cut by any number of block edges is counted whole.

Files are written and read through ``pyarrow.fs``, by URI, in any store that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta
from foliospark.llm import tokens
from foliospark.storage import Scratch

SEPARATOR = 49407
WIDTH = 2
#: Bytes of a block; a multiple of WIDTH.
BLOCK = 8 << 20


def _uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as pyarrow wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    scheme, _, rest = whole.partition(":")
    return whole if rest.startswith("//") else f"{scheme}://{rest}"


def write_token_files(documents: DataFrame, folder: str, path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Lazily writes a flat file for each partition and returns its contents' order: file, ordinal, doc_id.

    A task that is run again writes a file of another name; only files named in the result count. A
    null text is an empty document, a null doc_id stays null, repeated rows are documents of their own; extra
    columns are not read; an empty table writes no documents.
    """
    where = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(where, plain=True).encode
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, ordinal, out = f"tokens-{uuid.uuid4().hex}.bin", 0, None
        try:
            for batch in batches:
                buf, offsets, _ = ta.column(batch.column(1))
                for a, b in ta.row_slices(offsets):
                    ids, bounds = encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    out = out or store.open_output_stream(f"{root}/{name}")
                    out.write(np.insert(ids, bounds[1:], separator).astype(f"<u{WIDTH}").tobytes())
                    n = b - a
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0).slice(a, n)], ["file", "ordinal", "doc_id"])
                    ordinal += n
        finally:
            if out:
                out.close()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "file string, ordinal long, doc_id long")


def count_tokens(files: DataFrame, folder: str, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens, terminated for every document of the files (column file) in a folder.

    start is the document's first token in its file; the separator is not counted. Tokens behind the
    last separator are one document that is not terminated; an empty file has no document; a null
    name is left out and a repeated name counts once. A byte too many for the width is not read.
    """
    scratch = Scratch(files.sparkSession, "separators")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = store.get_file_info([f"{root}/{x}" for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(x.size or 0) // width for x in found], pa.int64())], ["file", "tokens"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(min(block, f.size() - k * block), k * block)
                ids = np.frombuffer(raw, f"<u{width}", len(raw) // width)
                ends = np.flatnonzero(ids == separator) + k * (block // width)
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([len(ends)]), pa.array([last], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "n", "last", "ends"])

    named = files.where("file is not null").select("file").distinct().mapInArrow(sizes, "file string, tokens long").where("tokens > 0")
    blocks = named.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / (block // width)).cast("long"))).alias("block"))
    scanned = scratch.write(blocks.repartition(F.col("file"), F.col("block")).mapInArrow(scan, "file string, block long, n long, last long, ends array<long>"), "scanned")
    # the prefix scan moves three numbers a block; the separators' places stay where they were read
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = scanned.select(F.col("file").alias("file_"), F.col("block").alias("block_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("prior"))
    each = scanned.join(sums, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_"))).select("file", "before", "prior", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("prior")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    whole = each.select("file", (F.col("before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    totals = scanned.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = totals.join(named, "file").where("tokens > start").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.unionByName(rest)


def op7_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, terminated of every document, counted in flat files that hold all of them.

    The files are deleted once they are counted.
    """
    scratch = Scratch(spark, "token-files")
    folder = _uri(spark, scratch.path("flat"))
    order = scratch.write(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "order")
    counted = scratch.write(count_tokens(order, folder), "counted")
    scratch.drop("flat")
    named = order.select(F.col("file").alias("file_"), F.col("ordinal").alias("ordinal_"), "doc_id")
    return named.join(counted, (F.col("file") == F.col("file_")) & (F.col("ordinal") == F.col("ordinal_"))).select("doc_id", "n_tokens", "terminated")
