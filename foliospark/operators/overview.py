"""Directories, per-property facts and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def property_stats(documents: DataFrame) -> DataFrame:
    """Documents, types and year span of each property."""
    return documents.groupBy("code").agg(F.min("name").alias("name"), F.countDistinct("source_file").alias("n_documents"), F.sort_array(F.collect_set("doc_type")).alias("doc_types"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def property_list(documents: DataFrame, chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """property_stats with the number of chunks and whether there are cases."""
    n = chunks.groupBy("code").agg(F.count("*").alias("n_chunks"))
    some = cases.select("code").distinct().withColumn("has_cases", F.lit(True))
    return property_stats(documents).join(n, "code", "left").join(some, "code", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("has_cases", F.coalesce("has_cases", F.lit(False)))


def facts(documents: DataFrame, meetings: str = "PV_AG", top: int = 5) -> DataFrame:
    """What a summary of each property states: counts by type and status, the latest meetings."""
    kinds = documents.groupBy("code", "doc_type").agg(F.count("*").alias("n")).groupBy("code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_type", "n")))).alias("types"))
    states = documents.where("status is not null").groupBy("code", "status").agg(F.count("*").alias("n")).groupBy("code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    latest = Window.partitionBy("code").orderBy(F.desc("date"), F.desc("source_file"))
    met = documents.where(F.col("doc_type") == meetings).withColumn("turn", F.row_number().over(latest)).where(F.col("turn") <= top)
    met = met.groupBy("code").agg(F.max("date").alias("last_meeting"), F.sort_array(F.collect_list(F.struct("date", "source_file")), asc=False).alias("meetings"))  # top rows each
    whole = documents.groupBy("code").agg(F.countDistinct("source_file").alias("n_documents"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    return whole.join(kinds, "code", "left").join(states, "code", "left").join(met, "code", "left")


def rolled_up(chunks: DataFrame) -> DataFrame:
    """The whole text of each document from its chunks in order."""
    pieces = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("source_file").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"), F.count("*").alias("n"))


def type_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_type").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("avg_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))


def incomplete(chunks: DataFrame) -> DataFrame:
    """Documents whose chunks are not as many as they say."""
    return chunks.groupBy("source_file").agg(F.count("*").alias("n"), F.max("total_chunks").alias("said")).where("n <> said")


def repeated_texts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("n_documents")).where("n > 1")


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows, in percent, in which each column has a value."""
    return df.agg(*[F.round(100.0 * F.count(c) / F.count("*"), 2).alias(c) for c in columns])


def reclassified(documents: DataFrame) -> DataFrame:
    return documents.where("doc_type_fixed is not null").groupBy("doc_type", "doc_type_fixed").agg(F.count("*").alias("n"))


def cost(calls: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Calls, tokens and price by model; prices for a million tokens."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round((F.sum("tokens_in") * input_price + F.sum("tokens_out") * output_price) / 1e6, 6).alias("price"))


def preflight(files: DataFrame) -> DataFrame:
    """Files, bytes and how much of both repeats another file."""
    one = files.groupBy("size", "sha").agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum(F.col("n") - 1).alias("copies"), F.sum((F.col("n") - 1) * F.col("size")).alias("copied_bytes"), F.round(100.0 * F.sum(F.col("n") - 1) / F.sum("n"), 2).alias("copied_percent"))


def most_frequent(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
