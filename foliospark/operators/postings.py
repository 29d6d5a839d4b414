"""A stored table of words: which chunks hold a word, how often, in the title or in the text, and at what places.

Rows lie in partitions by the hash of the word and are sorted by word, so a search reads the partitions of its words
and, in these, the row groups that hold them. Each task writes the words of its own chunks, a file to a partition:
nothing is shuffled, and a frequent word's rows come from all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.search import ENDING, folded_words, stems

BUCKETS = 64
#: Chunks whose words a task puts in order at once.
BLOCK = 2048

# French words that tell nothing about a text, as they are folded.
STOP_WORDS = (
    "au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me meme mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "est sont ete etait etre avait avoir ont cette cet comme plus"
).split()


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _inverted(keys: pa.Array, heads: pa.ListArray, bodies: pa.ListArray) -> list[pa.Array]:
    """word, key, in_title, places of the words of some chunks; each distinct word is stemmed once."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (heads, bodies)]
    row = np.concatenate([np.repeat(np.arange(len(keys)), n) for n in sizes])
    starts = np.cumsum(sizes[1]) - sizes[1]
    place = np.concatenate([np.full(sizes[0].sum(), -1), np.arange(sizes[1].sum()) - np.repeat(starts, sizes[1])]).astype(np.int32)
    coded = pa.concat_arrays([heads.flatten(), bodies.flatten()]).dictionary_encode()
    ending = re.compile(ENDING)
    stemmed = pa.array([ending.sub("", w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    word = stemmed.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    order = np.lexsort((place, row, word))
    word, row, place = word[order], row[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])]) if len(word) else np.zeros(0, bool))
    in_text = np.concatenate([[0], np.cumsum(place >= 0)])
    ends = np.concatenate([first[1:], [len(word)]]) if len(first) else first
    titles = (ends - first) - (in_text[ends] - in_text[first])
    places = pa.ListArray.from_arrays(pa.array(np.concatenate([in_text[first], in_text[-1:]]).astype(np.int32)), pa.array(place[place >= 0]))
    return [stemmed.dictionary.take(pa.array(word[first])), keys.take(pa.array(row[first])), pa.array(titles.astype(np.int64)), places]


def build(chunks: DataFrame, path: str, text: str = "text", title: Column | None = None, stop: Sequence[str] = (), key: str = "chunk_id") -> DataFrame:
    """Writes word, key, in_title, places (of the text, from 0) below ``path`` and returns the table as read back.

    Places count all words, so that neighbours in the text stay neighbours; words of ``stop`` have no rows. Null
    texts have no words. Chunks of one key have a row each, which a search adds up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                yield pa.RecordBatch.from_arrays(_inverted(*batch.slice(k, BLOCK).columns), ["word", key, "in_title", "places"])

    head = folded_words(F.coalesce(title if title is not None else F.lit(""), F.lit("")))
    texts = chunks.select(F.col(key), head.alias("head_"), folded_words(F.col(text)).alias("body_"))
    rows = texts.mapInArrow(run, f"word string, {key} {dict(chunks.dtypes)[key]}, in_title long, places array<int>")
    rows = (rows.where(~F.col("word").isin(list(stop))) if stop else rows).withColumn("bucket", _bucket(F.col("word")))
    rows.sortWithinPartitions("bucket", "word").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
    return chunks.sparkSession.read.schema(rows.schema).parquet(path)


def wanted(spark: SparkSession, query: str, stop: Sequence[str] = ()) -> list[str]:
    """The words of a query as they are stored, in their order."""
    return [w for w in spark.range(1).select(stems(F.lit(query)).alias("w")).first().w if w not in stop]


def of_words(postings: DataFrame, words: Sequence[str]) -> DataFrame:
    """The rows of some words, from the partitions that hold them."""
    spark = postings.sparkSession
    buckets = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "word string").select(_bucket(F.col("word"))).collect()}) if words else []
    return postings.where(F.col("bucket").isin(buckets) & F.col("word").isin(list(dict.fromkeys(words))))


def _series(n: Column) -> Column:
    """1 + 1/4 + 1/9 and so on, n terms: each further hit weighs less."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + 1.0 / (k * k))).otherwise(0.0)


def ranked(postings: DataFrame, query: str, stop: Sequence[str] = (), key: str = "chunk_id") -> DataFrame:
    """key, rank of the chunks that hold every word of a query: ``search.lexical_rank``, without reading a text."""
    words = list(dict.fromkeys(wanted(postings.sparkSession, query, stop)))
    once = of_words(postings, words).groupBy(key, "word").agg(F.sum("in_title").alias("in_title"), F.sum(F.size("places")).alias("in_text"))
    each = once.select(key, "word", (_series(F.col("in_title").cast("int")) + 0.1 * _series(F.col("in_text").cast("int"))).alias("hit"))
    score = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.lit(words) if words else F.array().cast("array<string>"), F.col("word")).alias("k"), "hit"))), lambda x: x["hit"]), F.lit(0.0), lambda s, x: s + x)
    found = each.groupBy(key).agg(F.count("*").alias("n"), score.alias("total")).where(F.col("n") == len(words))
    return found.select(key, (F.col("total") / (F.col("total") + 1)).alias("rank"))


def _moved(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


def phrases(postings: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """key, n: the chunks whose text holds the words of a query one after the other, and how often."""
    words = wanted(postings.sparkSession, query)
    shifted = F.lit(None).cast("array<int>")
    for k, word in enumerate(words):
        own = _moved(F.flatten(F.collect_list(F.when(F.col("word") == word, F.col("places")))), k)
        shifted = own if not k else F.array_intersect(shifted, own)
    found = of_words(postings, words).groupBy(key).agg(F.size(shifted).cast("long").alias("n")) if words else postings.select(key, F.lit(0).cast("long").alias("n")).limit(0)
    return found.where("n > 0")
