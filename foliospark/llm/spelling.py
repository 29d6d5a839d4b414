"""Spelling variants: words at distance one are found by shared deletions and grouped under the frequent form.

Every word emits itself and its single deletions. Two words of one length differ in one place exactly
if they share a deletion made at that place, a longer word differs from a shorter one exactly if a
deletion of it is that word. A key with its place therefore stands for at most one word for each letter
of the alphabet (90), which bounds what one row of the join can meet, however many words share letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.merkle import LOWER, UPPER, crc_sql, crc_table_sql
from foliospark.storage import Scratch

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form must be so many times as frequent as the word.
RATIO = 5
#: One run in so many loses a letter.
NOISE = 199


def noisy(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where NOISE divides the crc32 of ``<doc_id>:<run>``; a null doc_id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters of all texts with A-Z lower-cased and noise applied, long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))
    words = docs.select(F.col("doc_id"), F.explode(runs).alias("run")).select(noisy(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words at distance one."""
    places = F.sequence(F.lit(1), F.length("word"))
    rest = F.transform(places, lambda i: F.struct(i.alias("place"), F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))).alias("key")))
    # Merged, here and below: Spark sizes a table by its files, before words are exploded, and would send all deletions
    # of half a million words through the driver.
    words = words.hint("merge")
    emitted = words.select("word", "n", F.inline(rest)).hint("merge")
    a, b = emitted.alias("a"), emitted.alias("b")
    replaced = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.word") != F.col("b.word")))
    replaced = replaced.select("a.word", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    # A run of equal letters gives one deletion, wherever it is made.
    once = emitted.where((F.col("place") == 1) | (F.substring(F.col("word"), F.col("place"), F.lit(1)) != F.substring(F.col("word"), F.col("place") - 1, F.lit(1))))
    cut = once.alias("a").join(words.alias("b"), F.col("a.key") == F.col("b.word")).select(F.col("a.word").alias("long"), F.col("a.n").alias("long_n"), F.col("b.word").alias("short"), F.col("b.n").alias("short_n"))
    both = F.array(F.struct(F.col("long").alias("word"), F.col("short").alias("near"), F.col("short_n").alias("near_n")), F.struct(F.col("short").alias("word"), F.col("long").alias("near"), F.col("long_n").alias("near_n")))
    pairs = replaced.unionByName(cut.select(F.inline(both)))
    return pairs.where(F.levenshtein("word", "near", 1) == 1)


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word (ties: the first), if it is ``ratio`` times as frequent."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n"))
    fits = F.col("form_n") >= ratio * F.col("n")
    return words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")
    )


def roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """word, root of every (word, form): the end of its chain.

    Each round joins the roots with themselves and so doubles the way that was followed. Counts grow
    along a chain by RATIO, so the rounds are few (5 for counts of 64 bits).
    """
    found = scratch.write(links.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, 64):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.write(found.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
        found = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return found


def group_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every frequent word of the texts.

    Null and empty texts have no words; texts of any length are read whole; repeated rows count each
    time; of near words of one count the first in code-point order is the form; extra columns are not
    read; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "spelling")
    words = scratch.write(word_counts(docs), "words")
    found = scratch.write(forms(words, near_pairs(words)), "forms")
    ends = roots(scratch, found.where(F.col("form").isNotNull()))
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole documents table."""
    return group_variants(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL: words of nearly one length are compared by edit distance, without keys."""
    letters = "".join(map(chr, range(0xC0, 0x100)))
    single = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'\\")[: len(letters)]
    octets = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) >= 192 THEN [195::BIGINT, unicode(ch)::BIGINT - 64] ELSE [unicode(ch)::BIGINT] END))"
    return f"""
WITH RECURSIVE t AS (SELECT {crc_table_sql()} AS remainders),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql(octets, "remainders")} AS h FROM runs, t),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{letters}', '{single}') AS bytes FROM noisy WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
sized AS (SELECT *, length(word) AS long FROM words),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM sized a JOIN (SELECT *, unnest([long - 1, long, long + 1]) AS other FROM sized) b ON a.long = b.other WHERE a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1),
best AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1),
chain AS (SELECT word, word AS last, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(last, k) AS root FROM chain GROUP BY word) r ON r.word = f.word"""
