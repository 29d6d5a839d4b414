"""Lookups, directory search, relevance sorts and history windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as tx

MAX_IDS, MAX_CHARS = 20, 50_000


def by_ids(chunks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Chunks of a list of ids in its order; an id that is not found, or stands behind the first MAX_IDS, gives a
    row with found = false and the reason (``unknown`` or ``limit``)."""
    listed = [(k, v, k < MAX_IDS) for k, v in enumerate(dict.fromkeys(ids))]
    asked = chunks.sparkSession.createDataFrame(listed, "position int, wanted string, inside boolean")
    both = asked.join(chunks, F.col("inside") & (F.col("wanted") == F.col("chunk_id")), "left").withColumn("found", F.col("chunk_id").isNotNull())
    return both.withColumn("why", F.when(~F.col("found"), F.when(F.col("inside"), "unknown").otherwise("limit"))).drop("inside").orderBy("position")


def document_text(chunks: DataFrame, first: int = 0, last: int | None = None, budget: int = MAX_CHARS) -> DataFrame:
    """Chunks of each source file in order, as long as their text and two characters each fit the budget."""
    inside = chunks.where(F.col("chunk_index") >= first) if last is None else chunks.where(F.col("chunk_index").between(first, last))
    order = Window.partitionBy("source_file").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("used", F.sum(F.col("n_chars") + 2).over(order)).where(F.col("used") <= budget)


def valid_source(name: str | None) -> bool:
    """A source file that may be asked for: three characters or more, no wildcards."""
    return bool(name) and len(name) >= 3 and not set(name) & set("%*")


def clamp(value: object, default: int, most: int) -> int:
    try:
        return max(1, min(most, int(value)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def directory_score(fields: Sequence[str], query: str) -> Column:
    """10 for an equal field, 5 if one holds the other, 1 for a shared word; summed over fields."""
    q = tx.plain(query).lower().strip()
    words = F.array(*map(F.lit, q.split()))

    def one(name: str) -> Column:
        c = tx.fold_latin(F.coalesce(F.col(name), F.lit("")))
        return F.when(c == "", 0).when(c == q, 10).when(c.contains(q) | F.lit(q).contains(c), 5).when(F.arrays_overlap(F.split(c, " +"), words), 1).otherwise(0)

    return sum((one(f) for f in fields), F.lit(0))


def directory(rows: DataFrame, fields: Sequence[str], query: str, order: str) -> DataFrame:
    """Rows by score; all rows if none scores."""
    scored = rows.withColumn("score", directory_score(fields, query))
    best = scored.crossJoin(F.broadcast(scored.agg(F.max("score").alias("best"))))  # one row
    return best.where((F.col("score") > 0) | (F.col("best") == 0)).drop("best").orderBy(F.desc("score"), order)


def canonical_of(rows: DataFrame, key: str, alias: DataFrame, name: str, unknown: str = "UNKNOWN") -> DataFrame:
    """rows with the canonical name of their key in alias (key_, name_), else ``unknown``."""
    return rows.join(alias, F.col(key) == F.col("key_"), "left").withColumn(name, F.coalesce("name_", F.lit(unknown))).drop("key_", "name_")


def keyword_search(rows: DataFrame, hit: Column, n: int, date: str = "opened", tie: str = "case_id") -> DataFrame:
    """The n latest rows that match, unknown dates last."""
    return rows.where(hit).orderBy(F.desc_nulls_last(date), tie).limit(n)


def relevance(references: Sequence[str], names: Sequence[str], tokens: Sequence[str], haystack: Column) -> Column:
    """3 for each reference, 2 for each name, 1 for each token that the haystack holds."""
    hits = [F.when(haystack.contains(t.lower()), w).otherwise(0) for w, group in ((3, references), (2, names), (1, tokens)) for t in group]
    return sum(hits, F.lit(0))


def by_status(df: DataFrame, statuses: Sequence[str] = ("EN_COURS", "EN_ATTENTE", "CLOTURE"), date: str = "opened", tie: str = "case_id") -> DataFrame:
    """Rows by rank of status, then the latest date, unknown dates last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, statuses)), F.col("status")), F.lit(0)), F.lit(len(statuses) + 1))
    return df.withColumn("status_rank", rank.cast("int")).orderBy("status_rank", F.desc_nulls_last(date), tie)


def all_tokens(columns: Sequence[str], tokens: Sequence[str]) -> Column:
    """Every token stands in the text of the columns, case and accents aside."""
    hay = tx.fold_latin(F.concat_ws(" ", *columns))
    return F.forall(F.array(*[F.lit(tx.plain(t).lower()) for t in tokens]), lambda t: hay.contains(t)) if tokens else F.lit(True)


def allowed(labels: str, tenant: Sequence[str]) -> Column:
    """Rows one of whose labels holds an allowed name; nothing if nothing is allowed."""
    if not tenant:
        return F.lit(False)
    return F.coalesce(F.exists(labels, lambda x: F.exists(F.array(*map(F.lit, tenant)), lambda t: x.contains(t))), F.lit(False))


def linked(hub: DataFrame, rows: DataFrame, ids: str, key: str, value: Column, name: str) -> DataFrame:
    """hub with a sorted array of value over the rows that its array of ids names."""
    one = hub.select("code", F.explode(ids).alias("k_")).join(rows.select(F.col(key).alias("k_"), value.alias("v_")), "k_")
    return hub.join(one.groupBy("code").agg(F.sort_array(F.collect_list("v_")).alias(name)), "code", "left")


def with_virtual(rows: DataFrame, virtual: DataFrame) -> DataFrame:
    """virtual rows first, with similarity 1.0 and rrf 0.99."""
    top = virtual.withColumn("vec", F.lit(1.0)).withColumn("rrf", F.lit(0.99)).withColumn("priority", F.lit(0))
    return top.unionByName(rows.withColumn("priority", F.lit(1)), allowMissingColumns=True).orderBy("priority", F.desc("rrf"), "chunk_id")


def with_context(strict: DataFrame, context: DataFrame, least: float = 0.25, most: int = 2) -> DataFrame:
    """strict results and up to ``most`` contextual ones that are new and near enough."""
    order = Window.partitionBy("query_id").orderBy(F.desc("vec"), "chunk_id")
    new = context.where(F.col("vec") >= least).join(strict.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return strict.unionByName(new.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn"), allowMissingColumns=True)


def history(turns: DataFrame, last: int = 3, chars: int = 16_000, answer: int = 4_000) -> DataFrame:
    """The latest turns of each conversation that fit: ``last`` user turns, answers cut, characters in all."""
    cut = turns.withColumn("text", F.when(F.col("role") == "assistant", F.substring("text", 1, answer)).otherwise(F.col("text")))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(before), F.lit(0))
    return cut.withColumn("asked", asked).withColumn("used", F.sum(F.length("text")).over(back)).where((F.col("asked") < last) & (F.col("used") <= chars)).drop("asked")
