"""State between two runs: snapshots, upserts, caches, freshness, the ingestion registry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", content: str = "sha") -> DataFrame:
    """key and change: NEW, DELETED or CHANGED; what stayed the same is left out."""
    a, b = before.select(F.col(key).alias("k_"), F.col(content).alias("c_")), after.select(key, content)
    both = b.join(a, F.col(key) == F.col("k_"), "full")
    change = F.when(F.col("k_").isNull(), "NEW").when(F.col(key).isNull(), "DELETED").when(~F.col(content).eqNullSafe(F.col("c_")), "CHANGED")
    return both.select(F.coalesce(key, "k_").alias(key), change.alias("change")).where("change is not null")


def gates(before: DataFrame, after: DataFrame, wanted: dict[str, Sequence[str]], key: str = "path", kind: str = "doc_type") -> dict[str, bool]:
    """For each gate whether a document of one of its types came or went; a handful of types reach the driver."""
    new, gone = after.join(before.select(key), key, "left_anti"), before.join(after.select(key), key, "left_anti")
    types = {r[0] for r in new.select(kind).union(gone.select(kind)).distinct().collect()}
    return {gate: bool(types & set(names)) for gate, names in wanted.items()}


def purge(derived: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return derived.join(deleted.select(key), key, "left_anti")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not handled yet: append-only resume."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def cached(rows: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the cached value, rows that miss); the cache is keyed by content."""
    hit = rows.join(cache.select(key, value), key, "left")
    return hit.where(F.col(value).isNotNull()), hit.where(F.col(value).isNull()).drop(value)


def pruned(cache: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return cache.join(seen.select(key).distinct(), key, "left_semi")


def one_row_a_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, each_column: bool = False) -> DataFrame:
    """rows with one row for each key: the last in the order of ``order``, then of all columns. Rows with a null key go.

    ``each_column``: the last value of each column that is not null, as if rows were applied one after the
    other. A key may hold a third of all rows: both forms are aggregates with partial results.
    """
    rest = [c for c in rows.columns if c not in keys]
    known = rows.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    if not rest:
        return known.distinct()
    last = F.struct(*[F.col(c) for c in dict.fromkeys([*(order or ()), *rest]) if c not in keys])
    if each_column:
        return known.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), last)).alias(c) for c in rest]).select(*rows.columns)
    return known.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("last_")).select(*[F.col(c) if c in keys else F.col(f"last_.{c}").alias(c) for c in rows.columns])


def refused(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that ``upsert`` refuses: those with a null key."""
    return rows.where(reduce(or_, [F.col(k).isNull() for k in keys]))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, keep_old_if_null: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """old with new rows by key; a key has one row afterwards, if it had one before.

    ``update`` limits which columns of known keys change; with ``keep_old_if_null`` a null of the new row does
    not overwrite. Of several new rows of a key the last in the order of ``order`` (columns of new), then of all
    columns, counts; new rows with a null key are refused; old rows with a null key stay as they are.
    """
    new = one_row_a_key(new, keys, order, each_column=keep_old_if_null)
    changed = set(old.columns if update is None else update) - set(keys)
    o, n = old.select("*", F.lit(True).alias("in_old")).alias("o"), new.select("*", F.lit(True).alias("in_new")).alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if c not in new.columns:
            return F.col(f"o.{c}")
        fresh = F.coalesce(f"n.{c}", f"o.{c}") if keep_old_if_null else F.col(f"n.{c}")
        taken = F.when(F.col("n.in_new").isNull(), F.col(f"o.{c}")).when(F.col("o.in_old").isNull(), F.col(f"n.{c}"))
        return taken.otherwise(fresh if c in changed else F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete and insert by key: all old rows of a new key go."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stale(stored: DataFrame, current: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """key and reasons (name and signed difference) of summaries whose fingerprint no longer fits; missing ones too."""
    s = stored.select(F.col(key).alias("k_"), *[F.col(m).alias(f"{m}_") for m in measures], F.lit(True).alias("known"))
    both = current.select(key, *measures).join(s, F.col(key) == F.col("k_"), "left")

    def reason(m: str) -> Column:
        kind = dict(current.dtypes)[m]
        delta = F.datediff(m, f"{m}_") if kind == "date" else F.col(m) - F.col(f"{m}_")
        return F.when(~F.col(m).eqNullSafe(F.col(f"{m}_")), F.concat(F.lit(f"{m}:"), F.coalesce(F.format_string("%+d", delta.cast("long")), F.lit("?"))))

    found = F.when(F.col("known").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*[reason(m) for m in measures])))
    return both.select(key, found.alias("reasons")).where(F.size("reasons") > 0)


STATUSES = ("INGERE", "REJETE", "ERREUR", "SUPPRIME", "EN_COURS", "DECOUVERT")


def registry(discovered: DataFrame, rejected: DataFrame, extracted: DataFrame, chunked: DataFrame) -> DataFrame:
    """The state of every file from what the stages left behind; a fact (chunks exist) beats a decision (rejected).

    source_file, status, reason, n_chunks, inconsistent (rejected, yet chunks exist).
    """
    r = rejected.groupBy("source_file").agg(F.min("reason").alias("reason"))
    c = chunked.groupBy("source_file").agg(F.count("*").alias("n_chunks"))
    e = extracted.select("source_file").distinct().withColumn("extracted", F.lit(True))
    rows = discovered.select("source_file").distinct().join(r, "source_file", "left").join(e, "source_file", "left").join(c, "source_file", "left")
    status = F.when(F.col("n_chunks") > 0, "INGERE").when(F.col("reason").isNotNull(), "REJETE").when(F.col("extracted"), "EN_COURS").otherwise("DECOUVERT")
    return rows.select("source_file", status.alias("status"), F.when(status == "REJETE", F.col("reason")).alias("reason"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), ((F.coalesce("n_chunks", F.lit(0)) > 0) & F.col("reason").isNotNull()).alias("inconsistent"))
