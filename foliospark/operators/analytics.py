"""Whitelisted analytics: a spec is validated, then planned as one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATIONS = ("count", "sum", "list")
MAX_LIST = 5000
#: Of each source: fields that can be listed, metrics that can be summed, filters.
SOURCES: dict[str, dict[str, tuple[str, ...]]] = {
    "documents": {"fields": ("doc_type", "subtype", "status", "parties"), "metrics": ("amount",), "filters": ("doc_type", "subtype", "status", "year", "year_min", "year_max")},
    "cases": {"fields": ("case_type", "status", "party", "case_id"), "metrics": ("amount", "indemnity"), "filters": ("case_type", "status", "year", "year_min", "year_max")},
}
UPPER = ("doc_type", "subtype", "case_type")


@dataclass(frozen=True)
class Spec:
    """What is asked: operation over source, with a field to list or a metric to sum, and filters."""

    operation: str
    source: str
    select_field: str | None = None
    metric: str | None = None
    filters: dict[str, Any] = field(default_factory=dict)
    codes: tuple[str, ...] = ()


def validate(spec: Spec) -> dict[str, Any] | None:
    """None if the spec can be planned, else an error that names what is allowed instead."""

    def refuse(what: str, value: Any, allowed: Sequence[str]) -> dict[str, Any]:
        return {"error": f"unknown {what}", "value": value, "allowed": list(allowed)}

    if spec.source not in SOURCES:
        return refuse("source", spec.source, list(SOURCES))
    if spec.operation not in OPERATIONS:
        return refuse("operation", spec.operation, OPERATIONS)
    known = SOURCES[spec.source]
    if spec.operation == "list" and spec.select_field not in known["fields"]:
        return refuse("select_field", spec.select_field, known["fields"])
    if spec.operation == "sum" and spec.metric not in known["metrics"]:
        return refuse("metric", spec.metric, known["metrics"])
    for name in spec.filters:
        if name not in known["filters"]:
            return refuse("filter", name, known["filters"])
    return None


def effective_type() -> Column:
    """A corrected type where there is one, else the given type."""
    return F.coalesce("doc_type_fixed", "doc_type")


def is_in(column: str | Column, value: Any) -> Column:
    """Polymorphic filter: nothing for None, "" or []; equality for one value; IN for several, without empty ones."""
    c = F.col(column) if isinstance(column, str) else column
    if value is None or value == "" or value == []:
        return F.lit(True)
    if isinstance(value, (list, tuple, set)):
        kept = [v for v in value if v and v != "null"]
        return c.isin(kept) if kept else F.lit(True)
    return c == value


def years(column: str, first: int | None = None, last: int | None = None, unknown: bool = False) -> Column:
    """Years of a span that may be open on either side; with ``unknown`` rows without year stay."""
    c = F.col(column)
    inside = (c >= first if first is not None else F.lit(True)) & (c <= last if last is not None else F.lit(True))
    return c.isNull() | inside if unknown else inside


def overlaps(column: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, values)))


def holds(column: str, text: str, anywhere: bool = True) -> Column:
    """The column holds a text (or ends with it), case aside; % and _ stand for themselves."""
    low = F.lower(F.col(column))
    return low.contains(text.lower()) if anywhere else low.endswith(text.lower())


def extracted(df: DataFrame, column: str, where: str, what: str, name: str) -> DataFrame:
    """Rows whose column matches ``where``, with the first group of ``what`` in it."""
    return df.where(F.col(column).rlike(where)).withColumn(name, F.regexp_extract(column, what, 1))


def trusted_type(protected: Sequence[str] = ("RCP",)) -> Column:
    """The effective type, but a type that is given for sure is not overridden."""
    return F.when(F.col("doc_type").isin(list(protected)), F.col("doc_type")).otherwise(effective_type())


def closed_type(column: Column, allowed: Sequence[str], default: str = "AUTRE") -> Column:
    """A type of a closed list, else the default; the text "null" is no type."""
    s = F.trim(column)
    return F.when(s.isin(list(allowed)), s).otherwise(default)


def single_scope(df: DataFrame, key: str) -> DataFrame:
    """key, whether all its rows are of one property, and the (smallest) property."""
    return df.groupBy(key).agg((F.countDistinct("code") == 1).alias("single"), F.min("code").alias("code"))


def recent(df: DataFrame, time: str, hours: int = 24) -> DataFrame:
    """Rows of the last hours before the newest."""
    now = df.agg(F.max(time).alias("now_"))
    return df.crossJoin(F.broadcast(now)).where(F.col(time) > F.col("now_") - F.expr(f"interval {hours} hours")).drop("now_")  # one row


def _filtered(df: DataFrame, spec: Spec) -> DataFrame:
    year = F.col("year") if spec.source == "documents" else F.year("opened")
    for name, value in spec.filters.items():
        if value is None or value == "":
            continue
        if name == "year":
            df = df.where(year == int(value))
        elif name == "year_min":
            df = df.where(year >= int(value))
        elif name == "year_max":
            df = df.where(year <= int(value))
        else:
            column = effective_type() if name == "doc_type" else F.col(name)
            df = df.where(is_in(column, value.upper() if name in UPPER and isinstance(value, str) else value))
    return df.where(F.col("code").isin(list(spec.codes))) if spec.codes else df


def plan(spec: Spec, df: DataFrame) -> DataFrame:
    """code, name, value for each property; raises on a spec that ``validate`` refuses."""
    if error := validate(spec):
        raise ValueError(error)
    base = _filtered(df, spec)
    if spec.operation == "count":
        return base.groupBy("code").agg(F.min("name").alias("name"), F.count("*").alias("value"))
    if spec.operation == "sum":
        return base.groupBy("code").agg(F.min("name").alias("name"), F.coalesce(F.sum(spec.metric), F.lit(0.0)).alias("value"))
    if spec.select_field == "parties":
        listed = base.select("code", "name", F.explode("parties").alias("value")).where("value is not null and value <> ''")
    else:
        column = effective_type() if spec.select_field == "doc_type" else F.col(spec.select_field)
        listed = base.select("code", "name", column.alias("value")).where("value is not null")
    return listed.distinct().orderBy("code", "value").limit(MAX_LIST)


def coverage(spec: Spec, df: DataFrame, result: DataFrame) -> DataFrame:
    """How many properties the base and the result hold, and those of the spec that are missing."""
    base = df.select("code").distinct()
    found = result.select("code").distinct()
    asked = df.sparkSession.createDataFrame([(c,) for c in spec.codes], "code string") if spec.codes else base
    missing = asked.join(found, "code", "left_anti").agg(F.sort_array(F.collect_list("code")).alias("missing"))
    return base.agg(F.count("*").alias("n_base")).crossJoin(found.agg(F.count("*").alias("n_result"))).crossJoin(missing)  # three single rows


def concentration(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """Properties that together hold a share of the total: n_top, n_total, total; no row for fewer than
    four properties, a total that is not positive, or if it takes all of them.

    One row for each property comes in, so a single ordered window is small.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "code")
    run = rows.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = run.withColumn("total", F.sum("value").over(Window.partitionBy(F.lit(0)))).withColumn("n_total", F.count("*").over(Window.partitionBy(F.lit(0))))
    top = whole.where(F.col("running") >= share * F.col("total")).agg(F.min("rank").alias("n_top"), F.max("n_total").alias("n_total"), F.max("total").alias("total"))
    return top.where("n_total >= 4 and total > 0 and n_top < n_total")
