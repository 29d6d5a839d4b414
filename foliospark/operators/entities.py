"""Case files: grouping, clustering and merging of records about one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators.components import connected_components
from foliospark.storage import Scratch


def majority(df: DataFrame, group: list[str], value: str, priority: tuple[str, ...] = (), tie: str = "AUTRE") -> DataFrame:
    """The most frequent value of each group; a value of ``priority`` wins if it occurs, equal counts give ``tie``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col(value).isin(list(priority)), F.array_position(F.array(*map(F.lit, priority)), F.col(value)))) if priority else F.lit(None)
    top = counts.groupBy(*group).agg(F.max(F.struct("n", value)).alias("top"), F.max("n").alias("most"), first.alias("p"), F.collect_list("n").alias("all"))
    many = F.size(F.filter("all", lambda n: n == F.col("most"))) > 1
    chosen = F.when(many, tie).otherwise(F.col(f"top.{value}"))
    if priority:
        chosen = F.when(F.col("p").isNotNull(), F.element_at(F.array(*map(F.lit, priority)), F.coalesce(F.col("p"), F.lit(1)).cast("int"))).otherwise(chosen)
    return top.select(*group, chosen.alias(value))


def first_known(column: str, order: str) -> Column:
    """Aggregate: the value of the lowest order that is not null."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def case_groups(docs: DataFrame) -> DataFrame:
    """Cases of documents: id of property, type, slug of folder or name, and year (2024 if unknown)."""
    label = F.coalesce(F.nullif("folder", F.lit("")), "party")
    case_id = F.concat_ws("_", "code", "case_type", tx.slug(label), F.coalesce(F.year("opened").cast("string"), F.lit("2024")))
    return docs.withColumn("case_id", case_id).groupBy("case_id").agg(F.min("code").alias("code"), first_known("party", "seq").alias("party"), F.min("opened").alias("opened"), F.max("closed").alias("closed"), F.array_sort(F.array_distinct(F.collect_list("source_file"))).alias("documents"))


def same_event(a: str, b: str, days: int = 30) -> Column:
    """One name set holds the other, no two different units, dates at most ``days`` apart."""
    p = lambda side, f: F.col(f"{side}.{f}")
    inside = (F.size(F.array_except(p(a, "names"), p(b, "names"))) == 0) | (F.size(F.array_except(p(b, "names"), p(a, "names"))) == 0)
    named = (F.size(p(a, "names")) > 0) & (F.size(p(b, "names")) > 0)
    unit = p(a, "unit").isNull() | p(b, "unit").isNull() | (p(a, "unit") == p(b, "unit"))
    return named & inside & unit & (F.abs(F.datediff(p(a, "opened"), p(b, "opened"))) <= days)


def event_links(cases: DataFrame, days: int = 30) -> DataFrame:
    """Pairs (a, b) of cases of one property and type about the same event.

    The join is on property, type, the rarest name word of the smaller name set, and neighbouring windows of
    ``days`` days: only cases that can be near in time meet.
    """
    rows = cases.select("case_id", "code", "case_type", "opened", tx.name_tokens(F.col("party")).alias("names"), tx.unit_number(F.col("party")).alias("unit"))
    window = F.floor(F.datediff("opened", F.lit("1970-01-01")) / days)
    key = ["code", "case_type", "name", "window"]
    keyed = rows.select("case_id", "code", "case_type", F.explode("names").alias("name"), window.alias("w"), F.size("names").alias("k"))
    # the smaller name set lies in the larger one: its rarest word is enough to meet at, so frequent ones are not joined
    usual = keyed.groupBy("code", "case_type", "name").agg(F.count("*").alias("often"))
    rarest = keyed.join(usual, ["code", "case_type", "name"]).groupBy("case_id", "code", "case_type", "w", "k").agg(F.min_by("name", F.struct("often", "name")).alias("name"))
    a = rarest.select("case_id", "code", "case_type", "name", F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)).alias("window"), "k")
    b = keyed.select(F.col("case_id").alias("other"), "code", "case_type", "name", F.col("w").alias("window"), F.col("k").alias("other_k"))
    met = a.join(b, key).where((F.col("case_id") != F.col("other")) & (F.col("k") <= F.col("other_k")))
    pairs = met.select(F.least("case_id", "other").alias("x"), F.greatest("case_id", "other").alias("y")).distinct()
    side = lambda name, at: rows.select(F.col("case_id").alias(at), F.struct("names", "unit", "opened").alias(name))
    judged = pairs.join(side("a", "x"), "x").join(side("b", "y"), "y").where(same_event("a", "b", days))
    return judged.select(F.col("x").alias("a"), F.col("y").alias("b"))


def clusters(cases: DataFrame, links: DataFrame) -> DataFrame:
    """cases with cluster, the smallest case_id that can be reached."""
    found = connected_components(links, "a", "b", Scratch(cases.sparkSession, "clusters"))
    return cases.join(found.withColumnRenamed("node", "case_id"), "case_id", "left").withColumn("cluster", F.coalesce("component", "case_id")).drop("component")


def merged(rows: DataFrame, richness: Column | None = None) -> DataFrame:
    """One case of each cluster: the richest stands for it, dates span all, lists are united."""
    rich = richness if richness is not None else F.size("documents")
    best = F.struct(rich.alias("r"), F.expr("reverse(case_id)").alias("tie"))
    return rows.groupBy("cluster").agg(F.max_by("case_id", best).alias("case_id"), F.max_by("party", best).alias("party"), F.min("opened").alias("opened"), F.max("closed").alias("closed"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("documents"), F.count("*").alias("members"))


def candidates(a: DataFrame, b: DataFrame, days: int) -> DataFrame:
    """Rows of a (code, erp_date, erp_names) and b (code, opened, names, ...) of one property whose names may hold each
    other and whose dates are at most ``days`` apart or unknown, each pair once.

    They meet at the rarest word of the smaller set, as it lies in the larger one, and in neighbouring windows of
    ``days`` days: a word that half of a property's cases have joins nothing, as long as they have another.
    """
    unknown, any_date = F.lit(-1_000_000), F.lit(-2_000_000)  # windows of rows without a date, and for them
    at = lambda date: F.floor(F.datediff(date, F.lit("1970-01-01")) / max(days, 1)).cast("int")
    near = lambda date: F.when(F.col(date).isNull(), F.array(any_date, unknown)).otherwise(F.array(at(date) - 1, at(date), at(date) + 1, unknown))
    own = lambda date: F.when(F.col(date).isNull(), F.array(unknown)).otherwise(F.array(at(date), any_date))
    x, y = a.withColumn("word", F.explode("erp_names")), b.withColumn("word", F.explode("names"))
    usual = x.select("code", "word").unionByName(y.select("code", "word")).groupBy("code", "word").agg(F.count("*").alias("often"))

    def rarest(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.join(usual, ["code", "word"]).groupBy(*columns).agg(F.min_by("word", F.struct("often", "word")).alias("word"))

    windows = lambda left, right: (left.withColumn("window", F.explode(near("erp_date"))), right.withColumn("window", F.explode(own("opened"))))
    key = ["code", "word", "window"]
    one, two = windows(rarest(x, a.columns), y)
    inside = one.join(two, key).where(F.size("erp_names") <= F.size("names"))
    one, two = windows(x, rarest(y, b.columns))
    outside = one.join(two, key).where(F.size("erp_names") > F.size("names"))
    return inside.unionByName(outside).drop("word", "window")


def matched(erp: DataFrame, found: DataFrame, days: int = 30) -> DataFrame:
    """Best match of each ERP case among found cases of its property: all name words of one in the other, dates
    near or unknown. A match by the injured party's name goes before one by the case's name (``name``, where found
    has it), a party that the case's name repeats before one that it does not, then the nearest date, then the
    smaller id; each side at most once, by rank.

    Cases of one property, day and names have the same matches: they are compared once, found ones by their smallest id.
    """
    named = F.col("name") if "name" in found.columns else F.lit(None).cast("string")
    a = erp.select(F.col("case_id").alias("erp_id"), "code", F.col("opened").alias("erp_date"), tx.name_tokens(F.col("party")).alias("erp_names"))
    b = found.select("case_id", "code", "opened", tx.name_tokens(F.col("party")).alias("party_names"), F.coalesce(tx.name_tokens(named), F.array().cast("array<string>")).alias("case_names"))
    b = b.withColumn("names", F.when(F.size("party_names") > 0, F.col("party_names")).otherwise(F.col("case_names")))
    kind = ["code", "erp_date", "erp_names"]
    met = candidates(a.select(*kind).distinct(), b.groupBy("code", "opened", "party_names", "case_names", "names").agg(F.min("case_id").alias("case_id")), days)
    inside = (F.size(F.array_except("erp_names", "names")) == 0) | (F.size(F.array_except("names", "erp_names")) == 0)
    gap = F.coalesce(F.abs(F.datediff("erp_date", "opened")), F.lit(days))
    lower = lambda names: -F.coalesce(F.arrays_overlap("erp_names", names).cast("int"), F.lit(-1))
    rank = F.struct(lower("party_names").alias("direct"), lower("case_names").alias("also"), gap.alias("gap"), "case_id")
    best = met.where(inside & (gap <= days)).groupBy(*kind).agg(F.min(rank).alias("best"))
    same = [F.col("code") == F.col("code_"), F.col("erp_date").eqNullSafe(F.col("date_")), F.col("erp_names") == F.col("names_")]
    each = a.join(best.select(F.col("code").alias("code_"), F.col("erp_date").alias("date_"), F.col("erp_names").alias("names_"), "best"), same)
    one = each.groupBy("erp_id").agg(F.min("best").alias("best")).select("erp_id", "best.*")
    two = one.groupBy("case_id").agg(F.min(F.struct("direct", "also", "gap", "erp_id")).alias("best"))
    return two.select("best.erp_id", "case_id", "best.gap")


def only_candidate(erp: DataFrame, found: DataFrame) -> DataFrame:
    """Fallback on equal property, date and type, if exactly one case fits."""
    a = erp.select(F.col("case_id").alias("erp_id"), "code", "opened", "case_type")
    pairs = a.join(found.select("case_id", "code", "opened", "case_type"), ["code", "opened", "case_type"])
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy("erp_id"))).where("n = 1").select("erp_id", "case_id")
