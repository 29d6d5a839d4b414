"""Exact copies, confirmed near copies, variants and version families of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import dates as dt
from foliospark.functions import text as tx
from foliospark.operators.components import connected_components
from foliospark.storage import Scratch

# Fixed values of the confirmation rule.
JACCARD_MIN, LENGTH_RATIO_MIN, TEXT_MIN, CONTAINMENT_MIN = 0.90, 0.90, 100, 0.95
STEM_MIN, FAMILY_MAX = 8, 12
#: Documents in which frequent shingles are looked for, and shingles that tasks know as frequent: what is joined first, not what is found.
SAMPLE, FREQUENT = 16_384, 1 << 20
#: Documents whose shingles a task puts in order at once.
SLICE = 512


def exact_copies(files: DataFrame, order: tuple[Column, ...] | None = None) -> DataFrame:
    """files with keep and ref_path: of equal content the shallowest path stays, then the first.

    Files of a size that occurs once are not hashed against others: the size is grouped first. Empty
    files are never copies.
    """
    first = order or (F.col("depth"), F.lower("path"), F.col("path"))
    same = Window.partitionBy("size", "sha").orderBy(*first)
    ranked = files.where("size > 0").withColumn("rank", F.row_number().over(same)).withColumn("ref_path", F.first("path").over(same))
    kept = ranked.select(*files.columns, (F.col("rank") == 1).alias("keep"), F.when(F.col("rank") > 1, F.col("ref_path")).alias("ref_path"))
    return kept.unionByName(files.where("size <= 0 or size is null").select(*files.columns, F.lit(True).alias("keep"), F.lit(None).cast("string").alias("ref_path")))


def profile(docs: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """docs with what confirmation compares: norm, shingles, dates of text and name, periods of the name, length."""
    norm = tx.canonical(F.col(text))
    folded = tx.fold_latin(F.col(name))
    spaced = F.regexp_replace(F.col(name), "_", " ")
    return docs.withColumn("norm", norm).withColumn("shingles", tx.hashed_shingles(F.col("norm"))).withColumn("text_dates", dt.dates(F.col(text), tx.fold_latin(F.col(text)))).withColumn("name_dates", dt.dates(spaced, tx.fold_latin(spaced))).withColumn("name_periods", dt.periods(folded)).withColumn("chars", F.length(text))


def confirm(a: str, b: str) -> Column:
    """struct(copy, score, reason) of two profiles, given as struct columns; symmetric."""
    p = lambda side, f: F.col(f"{side}.{f}")
    score = tx.jaccard(p(a, "shingles"), p(b, "shingles"))
    ratio = F.least(p(a, "chars"), p(b, "chars")) / F.greatest(p(a, "chars"), p(b, "chars"))
    out = lambda copy, value, reason: F.struct(F.lit(copy).alias("copy"), value.alias("score"), F.lit(reason).alias("reason"))
    return (
        F.when(F.least(p(a, "chars"), p(b, "chars")) < TEXT_MIN, out(False, F.lit(0.0), "TEXTE_TROP_COURT"))
        .when(p(a, "name_dates") != p(b, "name_dates"), out(False, F.lit(0.0), "DATES_NOM_DIFFERENTES"))
        .when(p(a, "name_periods") != p(b, "name_periods"), out(False, F.lit(0.0), "PERIODES_NOM_DIFFERENTES"))
        .when(p(a, "norm") == p(b, "norm"), out(True, F.lit(1.0), "TEXTE_IDENTIQUE"))
        .when(score < JACCARD_MIN, out(False, score, "JACCARD_INSUFFISANT"))
        .when(p(a, "text_dates") != p(b, "text_dates"), out(False, score, "DATES_TEXTE_DIFFERENTES"))
        .when(ratio < LENGTH_RATIO_MIN, out(False, score, "LONGUEURS_ECARTEES"))
        .otherwise(out(True, score, "QUASI_IDENTIQUE"))
    )


def frequent(sets: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about SAMPLE documents have, in order, and how often: FREQUENT at most, the most frequent."""
    total = max(sets.count(), 1)
    drawn = sets.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < max(1, (SAMPLE << 20) // total)) if total > SAMPLE else sets
    counts = drawn.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    least, left = 2, FREQUENT
    for times, n in sorted(map(tuple, counts.groupBy("times").count().collect()), reverse=True):  # a row for each count
        left -= n
        if left < 0:
            least = times + 1
            break
    rows = counts.where(F.col("times") >= least).toArrow()  # FREQUENT at most
    token, times = rows["token"].to_numpy(), rows["times"].to_numpy()
    order = np.argsort(token)
    return token[order], times[order]


def near_candidates(units: DataFrame, block: list[str], scratch: Scratch, known: tuple[np.ndarray, np.ndarray], least: float = JACCARD_MIN) -> DataFrame:
    """block, a, b: pairs of units (block, unit, shingles; equal ones may repeat) of one block whose Jaccard similarity
    may be ``least`` or more, each once.

    Shingles are put in one order, those last that are ``known`` to be frequent. Of two units that are so similar, one
    of the first shingles of each is the same, among as many as may differ and one more: only these leave a task. So a
    passage that a whole folder shares is no key, as long as a text has enough of its own. Any order would find every
    pair; the place of the shared shingle and both lengths bound the overlap before any set is compared.
    """
    kinds = dict(units.dtypes)
    tokens, times = known

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            held = batch.column(batch.num_columns - 1)
            n = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, token = np.repeat(np.arange(len(n)), n), held.flatten().to_numpy(zero_copy_only=False)
            often = np.zeros(len(token), np.int64)
            if len(tokens) and len(token):
                at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
                often = np.where(tokens[at] == token, times[at], 0)
            order = np.lexsort((token, often, row))
            place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n) + 1
            kept = np.flatnonzero(place <= (n - np.ceil(n * least - 1e-9) + 1)[row])
            at = pa.array(row[kept])
            ends = [c.take(at) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(n[row[kept]].astype(np.int32)), pa.array(token[order][kept]), pa.array(place[kept].astype(np.int32))], [*block, "unit", "n", "token", "place"])

    placed = units.select(*block, "unit", "shingles").mapInArrow(first, ", ".join(f"`{c}` {kinds[c]}" for c in (*block, "unit")) + ", n int, token long, place int")
    dealt = placed.repartition(*block, "token").groupBy(*block, "token", "unit").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    marked = scratch.write(dealt.withColumn("times", F.count("*").over(Window.partitionBy(*block, "token"))).where("times > 1").drop("times"), "marks")
    a, b = (marked.select(*block, "token", F.col("unit").alias(side), F.col("n").alias(f"n_{side}"), F.col("place").alias(f"at_{side}")) for side in "ab")
    bound = F.lit(1) + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9) & (bound >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9)
    return scratch.write(a.join(b, [*block, "token"]).where(fits).select(*block, "a", "b").distinct(), "pairs")


def _compared(profiles: DataFrame, block: list[str], key: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, judged).

    profiles still have their ``text``: it is read again for the units that may be near another, for their dates and
    shingles, so that no table of all shingles is written or dealt.

    members: block, key, unit, named, ok, group, group_size, where a group has equal words, dates and periods of
    the name and enough text (or not); classes: block, unit, named, class, members of the units that may be near
    another, equal also in dates of the text and length; judged: pairs of classes with their verdict.
    """
    named = F.md5(F.to_json(F.struct("name_dates", "name_periods")).cast("binary"))
    ok = F.coalesce(F.col("chars") >= TEXT_MIN, F.lit(False))
    unit = F.coalesce(F.unhex(F.md5(F.col("norm").cast("binary"))), F.lit(b""))
    held = scratch.write(profiles.select(*block, key, unit.alias("unit"), named.alias("named"), "chars", ok.alias("ok")), "profiles")
    whole = [*block, "unit", "named", "ok"]
    members = held.join(held.groupBy(*whole).agg(F.min(key).alias("group"), F.count("*").alias("group_size")), whole)
    long = profiles.where(F.col("chars") >= TEXT_MIN)
    pairs = near_candidates(long.select(*block, unit.alias("unit"), "shingles"), block, scratch, frequent(long.select(key, "shingles"), key))
    met = pairs.select(*block, F.explode(F.array("a", "b")).alias("unit")).distinct()
    docs = held.where("ok").drop("ok").join(met, [*block, "unit"], "left_semi")
    one = docs.withColumn("first", F.row_number().over(Window.partitionBy(*block, "unit").orderBy(key)) == 1)
    found = dt.dates(F.col(text), tx.fold_latin(F.col(text)))
    sets = F.when(F.col("first"), tx.hashed_shingles(tx.canonical(F.col(text)))).alias("shingles")
    read = profiles.select(*block, key, text).join(one, [*block, key]).select(*block, key, "unit", "named", "chars", "first", F.md5(F.to_json(F.struct(found.alias("d"))).cast("binary")).alias("dated"), sets)
    classed = scratch.write(read, "dated")
    units = lambda name: classed.where("first").select(*block, F.col("unit").alias(name), F.col("shingles").alias(f"s_{name}"))
    scored = pairs.join(units("a"), [*block, "a"]).join(units("b"), [*block, "b"]).select(*block, "a", "b", tx.jaccard(F.col("s_a"), F.col("s_b")).alias("score"))
    near = scratch.write(scored.where(F.col("score") >= JACCARD_MIN), "near")
    classed = classed.drop("first", "shingles")
    classes = classed.groupBy(*block, "unit", "named", "dated", "chars").agg(F.min(key).alias("class"), F.count("*").alias("size"))
    side = lambda name: classes.select(*block, "named", F.col("unit").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("dated", "chars", "class", "size")])
    both = near.join(side("a"), [*block, "a"]).join(side("b"), [*block, "b", "named"])
    reason = (
        F.when(F.col("dated_a") != F.col("dated_b"), "DATES_TEXTE_DIFFERENTES")
        .when(F.least("chars_a", "chars_b") / F.greatest("chars_a", "chars_b") < LENGTH_RATIO_MIN, "LONGUEURS_ECARTEES").otherwise("QUASI_IDENTIQUE")
    )
    judged = scratch.write(both.select(*block, "class_a", "class_b", "size_a", "size_b", (reason == "QUASI_IDENTIQUE").alias("copy"), "score", reason.alias("reason")), "judged")
    keyed = classed.join(classes.drop("size"), [*block, "unit", "named", "dated", "chars"]).select(*block, key, "class")
    return members, keyed, judged


def confirmed_pairs(profiles: DataFrame, block: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, a, b, copy, score, reason: pairs of one block with equal dates and periods of the name.

    Documents of equal words and name dates are copies of each other: each is paired with the smallest key
    among them. Documents that are also equal in dates of the text and length are one class; classes of
    different words are paired by their smallest keys, if they share nine tenths of their shingles. Between
    texts that differ no copy is missed; pairs with other name dates, which are never copies, are left out.
    A null text is no copy of anything.
    """
    members, _, judged = _compared(profiles, block, key, text, Scratch(profiles.sparkSession, "copies"))
    same = members.where(F.col(key) != F.col("group"))
    same = same.select(*block, F.col("group").alias("a"), F.col(key).alias("b"), F.col("ok").alias("copy"), F.col("ok").cast("double").alias("score"), F.when(F.col("ok"), "TEXTE_IDENTIQUE").otherwise("TEXTE_TROP_COURT").alias("reason"))
    return judged.select(*block, F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "copy", "score", "reason").unionByName(same)


def copy_groups(profiles: DataFrame, block: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, key, group, links of every document: the smallest key that is reached through copies, and of how many
    documents it is a copy itself. Copies are counted by classes, never written out."""
    scratch = Scratch(profiles.sparkSession, "copies")
    members, keyed, judged = _compared(profiles, block, key, text, scratch)
    copies = judged.where("copy")
    ends = copies.select("class_a", "class_b").unionByName(members.where(F.col("ok") & (F.col(key) != F.col("group"))).select(F.col("group").alias("class_a"), F.col(key).alias("class_b")))
    found = connected_components(ends, "class_a", "class_b", scratch)
    one_way = [copies.select(*block, F.col(f"class_{x}").alias("class"), F.col(f"size_{y}").alias("more")) for x, y in ("ab", "ba")]
    more = one_way[0].unionByName(one_way[1]).groupBy(*block, "class").agg(F.sum("more").alias("more"))
    linked = keyed.join(more, [*block, "class"]).select(*block, key, "more")
    rows = members.join(linked, [*block, key], "left").join(found.select(F.col("node").alias(key), "component"), key, "left")
    links = F.when(F.col("ok"), F.col("group_size") - 1 + F.coalesce("more", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return rows.select(*block, key, F.coalesce("component", key).alias("group"), links.alias("links"))


# Words that say a file is signed, or the one that counts.
SIGNED, AUTHORITATIVE = "sign[ée]e?\\b|signed\\b", "\\bvf\\b|\\bdef(initif|initive)?\\b|\\bfinal(e|isee?)?\\b"


def best_copy(name: Column, chars: Column) -> Column:
    """What the copy to keep has most of: a signature, a mark that it is the final one, text."""
    low = F.regexp_replace(tx.fold_latin(name), "_", " ")
    return F.struct(low.rlike(SIGNED).alias("signed"), low.rlike(AUTHORITATIVE).alias("final"), chars.alias("chars"))


def kept_of(groups: DataFrame, group: list[str], key: str, choice: Column) -> DataFrame:
    """groups with keep (the member of the greatest ``choice``, then the smallest key) and ref, the key that is kept."""
    same = Window.partitionBy(*group)
    first = Window.partitionBy(*group).orderBy(F.desc("choice_"), key)
    ranked = groups.withColumn("choice_", choice).withColumn("keep", F.row_number().over(first) == 1)
    return ranked.withColumn("ref", F.max(F.when(F.col("keep"), F.col(key))).over(same)).drop("choice_")


# The rules that a client's file may replace.
DEFAULT_RULES = {
    "version_markers": [
        r"\bv\s?\d+\b", r"\bversion\s*\d*\b", r"\bvf\b", r"\bdef(initif|initive)?\b", r"\bfinal(e|ise|isee)?\b", r"\bprojet\b", r"\bbrouillon\b", r"\bdraft\b",
        r"\brelu\b", r"\bcorrig(e|ee)\b", r"\bmodifi(e|ee)\b", r"\bsigne?e?\b", r"\bsigned\b",
    ],
    "copy_markers": [r"\(\d+\)", r"\bcopie\b", r"\bcopy\b", r"[-_ ]+\d{1,2}$"], "authoritative_markers": [SIGNED, AUTHORITATIVE], "variant_suffixes": [], "variant_keep": "original",
    "publipostage_min_famille": 12, "containment_min": 0.95, "stem_min_len": 8,
}


def rules(overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """The rules with a client's own; a list is replaced whole, a name that is not known is an error."""
    given = {k: v for k, v in (overrides or {}).items() if k != "_comment"}
    if unknown := sorted(set(given) - set(DEFAULT_RULES)):
        raise ValueError(f"unknown rules: {unknown}")
    return {**DEFAULT_RULES, **given}


def document_groups(documents: DataFrame) -> DataFrame:
    """documents with doc_group (type, year or NODATE, property) and is_reference, true as long as no model says otherwise."""
    year = F.coalesce(F.col("year").cast("string"), F.lit("NODATE"))
    kind = F.coalesce("doc_type_fixed", "doc_type", F.lit("AUTRE"))
    return documents.withColumn("doc_group", F.concat_ws("_", kind, year, F.coalesce("code", F.lit("")))).withColumn("is_reference", F.lit(True))


def with_references(grouped: DataFrame, verdicts: DataFrame) -> DataFrame:
    """grouped with a model's verdicts (doc_group, reference, copies): copies are no reference and join its group's."""
    told = verdicts.select(F.col("doc_group").alias("g_"), F.explode("copies").alias("copy_")).distinct()
    both = grouped.join(told, (F.col("doc_group") == F.col("g_")) & (F.col("file_name") == F.col("copy_")), "left")
    return both.withColumn("is_reference", F.col("copy_").isNull()).drop("g_", "copy_")


def consolidated(documents: DataFrame, mapping: DataFrame, column: str = "subtype") -> DataFrame:
    """documents with a sub-type's canonical form where the mapping (raw, canonical) has one; both sides are normalised alike."""
    known = mapping.select(tx.subtype(F.col("raw")).alias("raw_"), tx.subtype(F.col("canonical")).alias("to_")).groupBy("raw_").agg(F.min("to_").alias("to_"))
    return documents.join(known, tx.subtype(F.col(column)) == F.col("raw_"), "left").withColumn(column, F.coalesce("to_", tx.subtype(F.col(column)))).drop("raw_", "to_")


def stem(name: Column, copy: str = "\\b(copie|copy)( de)?\\b|\\(\\d+\\)", version: str = "\\b(v ?\\d+|version ?\\d*|vf|vdef|final|definitif|projet)\\b", variant: str = "_?(rgpd|anonymise)\\b") -> Column:
    """A file name without extension, variant, dates, and copy and version marks."""
    s = F.regexp_replace(tx.fold_latin(name), "\\.[a-z0-9]{2,5}$", "")
    s = F.regexp_replace(s, variant, " ")
    s = F.regexp_replace(s, "(?<!\\d)\\d{1,2}[/._ -]\\d{1,2}[/._ -]\\d{2,4}(?!\\d)|(?<!\\d)(19|20)\\d{6}(?!\\d)|(?<!\\d)(19|20)\\d{2}(?!\\d)", " ")
    s = F.regexp_replace(s, "_", " ")
    for _ in range(3):
        s = F.regexp_replace(F.regexp_replace(s, copy, " "), version, " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def stem_by(name: Column, given: dict[str, Any]) -> Column:
    """``stem`` with the markers of ``rules``; the order is extension, variants, dates, copies and versions."""
    union = lambda key: "|".join(f"(?:{p})" for p in given[key]) or "(?!)"
    suffixes = "|".join(re.escape(x) for x in given["variant_suffixes"])
    return stem(name, union("copy_markers"), union("version_markers"), f"(?:{suffixes})\\s*$" if suffixes else "(?!)")


def version_families(profiles: DataFrame, folder: str = "folder", version: str = "\\b(v ?\\d+|version ?\\d*|vf|vdef|final|definitif|projet)\\b") -> DataFrame:
    """Earlier versions: source_file, ref_source_file, score. Families of 2 to FAMILY_MAX files of one
    folder and stem; the reference has the highest version number, then time, then length."""
    low = F.regexp_replace(tx.fold_latin(F.col("file_name")), "_", " ")
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(low, "\\bv ?(\\d+)\\b", 1), F.lit("")), F.lit("9999")).cast("int"), F.lit(-1))
    rows = profiles.withColumn("stem", stem(F.col("file_name"))).where(F.length("stem") >= STEM_MIN).withColumn("explicit", low.rlike(version))
    family = Window.partitionBy(folder, "stem")
    rank = F.struct(number.alias("v"), F.coalesce("mtime", F.lit(0)).alias("t"), F.col("chars").alias("n"), F.col("source_file").alias("s"))
    rows = rows.withColumn("members", F.count("*").over(family)).where(F.col("members").between(2, FAMILY_MAX)).withColumn("rank", rank)
    rows = rows.withColumn("any_explicit", F.max("explicit").over(family)).withColumn("best", F.max("rank").over(family))
    ref = rows.where("rank = best").select(folder, "stem", F.struct("source_file", "shingles", "text_dates", "name_dates", "name_periods").alias("ref"))
    both = rows.where("rank <> best").join(ref, [folder, "stem"])
    score = tx.containment(F.col("shingles"), F.col("ref.shingles"))
    fits = (F.col("name_dates") == F.col("ref.name_dates")) & (F.col("name_periods") == F.col("ref.name_periods")) & (score >= CONTAINMENT_MIN) & (F.col("any_explicit") | (F.col("text_dates") == F.col("ref.text_dates")))
    return both.where(fits).select("source_file", F.col("ref.source_file").alias("ref_source_file"), F.round(score, 4).alias("score"), F.lit("VERSION_ANTERIEURE").alias("reason"))


def variants(profiles: DataFrame, folder: str = "folder", suffix: str = "_rgpd", keep: str = "original") -> DataFrame:
    """Pairs of a file and its variant by suffix in one folder, if one holds the other's text."""
    low = tx.fold_latin(F.col("file_name"))
    rows = profiles.withColumn("plain", F.regexp_replace(low, suffix, "")).withColumn("is_variant", low != F.regexp_replace(low, suffix, ""))
    a = rows.where("not is_variant").select(folder, "plain", F.col("source_file").alias("original"), F.col("shingles").alias("original_shingles"))
    b = rows.where("is_variant").select(folder, "plain", F.col("source_file").alias("variant"), "shingles")
    score = tx.containment(F.col("shingles"), F.col("original_shingles"))
    gone, ref = ("variant", "original") if keep == "original" else ("original", "variant")
    return a.join(b, [folder, "plain"]).where(score >= CONTAINMENT_MIN).select(F.col(gone).alias("source_file"), F.col(ref).alias("ref_source_file"), F.round(score, 4).alias("score"), F.lit("VARIANTE").alias("reason"))


def flagged(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """chunks with excluded, reason and ref_source_file of their document's flag."""
    f = flags.groupBy("source_file").agg(F.min_by("ref_source_file", "reason").alias("ref_source_file"), F.min("reason").alias("reason"))
    return chunks.drop("ref_source_file", "reason").join(f, "source_file", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)) | F.col("reason").isNotNull())
