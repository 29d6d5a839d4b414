"""Records of claims and policies: projections of an ERP's answers, folders, perils, windows of text, questions, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import incremental

# The roots below which claim folders lie, and levels that only sort them.
CLAIM_ROOT, ARCHIVE_ROOT, SORTING_LEVEL = "(?iu)^(\\d+\\s*-\\s*)?sinistres?$", "(?iu)^dossiers$", "(?iu)^(\\d+\\s*-\\s*)?(dde|mri|incendie|en cours|clos|clotures?|archives?)$"
# What a folder's name says about the peril, in order; the last two are never above a named one.
PERILS = (("INCENDIE", "(?iu)INCENDIE"), ("DDE", "(?iu)\\bDDE\\b|\\bDGE\\b|D[EÉ]G[AÂ]TS?\\s+DES\\s+EAUX|D[EÉ]G[AÂ]T\\s+EAUX"), ("MRI", "(?iu)\\bMRI\\b|MULTIRISQUE"))
# Types whose text is read at both ends, and how many characters are read.
BOTH_ENDS, END_CHARS, HEAD_CHARS = ("CONTRAT", "BUDGET", "COMPTABILITE", "SINISTRE", "ASSURANCE"), 1500, 2000
# Fixed value: the characters of Unicode's class Zs.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Chunks for which questions are made.
ASKED_TYPES, UNASKED_CATEGORIES = ("PV_AG", "RCP", "CONTRAT"), ("PROCEDURE_AG", "ELECTION_CS")


def first_of(c: Column) -> Column:
    """The first of a list, null for none."""
    return F.get(c, F.lit(0))


def names_of(rows: DataFrame, ids: str, names: DataFrame, out: str, key: str = "record_id") -> DataFrame:
    """rows with ``out``, the names (id, name) of the ids in a list, in its order and joined by commas; unknown ids are left out."""
    one = rows.select(F.col(key).alias("k_"), F.posexplode(ids).alias("at_", "id_")).join(names.select(F.col("id").alias("id_"), F.col("name").alias("name_")), "id_")
    text = one.groupBy("k_").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at_", "name_"))), lambda x: x["name_"]), ", ").alias(out))
    return rows.join(text, F.col(key) == F.col("k_"), "left").drop("k_")


def projected(rows: DataFrame, fields: dict[str, str], first: Sequence[str] = (), counted: dict[str, str] | None = None) -> DataFrame:
    """record_id and the fields (new name: old one), of lists in ``first`` their first value, in ``counted`` their length.

    A field that the source has not is null: answers leave empty fields out.
    """
    has = set(rows.columns)
    value = lambda old: F.col(f"`{old}`") if old in has else F.lit(None).cast("string")
    out = [F.col("record_id"), *[(first_of(value(old)) if new in first and old in has else value(old)).alias(new) for new, old in fields.items()]]
    return rows.select(*out, *[(F.coalesce(F.size(value(old)), F.lit(0)) if old in has else F.lit(0)).alias(new) for new, old in (counted or {}).items()])


def claim_folder(path: Column) -> Column:
    """The claim's folder below the claims root, else below an archive's; empty if there is none."""
    below = tx.segment_after(path, CLAIM_ROOT, SORTING_LEVEL)
    return F.coalesce(below, tx.segment_after(path, ARCHIVE_ROOT, SORTING_LEVEL), F.lit(""))


def peril(folder: Column, voted: Column) -> Column:
    """The peril that a folder's name states, else what the documents' vote gives."""
    said = F.lit(None).cast("string")
    for name, pattern in reversed(PERILS):
        said = F.when(folder.rlike(pattern), name).otherwise(said)
    return F.coalesce(said, voted)


def extraction_window(chunks: DataFrame) -> DataFrame:
    """source_file, doc_type, window: the characters of a document that metadata are read from.

    Opening of HEAD_CHARS, or opening and end of END_CHARS each for some types. Only the chunks that these
    can reach are collected for a document; one that begins or ends right at the limit still puts its line feed
    there. Null texts are skipped, a document without any other has no window. What is trimmed are spaces of
    every kind (SPACES), no line feeds.
    """
    size = F.coalesce(F.length("text") + 1, F.lit(0))
    whole = Window.partitionBy("source_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = chunks.withColumn("before", F.sum(size).over(whole.orderBy("chunk_index", "text")) - size).withColumn("after", F.sum(size).over(whole.orderBy(F.desc("chunk_index"), F.desc("text"))) - size)
    both = F.col("doc_type").isin(list(BOTH_ENDS))
    first, last = F.col("before") <= F.when(both, END_CHARS).otherwise(HEAD_CHARS), both & (F.col("after") <= END_CHARS)
    joined = lambda where: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("chunk_index", "text")))), lambda x: x["text"]), "\n")
    texts = reach.where(first | last).groupBy("source_file").agg(F.min("doc_type").alias("doc_type"), joined(first).alias("head"), joined(last).alias("tail"), F.count("text").alias("known"))
    trimmed = lambda c: F.trim(c, F.lit(SPACES))
    ends = F.concat_ws("\n\n[...]\n\n", trimmed(F.substring("head", 1, END_CHARS)), trimmed(F.right("tail", F.lit(END_CHARS))))
    window = F.when(F.col("doc_type").isin(list(BOTH_ENDS)), ends).otherwise(trimmed(F.substring("head", 1, HEAD_CHARS)))
    return texts.select("source_file", "doc_type", F.when(F.col("known") > 0, window).alias("window"))


def worth_asking(chunks: DataFrame) -> DataFrame:
    """Chunks for which questions are made: of three types, behind the preamble, about substance."""
    return chunks.where(F.col("doc_type").isin(list(ASKED_TYPES)) & (F.col("chunk_index") > 0) & (F.col("category").isNull() | ~F.col("category").isin(list(UNASKED_CATEGORIES))))


def questions(answer: Column) -> Column:
    """The questions in a model's answer, joined: lines without their number that end with ? and are longer than 15
    characters; null if there is none or the model skips."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(F.trim(x), "^[0-9.\\-) ]+", ""))
    kept = F.filter(lines, lambda x: x.endswith("?") & (F.length(x) > 15))
    return F.when(~F.upper(answer).startswith("SKIP") & (F.size(kept) > 0), F.array_join(kept, " "))


def claim_view(cases: DataFrame, most: int = 4000) -> DataFrame:
    """case_id and ``view``: a claim as one text of labelled lines, absent values left out, flags for what is late or unpaid."""
    line = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{label}: "), c.cast("string")))
    flags = F.array_compact(F.array(F.when((F.col("status") != "CLOTURE") & F.col("opened").isNull(), "DATE_INCONNUE"), F.when(F.col("amount") > F.coalesce("indemnity", F.lit(0.0)), "RESTE_A_CHARGE")))
    rows = F.array_compact(F.array(line("Dossier", F.col("case_id")), line("Type", F.col("case_type")), line("Statut", F.col("status")), line("Ouverture", F.date_format("opened", "dd/MM/yyyy")), line("Lésé", F.col("party")), line("Montant", F.format_string("%.2f €", "amount")), line("Alertes", F.nullif(F.array_join(flags, ", "), F.lit("")))))
    return cases.select("case_id", F.substring(F.array_join(rows, "\n"), 1, most).alias("view"))


def purged_then_upserted(old: DataFrame, new: DataFrame, key: str, code: str, keep: Column, update: Sequence[str]) -> DataFrame:
    """New rows of some properties: old rows of these that ``keep`` does not hold for go first, then rows are upserted by key."""
    touched = new.select(F.col(code).alias("touched_")).distinct()
    marked = old.join(touched, F.col(code) == F.col("touched_"), "left").where(F.col("touched_").isNull() | F.coalesce(keep, F.lit(False))).drop("touched_")
    return incremental.upsert(marked, new, [key], update=list(update))


def refreshed(stored: DataFrame, current: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """stored summaries with those replaced whose measures are no longer current, and missing ones added; properties
    without anything to tell (all measures 0 or null) get none."""
    gone_stale = incremental.stale(stored, current, key, measures).select(key)
    some = current.join(gone_stale, key, "left_semi").where(F.greatest(*[F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in measures], F.lit(0.0)) > 0)
    return incremental.upsert(stored, some.select(stored.columns), [key])


def live_sessions(sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The newest state of each session (session_id, updated_at, deleted and more) that is younger than ``hours`` and not deleted.

    Of states of one time a deletion counts, then the last by the other columns. States without a session are left out.
    """
    rest = [c for c in sessions.columns if c not in ("session_id", "updated_at", "deleted")]
    state = F.struct("updated_at", F.coalesce(F.col("deleted"), F.lit(False)).alias("deleted"), *rest)
    newest = sessions.where("session_id is not null").groupBy("session_id").agg(F.max(state).alias("state")).select("session_id", "state.*")
    return newest.where((F.col("updated_at") > now - F.expr(f"interval {hours} hours")) & ~F.col("deleted")).drop("deleted").select(*[c for c in sessions.columns if c != "deleted"])


# Fields of a claim that may be empty and are then taken from the record it absorbs.
ABSORBED = ("case_type", "party", "opened", "amount", "indemnity")


def absorbed(erp: DataFrame, found: DataFrame, matches: DataFrame, fields: Sequence[str] = ABSORBED) -> tuple[DataFrame, DataFrame]:
    """(ERP cases whose empty fields are filled from their match (erp_id, case_id), found cases that none absorbed)."""
    other = found.select(F.col("case_id").alias("other_"), *[F.col(f).alias(f"{f}_") for f in fields])
    both = erp.join(matches.select("erp_id", F.col("case_id").alias("match_")), F.col("case_id") == F.col("erp_id"), "left").join(other, F.col("match_") == F.col("other_"), "left")
    value = lambda f: F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.col(f"{f}_")).otherwise(F.col(f))
    filled = both.select(*[value(c).alias(c) if c in fields else F.col(c) for c in erp.columns], F.col("match_").alias("absorbed"))
    return filled, found.join(matches.select("case_id"), "case_id", "left_anti")


# States of a step; the first that occurs holds.
STEP_ORDER = ("FAIT", "EN_COURS", "A_FAIRE")


def united_steps(steps: DataFrame, group: str = "cluster") -> DataFrame:
    """One state for each step of a cluster (cluster, step, state): the furthest of those its members have."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STEP_ORDER)), F.col("state")), F.lit(0)), F.lit(len(STEP_ORDER) + 1))
    return steps.groupBy(group, "step").agg(F.min_by("state", F.struct(order.alias("o"), F.col("state").alias("s"))).alias("state"))


def furthest(column: str, order: Sequence[str]) -> Column:
    """Aggregate: the value that stands last in ``order``; values that do not stand there come first."""
    return F.max_by(F.col(column), F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0)))
