"""The ingestion registry: the state of every file from what the stages of an ingestion left behind.

All artefacts are one tagged table, grouped by file once: a shuffle of short rows, however many
artefacts there are, with the many chunks of a file summed before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, decisions of the filter, and reasons.
STATUSES = ("INGERE", "REJETE", "ERREUR", "SUPPRIME", "EN_COURS", "DECOUVERT")
KEPT, GOOGLE, COPY_FAILED = "GARDER", "EXCLURE_GOOGLE_NATIF", "ERREUR_COPIE"
PICTURES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".gif", ".heic", ".webp")

_FIELDS = {
    "decision": "string", "extension": "string", "sha256": "string", "size": "long", "kept": "string", "signature": "string", "chars": "long", "skipped": "boolean", "doc_type": "string", "fixed_type": "string",
}


def _tagged(rows: DataFrame, kind: str, **fields: str) -> DataFrame:
    """source_file and kind, the named fields from columns of rows, the other fields null."""
    columns = [F.col(fields[c]).cast(t).alias(c) if c in fields else F.lit(None).cast(t).alias(c) for c, t in _FIELDS.items()]
    return rows.select(F.col("source_file"), F.lit(kind).alias("kind"), *columns).where("source_file is not null")


def registry(
    decisions: DataFrame, duplicates: DataFrame, signatures: DataFrame, extracted: DataFrame, chunked: DataFrame, metadata: DataFrame, loaded: DataFrame, previous: DataFrame | None = None, running: bool = False
) -> DataFrame:
    """One row for each file that the filter saw (and for each of ``previous`` that it no longer sees).

    decisions (source_file, decision, extension); duplicates (source_file, sha256, size, kept: the file kept, or the
    file itself); signatures (source_file, signature); extracted (source_file, chars, skipped: unreadable);
    chunked (source_file, doc_type) and loaded (source_file): a row for each chunk written and stored; metadata
    (source_file, doc_type). Of several rows of one artefact the last by value counts.

    A fact beats a decision: what is stored is INGERE, whatever was decided before; chunks that are not stored are
    ERREUR. Of the others what was rejected stays so; a kept file without text is VIDE, with text but without
    chunks NON_EXPLOITABLE or DOUBLON_PROCHE; while a run is ``running`` these two are EN_COURS and DECOUVERT instead.
    drift lists what does not fit: rejected yet stored, stored without chunks written, other numbers of chunks.
    """
    parts = [
        _tagged(decisions, "decision", decision="decision", extension="extension"), _tagged(duplicates, "duplicate", sha256="sha256", size="size", kept="kept"), _tagged(signatures, "signature", signature="signature"),
        _tagged(extracted, "extracted", chars="chars", skipped="skipped"), _tagged(chunked, "chunk", doc_type="doc_type"), _tagged(metadata, "metadata", fixed_type="doc_type"), _tagged(loaded, "loaded"),
    ]
    parts += [_tagged(previous, "previous")] if previous is not None else []
    of = lambda kind: F.col("kind") == kind
    said = F.max(F.when(of("decision"), F.struct("decision", F.lower("extension").alias("extension"))))
    removed = of("duplicate") & (F.col("kept") != F.col("source_file"))
    one = reduce(DataFrame.unionByName, parts).groupBy("source_file").agg(
        said.alias("said"), F.max("sha256").alias("sha256"), F.max("size").alias("size"), F.max(F.when(removed, F.col("kept"))).alias("ref_source_file"), F.max("signature").alias("signature"),
        F.count_if(of("extracted")).alias("texts"), F.max("chars").alias("chars"), F.max("skipped").alias("skipped"), F.count_if(of("chunk")).alias("written"), F.count_if(of("loaded")).alias("stored"),
        F.coalesce(F.max("fixed_type"), F.max("doc_type")).alias("doc_type"), F.count_if(of("previous")).alias("before"),
    ).where("said is not null or before > 0")
    judged = one.withColumn("decided", _decided()).withColumn("state", _state(running))
    drift = F.array_compact(
        F.array(
            F.when(((F.col("stored") > 0) | (F.col("written") > 0)) & (F.col("decided.status") == "REJETE"), F.concat(F.lit("INGERE_MALGRE_"), F.col("decided.reason"))),
            F.when((F.col("stored") > 0) & (F.col("written") == 0), "INGERE_HORS_SHARD"), F.when((F.col("stored") > 0) & (F.col("written") > 0) & (F.col("stored") != F.col("written")), "CHUNKS_HORS_SHARD"),
        )
    )
    n = F.when(F.col("stored") > 0, F.col("stored")).when(F.col("written") > 0, F.col("written"))
    shown = F.when((F.col("stored") > 0) | (F.col("written") > 0), F.col("doc_type"))
    return judged.select("source_file", "state.*", "sha256", "size", "signature", "chars", n.alias("n_chunks"), shown.alias("doc_type"), "ref_source_file", F.when(F.col("said").isNotNull(), drift).otherwise(F.array().cast("array<string>")).alias("drift"))


def _out(status: str, reason: str | None, step: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), F.lit(step).alias("step"))


def _decided() -> Column:
    """What the filter and the search for exact copies decided."""
    decision, picture = F.col("said.decision"), F.col("said.extension").isin(list(PICTURES))
    return (
        F.when(F.col("ref_source_file").isNotNull(), _out("REJETE", "DOUBLON_EXACT", "00b")).when(decision == KEPT, _out("DECOUVERT", None, "01")).when(decision == GOOGLE, _out("REJETE", "FILTRAGE_GOOGLE_NATIF", "01"))
        .when(decision == COPY_FAILED, _out("ERREUR", "COPIE_KO", "01")).when(picture, _out("REJETE", "FILTRAGE_PHOTO", "01")).otherwise(_out("REJETE", "FILTRAGE_AUTRE", "01"))
    )


def _state(running: bool) -> Column:
    near = F.when(F.col("skipped"), _out("REJETE", "NON_EXPLOITABLE", "03")).otherwise(_out("REJETE", "DOUBLON_PROCHE", "03"))
    return (
        F.when(F.col("said").isNull(), _out("SUPPRIME", None, "01")).when(F.col("stored") > 0, _out("INGERE", None, "06b")).when(F.col("written") > 0, _out("EN_COURS", None, "03") if running else _out("ERREUR", "CHARGEMENT_KO", "06b"))
        .when(F.col("decided.status") != "DECOUVERT", F.col("decided")).when(F.col("texts") > 0, _out("EN_COURS", None, "02") if running else near).otherwise(F.col("decided") if running else _out("REJETE", "TEXTE_VIDE", "02"))
    )


def counters(rows: DataFrame) -> DataFrame:
    """kind, name, n: files by status, by reason, and by what does not fit."""
    names = F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")), F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("name")))
    every = F.concat(names, F.transform("drift", lambda d: F.struct(F.lit("drift").alias("kind"), d.alias("name"))))
    return rows.select(F.inline(every)).where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))
