"""The tools that a caller asks for: each checks its arguments and returns one DataFrame, or an error."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import analytics, incremental, lookup, overview, records, search
from foliospark.plans.providers import Provider

MAX_RESULTS = 50


def scope(codes: Sequence[str]) -> dict[str, Any]:
    """Canonical codes in order without repeats, and whether they name none, one or several properties."""
    seen = list(dict.fromkeys("".join(ch for ch in c.upper() if ch.isascii() and ch.isalnum()) for c in codes if c))
    return {"codes": seen, "scope": ("global", "single", "multi")[min(2, len(seen))]}


def refuse_scope(named: dict[str, Any], valid: bool = False) -> dict[str, Any] | None:
    """None for one property or more, else an error with the tool to ask first; with ``valid`` codes must have a code's form."""
    if named["scope"] == "global":
        return {"error": "a property code is needed", "next": "discover"}
    wrong = [c for c in named["codes"] if not re.fullmatch(r"[A-Z]{2}\d{7}|\d{4,6}", c)]
    return {"error": "not the form of a property code", "value": wrong, "next": "list_properties"} if valid and wrong else None


def search_chunks(chunks: DataFrame, documents: DataFrame, vector: Sequence[float], terms: Sequence[str], codes: Sequence[str], mode: str = "balanced", limit: object = 12, types: Sequence[str] = (), condition: Column | None = None, quota: int = 0, rerank: Provider | None = None, per_source: int | None = None, first: int | None = None, last: int | None = None, question: str = "") -> DataFrame | dict[str, Any]:
    """Scoped hybrid search: prefilter, both ranks, fusion, diversity, repeated texts, cap by source, rerank, balance or quota.

    ``rerank`` is a model of passages; without it, or where it gives no score, the fused order stays. A span
    ``first`` to ``last`` of three years or more is asked year by year.
    """
    if refused := refuse_scope(scope(codes)):
        return refused
    if mode not in search.MODES:
        return {"error": "unknown mode", "allowed": list(search.MODES)}
    n, (cap, least) = lookup.clamp(limit, 12, MAX_RESULTS), search.MODES[mode]
    base = search.base(chunks, codes)
    if condition is not None and (files := search.prefilter(documents, condition)):
        groups = documents.where(F.col("source_file").isin(files)).select("doc_group").distinct().count()
        base, cap, least = base.where(F.col("source_file").isin(files)), search.dynamic_cap(n, groups), 0.05
    rows = base.join(documents.select("source_file", "doc_group", "year", "status"), "source_file", "left")
    rows = rows.withColumn("query_id", F.lit(0)).withColumn("vec", search.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))).withColumn("lex", search.lexical(F.col("text"), terms))
    rows = search.without_procedure(rows, question, mode)
    spanned = first is not None and last is not None and last - first >= 2
    if first is not None and last is not None and not spanned:
        rows = rows.where(F.col("year").between(first, last))
    boost = search.type_boost(types)

    def narrowed(fused: DataFrame) -> DataFrame:
        found = search.first_of_text(search.diversified(fused, cap, least))
        return search.capped_by_source(found, per_source) if per_source else found

    if not spanned and rerank is None and len(codes) == 1 and not quota:
        return search.top_fused(rows, lambda fused: search.best(narrowed(fused), n), n, boost, most_boost=0.01 if types else 0.0)
    found = narrowed(search.fused(search.ranked_by_year(rows, first, last) if spanned else search.ranked(rows), boost))
    if rerank is not None:
        names = F.regexp_extract("source_file", "[^/]*$", 0)
        scored = found.withColumn("rerank", rerank(tx.passage(F.col("doc_type"), names, F.col("text"))))
        found = search.reranked(scored).withColumn("rrf", F.coalesce(F.col("final") + 1, F.col("rrf"))).drop("place", "in_pool", "final")  # reranked ones first
    if spanned:
        return search.yearly(found, first, last, n)
    if len(codes) > 1:
        return search.balanced(found, len(codes), n)
    return search.with_quota(found, n, F.col("doc_type") == "RCP", quota) if quota else search.best(found, n)


def run_analytical_query(spec: analytics.Spec, rows: DataFrame, most: int = 300) -> DataFrame | dict[str, Any]:
    """The planned rows, one more than ``most`` at most: the caller sees whether some are left out."""
    return analytics.validate(spec) or analytics.plan(spec, rows).orderBy(F.desc("value"), "code").limit(most + 1)


def list_properties(documents: DataFrame, chunks: DataFrame, cases: DataFrame, query: str = "") -> DataFrame:
    rows = overview.property_list(documents, chunks, cases)
    return lookup.directory(rows, ["code", "name"], query, "code") if query else rows.orderBy("code")


def discover(chunks: DataFrame, vector: Sequence[float]) -> DataFrame:
    return search.discover(chunks, vector)


def full_document(chunks: DataFrame, source_file: str, first: int = 0, last: int | None = None, budget: int = lookup.MAX_CHARS) -> DataFrame | dict[str, Any]:
    if not lookup.valid_source(source_file):
        return {"error": "a source file of three characters or more without wildcards is needed"}
    return lookup.document_text(chunks.where(F.col("source_file") == source_file), first, last, budget).orderBy("chunk_index")


def get_chunks(chunks: DataFrame, ids: Sequence[str]) -> DataFrame:
    return lookup.by_ids(chunks, ids)


def search_cases(cases: DataFrame, question: str, limit: object = 20) -> DataFrame:
    """Cases by weighted hits of references, names and words of a question; none is left out, the best come first."""
    words = [w for w in question.split() if len(w) >= 3]
    references = [w for w in words if any(ch.isdigit() for ch in w)]
    names = [w for w in words if w[0].isupper() and w not in references]
    rest = [w for w in words if w not in references and w not in names]
    score = lookup.relevance(references, names, rest, F.lower(F.concat_ws(" ", "case_id", "party", "case_type", "status")))
    return cases.withColumn("score", score).orderBy(F.desc("score"), F.desc_nulls_last("opened"), "case_id").limit(lookup.clamp(limit, 20, MAX_RESULTS))


def find_links(registry: DataFrame, name: str) -> DataFrame:
    """Entries of a keyword registry whose key holds the name, accents and case aside."""
    return registry.where(tx.fold_latin(F.col("key")).contains(tx.fold_latin(F.lit(name))))


def property_overview(documents: DataFrame, code: str, stored: DataFrame | None = None) -> DataFrame:
    """Facts of a property and, where a stored summary is given (code, n_documents, last_meeting), why it is out of date."""
    facts = overview.facts(documents.where(F.col("code") == code))
    if stored is None:
        return facts
    why = incremental.stale(stored.where(F.col("code") == code), facts, "code", ["n_documents", "last_meeting"])
    return facts.join(why, "code", "left").withColumn("fresh", F.col("reasons").isNull())


def erp_records(rows: DataFrame, fields: dict[str, str], tenant: Sequence[str], labels: str = "labels", tokens: Sequence[str] = (), searched: Sequence[str] = (), first: Sequence[str] = (), counted: dict[str, str] | None = None) -> DataFrame:
    """Records of an ERP that the tenant may see and that hold all tokens, under the names callers know."""
    seen = rows.where(lookup.allowed(labels, tenant))
    return records.projected(seen.where(lookup.all_tokens(searched, tokens)) if tokens and searched else seen, fields, first, counted)


def log_feedback(spark, path: str, rating: int, comment: str, question: str) -> None:
    """Appends one row of feedback."""
    row = spark.createDataFrame([(rating, comment, question)], "rating int, comment string, question string").withColumn("at", F.current_timestamp())
    row.write.mode("append").json(path)
