"""Models as columns: a provider turns text columns into an answer column. The stubs are deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[..., Column]


def hashed_embedding(size: int = 64, most: int = 5000) -> Provider:
    """A stub for an embedding: signed word hashes of the first ``most`` characters, of length one."""

    def run(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.substring(text, 1, most)), "\\W+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.xxhash64(w))
        raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(slots, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == k, F.when(F.shiftright(h, 20) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
        return F.transform(F.array(raw), lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))[0])[0]

    return run


def closed_label(labels: tuple[str, ...], fallback: str, answer: Provider | None = None) -> Provider:
    """A label of a closed set: what ``answer`` gives if it is one, else the fallback."""

    def run(*inputs: Column) -> Column:
        said = F.upper(F.trim(answer(*inputs))) if answer else F.lit(None).cast("string")
        return F.when(said.isin(list(labels)), said).otherwise(fallback)

    return run


def rerank_overlap(terms: tuple[str, ...]) -> Provider:
    """A stub for a reranker: the share of query terms in the passage."""
    return lambda passage: sum((F.lower(passage).contains(t.lower()).cast("double") for t in terms), F.lit(0.0)) / max(1, len(terms))


def relevance_gate(words: tuple[str, ...]) -> Provider:
    """True if the question has one of the words; true as well for a null question: it fails open."""
    return lambda question: F.coalesce(F.arrays_overlap(F.split(F.lower(question), "\\W+"), F.array(*map(F.lit, words))), F.lit(True))


def enriched(df: DataFrame, column: str, provider: Provider, *inputs: str) -> DataFrame:
    return df.withColumn(column, provider(*map(F.col, inputs)))


def hashed_answer(fields: dict[str, str], answer: Provider | None = None) -> Provider:
    """A struct of fields (name: SQL type) from a model's JSON answer; fields that it leaves out, and all of them for
    text that is no JSON, are null."""
    schema = ", ".join(f"{k}: {t}" for k, t in fields.items())
    nothing = F.struct(*[F.lit(None).cast(t).alias(k) for k, t in fields.items()])

    def run(*inputs: Column) -> Column:
        if answer is None:
            return nothing
        said = answer(*inputs)
        body = F.regexp_extract(F.coalesce(said, F.lit("")), "(?s)\\{.*\\}", 0)
        return F.coalesce(F.from_json(body, f"struct<{schema}>"), nothing)

    return run


# What a document's and a case's metadata consist of.
DOCUMENT_FIELDS = {"doc_type_fixed": "string", "subtype": "string", "date": "string", "year": "int", "parties": "array<string>", "status": "string", "amount": "double", "case_id": "string", "summary": "string"}
CASE_FIELDS = {
    "case_type": "string", "name": "string", "status": "string", "opened": "string", "closed": "string", "party": "string", "lot": "string", "liable": "string", "expert": "string", "insurer": "string", "claim_number": "string", "policy_number": "string", "steps": "array<string>",
}


def shrinking(embed: Provider, most: int = 5000, factor: float = 0.7, tries: int = 4) -> Provider:
    """An embedding that is asked again with less text, ``factor`` of it each time, where it gives null."""
    return lambda text: F.coalesce(*[embed(F.substring(text, 1, round(most * factor**k))) for k in range(tries)])
