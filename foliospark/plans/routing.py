"""How a question is searched: by the years and words in it, without asking a model."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of questions that take in much, and of those that go into one text.
BROAD = (
    "tous les", "toutes les", "liste", "lister", "inventaire", "historique", "depuis", "au fil des", "combien de", "comparer", "comparaison", "entre les",
    "chaque", "ensemble des", "récapitulatif", "synthèse globale", "quels sont", "quelles sont", "y a-t-il eu", "évolution", "tendance", "progression",
)
DEEP = ("article ", "lot n°", "lot ", "résolution n°", "que dit", "que prévoit", "détaille", "explique", "dans le règlement", "dans le pv", "dans le contrat", "ce document", "ce rapport")
THEMES = {"assurance_sinistres": ("assurance", "sinistre", "dégât des eaux", "incendie")}
DOC_TYPES = {"SINISTRE": ("sinistre", "anomalie", "constat", "expertise", "dégât", "désordre")}
#: chunks of a source, boost of a theme, candidates, by the name of a strategy.
STRATEGIES = {"years": (2, 0.03, 80), "history": (2, 0.03, 80), "inventory": (2, 0.03, 80), "targeted": (8, 0.005, 50), "balanced": (3, 0.01, 50)}
# What a question asks to be reckoned, in order.
OPERATIONS = (("count", "\\b(combien|nombre)\\b"), ("sum", "\\b(total|somme|montant total|co[ûu]t)\\b"), ("list", "\\b(liste|quels|quelles|lister)\\b"))


def _any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [low.contains(w) for w in words])


def years(question: Column) -> Column:
    """The years from 2000 to 2029 that a question names, in order, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit("20[0-2][0-9]"), 0), lambda y: y.cast("int"))))


def strategy(question: Column, this_year: int) -> Column:
    """struct(name, per_source, boost, candidates, first, last): a span of more than two years between the years named,
    or since one of them, then words that take in much, then words that go deep; else balanced. A null question is balanced.
    """
    low, named = F.lower(question), years(question)
    span = F.array_max(named) - F.array_min(named)
    since = F.regexp_extract(low, "depuis\\s+20([0-2][0-9])", 1)
    name = (
        F.when(span > 2, "years").when((since != "") & (F.lit(this_year - 2000) - F.try_to_number(F.nullif(since, F.lit("")), F.lit("99")).cast("int") > 2), "history")
        .when(_any(low, BROAD), "inventory").when(_any(low, DEEP), "targeted").otherwise("balanced")
    )
    pick = lambda k: reduce(lambda rest, item: F.when(name == item[0], item[1][k]).otherwise(rest), STRATEGIES.items(), F.lit(STRATEGIES["balanced"][k]))
    return F.struct(name.alias("name"), pick(0).alias("per_source"), pick(1).alias("boost"), pick(2).alias("candidates"), F.array_min(named).alias("first"), F.array_max(named).alias("last"))


def themes(question: Column, words: dict[str, tuple[str, ...]] = THEMES) -> Column:
    """The themes of which a question has a word."""
    low = F.lower(question)
    return F.array_compact(F.array(*[F.when(_any(low, own), name) for name, own in words.items()]))


def doc_type(question: Column, words: dict[str, tuple[str, ...]] = DOC_TYPES) -> Column:
    """The first type of which a question has a word; null if there is none."""
    low, found = F.lower(question), F.lit(None).cast("string")
    for name, own in reversed(list(words.items())):
        found = F.when(_any(low, own), name).otherwise(found)
    return found


def operation(question: Column) -> Column:
    """struct(operation, metric): the count, sum or list that a question asks for; null if it asks for none."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(OPERATIONS):
        found = F.when(question.rlike(f"(?iuU){pattern}"), name).otherwise(found)
    return F.when(found.isNotNull(), F.struct(found.alias("operation"), F.when(found == "sum", "amount").alias("metric")))
