"""Text functions as Columns; Java regular expressions with Unicode classes where the rule needs them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"


def plain(s: str) -> str:
    """A Python text without Western accents."""
    return s.translate(str.maketrans(_ACCENTS, _PLAIN))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside a lambda Spark would compute it again for each element."""
    return F.transform(F.array(value), use)[0]


def fold_ascii(c: Column) -> Column:
    """NFKD, without what is not ASCII, in small letters."""

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())

    plain = c.rlike("^\\p{ASCII}*$")  # stays in the JVM
    return F.coalesce(F.when(plain, F.lower(c)), F.pandas_udf(fold, "string")(F.when(~plain, c)))


def fold_marks(c: Column) -> Column:
    """NFD without combining marks, in small letters: ß and œ stay."""

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(k for k in unicodedata.normalize("NFD", x) if not unicodedata.combining(k)).lower())

    return F.pandas_udf(fold, "string")(c)


def fold_latin(c: Column) -> Column:
    """The fast fold for Western accents: JVM side, equal to the others where no other letters stand."""
    return F.lower(F.translate(c, _ACCENTS, _PLAIN))


def canonical(c: Column) -> Column:
    """Folded words with single spaces; every letter folds as in NFKD (Arrow batches: Spark has no such function)."""
    return F.trim(F.regexp_replace(fold_ascii(c), "[^a-z0-9_]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct n-grams of the words of a canonical text; a shorter text is one shingle, an empty one none."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(grams))

    return let(words(c), of)


def hashed_shingles(c: Column, n: int = 5) -> Column:
    """``shingles`` as 64-bit hashes, without building the n-grams."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.array_distinct(grams))

    return let(words(c), of)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller set; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def slug(c: Column, most: int = 50) -> Column:
    """Upper-case words joined by underscores, INCONNU for nothing."""
    s = F.substring(F.upper(F.regexp_replace(F.regexp_replace(F.translate(c, _ACCENTS, _PLAIN), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")), 1, most)
    return F.when(F.coalesce(s, F.lit("")) == "", "INCONNU").otherwise(s)


def subtype(c: Column) -> Column:
    """First of a comma list, upper case, without accents, underscores for spaces and dashes."""
    return F.regexp_replace(F.upper(F.translate(F.trim(F.split_part(c, F.lit(","), F.lit(1))), _ACCENTS, _PLAIN)), "[ -]+", "_")


def name_tokens(c: Column, titles: tuple[str, ...] = ("monsieur", "madame", "mademoiselle", "mme", "mlle")) -> Column:
    """Distinct words of three letters or more, without titles, sorted."""
    found = F.regexp_extract_all(fold_latin(c), F.lit("([a-z]{3,})"), 1)
    return F.sort_array(F.array_distinct(F.filter(found, lambda w: ~w.isin(list(titles)))))


def unit_number(c: Column) -> Column:
    """The first number of two to four digits; null if there is none."""
    return F.nullif(F.regexp_extract(c, "\\b(\\d{2,4})\\b", 1), F.lit(""))


def person_key(c: Column) -> Column:
    """All words of two letters or more of a name, sorted, in capitals, without what only introduces it."""
    s = F.regexp_replace(F.upper(fold_latin(c)), "\\bSYNDICAT\\b.*", "")
    s = F.regexp_replace(F.regexp_replace(s, "\\b(MR|MME|MADAME|MONSIEUR|SINISTRE_DDE|DDE)\\b", ""), "\\bM\\b\\.?", "")
    return F.array_join(F.sort_array(F.regexp_extract_all(s, F.lit("([A-Z]{2,})"), 1)), " ")


def property_code(c: Column) -> Column:
    """A code of four to six digits before a dash at the head of a path, in brackets, behind a separator, or standing
    alone, in this order; a registered code (two letters, seven digits) if there is none."""
    patterns = ("^\\s*(\\d{4,6})\\s*-\\s*", "\\((\\d{4,6})\\)", "[\\\\/](\\d{4,6})\\s*-\\s*", "(?:^|[^0-9])(\\d{4,6})\\s+-\\s+", "([A-Z]{2}\\d{7})")
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def canonical_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def valid_code(c: Column) -> Column:
    return F.coalesce(canonical_code(c).rlike("^([A-Z]{2}\\d{7}|\\d{4,6})$"), F.lit(False))


def display_code(c: Column) -> Column:
    code = canonical_code(c)
    return F.when(code.rlike("^[A-Z]{2}\\d{7}$"), F.concat_ws("-", F.substring(code, 1, 3), F.substring(code, 4, 3), F.substring(code, 7, 3))).otherwise(code)


def clean(c: Column) -> Column:
    """Without NUL, trimmed; the text "null" and the empty text are null."""
    s = F.trim(F.regexp_replace(c, "\\x00", ""))
    return F.when((s == "") | (F.lower(s) == "null"), None).otherwise(s)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "[\\\\/]"), -1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, "[\\\\/]?[^\\\\/]*$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), "(\\.[^.]+)$", 1))


def haystack(*columns: str) -> Column:
    """One folded text of several columns, nulls left out."""
    return fold_latin(F.concat_ws(" ", *columns))


def query_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(fold_latin(c), F.lit("([a-z0-9]{3,})"), 1), lambda w: ~w.isin(list(stop)) if stop else F.lit(True)))


def reference_codes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("\\b([AI]\\d{5,}[A-Z]*)\\b"), 1)


def chunk_id(source: Column, text: Column, occurrence: Column) -> Column:
    """Twelve characters of an md5 of source, text and, from the second on, the text's occurrence."""
    return F.substring(F.md5(F.concat(source, F.lit("|"), text, F.when(occurrence > 0, F.concat(F.lit("#"), occurrence.cast("string"))).otherwise("")).cast("binary")), 1, 12)


def passage(doc_type: Column, name: Column, text: Column, chars: int = 1900) -> Column:
    """What a reranker reads: type, name without extension, opening of the text."""
    return F.concat(F.lit("["), doc_type, F.lit("] "), F.regexp_replace(F.regexp_replace(name, "\\.[^.]+$", ""), "[_-]+", " "), F.lit("\n"), F.substring(text, 1, chars))


def excerpt(c: Column, most: int = 2000) -> Column:
    """Opening, middle and end of what is left without the first and the last tenth; a text that fits stays whole."""
    size = most // 3
    n, trimmed = F.length(c), F.floor(F.length(c) / 10).cast("int")
    usable = n - 2 * trimmed
    part = lambda at: F.trim(F.substring(c, at + 1, F.lit(size)))
    cut = F.concat_ws("\n[...]\n", part(trimmed), part(trimmed + F.floor(usable / 2).cast("int") - size // 2), part(n - trimmed - size))
    return F.when(n <= most, F.trim(c)).when(usable <= most, F.trim(F.substring(c, trimmed + 1, usable))).otherwise(cut)


def head_and_tail(c: Column, most: int = 2000) -> Column:
    """Opening and end of a text; one that fits stays whole."""
    half = most // 2
    return F.when(F.length(c) <= most, F.trim(c)).otherwise(F.concat_ws("\n[...]\n", F.trim(F.substring(c, 1, half)), F.trim(F.right(c, F.lit(half)))))


# Repairs of scanned text, in order. Small and capital letters of French.
_SMALL, _CAPITAL = "a-zàâäéèêëïîôùûüÿçœæ", "A-ZÀÂÄÉÈÊËÏÎÔÙÛÜŸ"
OCR_REPAIRS = (
    (f"(?U)(\\w)-\\s*\\n\\s*([{_SMALL}])", "$1$2"), (f"(?<=[{_CAPITAL}])(?=[{_CAPITAL}][{_SMALL}]{{2,}})", " "), (f"([{_SMALL}])([{_CAPITAL}ÇŒÆ])", "$1 $2"),
    ("(?iuU)\\b(à|de|du|que|qu|ne|se|ce|je|jusqu|lorsqu|puisqu)(l'|d'|s'|n'|m'|c'|j')", "$1 $2"), (f"([.!?])([{_CAPITAL}])", "$1 $2"), ("(?U)(\\w)(:)([A-ZÀ-Ÿa-zà-ÿ])", "$1 $2 $3"), (" {2,}", " "),
)


def ocr_repaired(c: Column) -> Column:
    """Scanned text with broken words joined and missing spaces put in."""
    for pattern, to in OCR_REPAIRS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def segment_after(path: Column, root: str, category: str) -> Column:
    """The folder below the first path part that matches ``root``, one level deeper if that matches ``category``;
    empty if there is none, null without root. The file's own name is never taken."""

    def of(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda x: F.trim(x).rlike(root)), True).cast("int")
        inside = F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0)))
        first = F.coalesce(F.get(inside, F.lit(0)), F.lit(""))
        return F.when(at > 0, F.when(F.trim(first).rlike(category), F.coalesce(F.get(inside, F.lit(1)), F.lit(""))).otherwise(first))

    return let(F.filter(F.split(path, "[\\\\/]"), lambda x: x != ""), of)


def quality_metrics(c: Column) -> dict[str, Column]:
    """Length, share of letters and spaces, long words, share of control and unassigned characters."""
    n = F.length(c)
    share = lambda pattern: F.when(n > 0, (n - F.length(F.regexp_replace(c, pattern, ""))) / n).otherwise(0.0)
    return {"length": n, "alpha": share("[\\p{L} ]"), "long_words": F.regexp_count(c, F.lit("[a-zA-ZÀ-ÿ]{3,}")), "control": share("[\\p{C}&&[^\\n\\r\\t]]")}
