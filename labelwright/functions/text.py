"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as Python and the oracles' texts have it.
SPACE = r"(?U)\s+"


def normalize(text: Column) -> Column:
    """Trimmed, lower-cased, runs of white space collapsed to one blank. Null stays null."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as hex."""
    return F.sha2(normalize(text), 256)


def words(text: Column) -> Column:
    """The words of the normalised text; an empty array for a text without any."""
    clean = F.coalesce(normalize(text), F.lit(""))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def sentences(text: Column) -> Column:
    """The trimmed text split at white space after `.`, `!` or `?`; no empty sentences."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.filter(F.split(whole, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def shingles(text: Column, k: int = 5) -> Column:
    """Different k-word shingles of the normalised text; all words as one if they are fewer; none for a text without words."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
        return F.when(F.size(w) >= k, F.array_distinct(grams)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How often the keywords occur as whole words in the lower-cased text, each counted for itself."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for word in keywords:
        total = total + F.regexp_count(lowered, F.lit(rf"(?U)\b\Q{word}\E\b"))
    return total.cast("double")


def keywords_present(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur anywhere in the lower-cased text, as part of a word too."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for word in keywords:
        total = total + F.contains(lowered, F.lit(word)).cast("int")
    return total


def first_best(scores: list[tuple[str, Column]]) -> Column:
    """The name with the largest score; the earlier in the list wins a tie."""
    values = F.array(*[s for _, s in scores])
    names = F.array(*[F.lit(n) for n, _ in scores])
    return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
