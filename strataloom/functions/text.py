"""Column builders for normalising, splitting and scoring text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks in the Latin languages of the tables, and their base letters.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold(text: Column) -> Column:
    """Lower case without marks on letters; ligatures in two letters."""
    low = F.translate(F.lower(text), MARKED, PLAIN)
    return F.replace(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_title(text: Column) -> Column:
    """Lower case, bracketed parts dropped, all but letters and digits one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)", ""), "[^a-z0-9]+", " "))


def slug(text: Column, parts: int = 8, most: int = 64) -> Column:
    pieces = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "-"), lambda x: x != "")
    return F.rtrim(F.left(F.array_join(F.slice(pieces, 1, parts), "-"), F.lit(most)), F.lit("-"))


def plain_words(text: Column) -> Column:
    """Words of a-z and 0-9 after lower-casing."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingles(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space, in order; words must be a column, not an expression."""
    return F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))


def hashed_shingles(words: Column, n: int) -> Column:
    """A 64-bit hash of each run of n words, in order."""
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + j] for j in range(n)]))).otherwise(F.array().cast("array<bigint>")))
    return bound.getItem(0)  # the words are split once a row, not once a run


def singular(word: Column) -> Column:
    """-ies -> -y, -ses -> -s, other plural -s dropped."""
    return (
        F.when(word.rlike("[a-z]{2}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("ses$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[a-z]{2}[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def filled(template: Column, values: Column) -> Column:
    """A template with each {name} replaced by its value in a map, all at once; names without one stay as they are.

    What a value holds is not looked at again, so a value that looks like a name
    is not filled.
    """
    names = F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_]+)\}"), F.lit(1))
    between = F.split(template, r"\{[A-Za-z_]+\}")
    told = F.transform(names, lambda n: F.coalesce(F.try_element_at(values, n), F.concat(F.lit("{"), n, F.lit("}"))))
    return F.array_join(F.zip_with(between, told, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
