"""Trigram sets of names, as columns.

A name is lower-cased and cut into words at everything that is not a letter or
digit; each word is padded with two blanks before and one after.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def trigrams(name: Column) -> Column:
    """Distinct padded trigrams of all words."""
    words = F.filter(F.split(F.lower(name), WORD_BREAK), lambda w: w != "")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def similarity(common: Column, left_size: Column, right_size: Column) -> Column:
    return common / (left_size + right_size - common)


def plain_grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters; empty for shorter texts."""
    return F.when(
        F.length(text) >= n,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length(text) - (n - 1)),
                lambda i: F.substring(text, i, F.lit(n)),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
