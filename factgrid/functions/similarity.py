"""Similarity scores of two strings as expressions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a row of the usual table for each character of a."""
    n = F.length(b)

    def row(before: Column, c: Column) -> Column:
        cell = lambda now, j: F.array_append(
            now,
            F.greatest(F.when(F.substr(b, j, F.lit(1)) == c, F.get(before, j - 1) + 1).otherwise(F.lit(0)), F.get(before, j), F.element_at(now, -1)),
        )
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    last = F.aggregate(_chars(a), F.array_repeat(F.lit(0), n + 1), row)
    return F.when((F.length(a) == 0) | (n == 0), F.lit(0)).otherwise(F.element_at(last, -1))


def indel_ratio(a: Column, b: Column) -> Column:
    """round(200 * common subsequence / total length), 0 to 100; 0 if both are empty."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(0)).otherwise(F.bround(F.try_divide(200.0 * common_subsequence(a, b), total), 0)).cast("int")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - distance / longer length), rounded; 0 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0)).otherwise(F.bround(100.0 - F.try_divide(100.0 * F.levenshtein(a, b), longest), 0)).cast("int")


def charset_similarity(a: Column, b: Column) -> Column:
    """Characters of a that b holds, over the longer length; 1 if equal, 0 if either is empty. Not symmetric."""
    held = F.size(F.filter(_chars(a), lambda c: F.contains(b, c)))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(held / F.greatest(F.length(a), F.length(b)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(F.least(F.length(a), F.length(b)).cast("double"), F.greatest(F.length(a), F.length(b)))
