"""Small text and set functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def white_space(value: Column, facet: str = "collapse") -> Column:
    """The XML white-space facets: preserve, replace (tabs and newlines become spaces), collapse."""
    if facet == "preserve":
        return value
    replaced = F.regexp_replace(value, r"[\t\n\r]", " ")
    return replaced if facet == "replace" else F.trim(F.regexp_replace(replaced, " +", " "))


def natural(name: Column) -> Column:
    """A dotted name (a node id) whose numbers are padded, so that the order of texts is that of the numbers."""
    return F.array_join(F.transform(F.split(name, r"\."), lambda x: F.when(x.rlike(r"^\d{1,10}$"), F.lpad(x, 10, "0")).otherwise(x)), ".")


def same_words(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    from ..operators.valueset import words

    return words(a, case_sensitive) == words(b, case_sensitive)


def replace_prefixes(value: Column, pairs: list[tuple[str, str]]) -> Column:
    """The first fitting prefix is replaced (nsMap)."""
    out = value
    for old, new in reversed(pairs):
        out = F.when(value.startswith(old), F.concat(F.lit(new), F.substring(value, len(old) + 1, 1 << 30))).otherwise(out)
    return out


def set_union(a: Column, b: Column) -> Column:
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def set_intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def set_difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def list_append(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
