"""Scalar text expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(column: Column) -> Column:
    """Without white space at both ends, of any kind (trim() takes spaces only)."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row, however often ``body`` names it (also within lambdas)."""
    return F.transform(F.array(value), body)[0]


def finite(column: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def number_or_null(column: Column) -> Column:
    """A decimal text as double; empty or malformed text as null."""
    return column.try_cast("double")


def for_two_places(x: Column) -> Column:
    """``x`` so that ``%.2f`` rounds its exact binary value, and true ties to even; Java rounds the shortest decimal up.

    What may be a tie lies within a few ulp of an odd multiple of 1/200; the product's
    error, by splitting ``x`` into halves, tells on which side ``x`` lies.
    """
    size = F.abs(x)
    product, high = size * 200.0, size * 134217729.0 - (size * 134217729.0 - size)
    nearest = F.rint(product)
    beyond = (product - nearest) + ((high * 200.0 - product) + (size - high) * 200.0)
    down = (nearest % 2.0 == 1.0) & (F.abs(product - nearest) <= product * 1e-15) & ((beyond < 0) | ((beyond == 0) & (F.floor(nearest / 2.0) % 2 == 0)))
    return F.when(down & (size < 1e12), x - F.signum(x) * 1e-3).otherwise(x)


def two_places(column: Column) -> Column:
    return F.when(finite(column).isNotNull(), F.format_string("%.2f", for_two_places(column))).otherwise("n/a")


def symbols(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def resolved_profile(claim: Column, index: dict[str, str]) -> Column:
    """A free-form language name to a profile: as typed, before a parenthesis, first word, last word."""
    key = F.lower(strip(claim))
    words = F.filter(F.split(F.translate(key, "-_", "  "), r"(?U)\s+"), lambda w: w != "")
    return F.when(
        claim != "",
        F.coalesce(
            lookup(index, key),
            F.when(key.contains("("), lookup(index, strip(F.substring_index(key, "(", 1)))),
            lookup(index, F.try_element_at(words, F.lit(1))),
            lookup(index, F.try_element_at(words, F.lit(-1))),
        ),
    )
