"""Column helpers for the native operators: only Catalyst expressions, no Python in tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Entries that one fold appends to; keeps running sums near linear for long arrays.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _scan(values: Column) -> Column:
    """struct(total, before): the sum of an array of longs, and for each entry the sum of those before it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(
        values,
        zero,
        lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")),
    )


def sums_before(values: Column) -> Column:
    """For each entry of an array of longs the sum of those before it, in blocks so that long arrays stay cheap."""

    def in_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        scans = F.transform(starts, lambda b: _scan(F.slice(v, b * _BLOCK + 1, _BLOCK)))

        def joined(s: Column) -> Column:
            bases = _scan(F.transform(s, lambda x: x["total"]))["before"]
            return F.flatten(F.zip_with(s, bases, lambda x, base: F.transform(x["before"], lambda y: y + base)))

        return let(scans, joined)

    return let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(F.array().cast("array<bigint>")))
