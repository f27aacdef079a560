"""Left-to-right folds over the pieces of one text, as Column expressions.

Spark's ``aggregate`` copies whatever array it appends to, so a fold that emits one value per item would cost the square
of the items.  ``scan`` folds in chunks: an item is copied within its chunk only, and once per chunk as part of the list
of chunks.  ``let`` names a value inside a lambda, where Spark would compute a repeated expression again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def only_if(value: Column, test: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``test(value)`` holds, else ``value``; it stands in the expression once."""
    return let(value, lambda x: F.when(test(x), use(x)).otherwise(x))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column], Column], kind: str) -> Column:
    """``emit(state)`` after each of ``items``, as an array of ``kind``; ``zero`` and ``step`` give a state of one type."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        return let(step(acc["s"], x), lambda s: F.struct(s.alias("s"), F.concat(acc["o"], F.array(emit(s))).alias("o")))

    def chunks(xs):
        def chunk(acc, i):
            part = F.aggregate(F.slice(xs, i * CHUNK + 1, CHUNK), F.struct(acc["s"].alias("s"), none.alias("o")), one)
            return let(part, lambda p: F.struct(p["s"].alias("s"), F.concat(acc["o"], F.array(p["o"])).alias("o")))

        start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), start, chunk, lambda acc: acc["o"]))

    return let(items, chunks)
