"""Array expressions whose time stays near the array's length: bound values and running folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 256
CHARACTERS = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states ``step(state, item)`` after each item, from ``start``.

    An append copies its array, so states are collected in pieces of ``PIECE`` items and the pieces after that.
    """

    def piece(state: Column, own: Column) -> Column:
        first = F.struct(state.alias("state"), F.slice(F.array(state), 1, 0).alias("states"))
        after = lambda a, x: bound(step(a["state"], x), lambda s: F.struct(s.alias("state"), F.concat(a["states"], F.array(s)).alias("states")))
        return F.aggregate(own, first, after)

    def over(items: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int"))),
            lambda k: F.slice(items, k * PIECE + 1, F.lit(PIECE)),
        )
        first = F.struct(start.alias("state"), F.array(F.slice(F.array(start), 1, 0)).alias("states"))
        after = lambda a, own: bound(
            piece(a["state"], own), lambda p: F.struct(p["state"].alias("state"), F.concat(a["states"], F.array(p["states"])).alias("states"))
        )
        return F.flatten(F.aggregate(pieces, first, after)["states"])

    return bound(items, over)


def with_parts(text: Column, use: Callable[[Callable[[Column, Column], Column], Column], Column]) -> Column:
    """``use(part, size)``, where part(start, n) gives n characters of the text from start (0, 1, ...), size its length.

    A plain substring walks the text from its beginning; here short parts come from pieces of ``CHARACTERS``.
    """

    def over(pieces: Column) -> Column:
        def part(start: Column, n: Column) -> Column:
            start, n = start.cast("int"), n.cast("int")
            k = F.floor(start / CHARACTERS).cast("int")
            near = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
            return F.when(n <= CHARACTERS, F.substr(near, start - k * CHARACTERS + 1, n)).otherwise(F.substr(text, start + 1, n))

        return bound(F.length(text), lambda size: use(part, size))

    return bound(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHARACTERS), F.lit(0)), over)
