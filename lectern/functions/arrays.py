"""Column functions over arrays, for texts that are one row each: no line of a text is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for `body`, so that an expression used at several places is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(parts: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """The indexes, ascending, of the elements for which holds(element, index) is true."""
    return F.filter(F.transform(parts, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())


def runs(parts: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """An array cut into runs: one begins with the first element and wherever opens(element, index) is true."""
    starts = places(parts, lambda x, i: (i == 0) | opens(x, i))
    return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(parts, at + 1, F.coalesce(F.get(s, k + 1), F.size(parts)) - at)))


def scan(values: Column, state: Column, step: Callable[[Column, Column], Column], out: str, part: int = 256) -> Column:
    """What step(state, element) tells of each element in turn: it gives struct(state, out), and `out` (a type) is kept.

    The results are gathered in parts, so that an array of n elements copies n * (part + n / part) references.
    """
    nothing, empty = F.array().cast(f"array<array<{out}>>"), F.array().cast(f"array<{out}>")

    def turn(acc: Column, value: Column) -> Column:
        def placed(told: Column) -> Column:
            full = F.size(acc["part"]) >= part
            done = F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"])
            return F.struct(told["state"].alias("state"), done.alias("done"), F.concat(F.when(full, empty).otherwise(acc["part"]), F.array(told["out"])).alias("part"))

        return let(step(acc["state"], value), placed)

    begun = F.struct(state.alias("state"), nothing.alias("done"), empty.alias("part"))
    return F.aggregate(values, begun, turn, lambda acc: F.concat(F.flatten(acc["done"]), acc["part"]))
