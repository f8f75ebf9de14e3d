"""Work on the arrays of a row, in time linear in their length (or that of a sort), without a shuffle.

Spark has no running sum over an array, and an array that grows by one element is
copied each time. So sums run over blocks of ``BLOCK`` elements, and then over blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An array grows one by one up to so many elements.
BLOCK = 48


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once however often, and in whatever loop, it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def blocks(items: Column) -> Column:
    """The items, in order, as an array of arrays of at most ``BLOCK``."""
    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return let(items, lambda all_: F.transform(numbers, lambda b: F.slice(all_, b * BLOCK + 1, BLOCK)))


def sums_before(sizes: Column, levels: int = 3) -> Column:
    """Of each element of an integer array the sum of all before it, and at the end the sum of all.

    Within a block the sums are grown one by one; where a block begins is a sum over
    blocks, found in the same way. The last level takes what is left as one block.
    """
    def grown(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def joined(within: Column) -> Column:
        bases = sums_before(F.transform(within, lambda w: F.element_at(w, -1)), levels - 1)
        moved = lambda b: F.transform(within, lambda w, k: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x: x + F.get(b, k)))
        return let(bases, lambda b: F.concat(F.flatten(moved(b)), F.array(F.element_at(b, -1))))

    return grown(sizes) if levels == 1 else let(F.transform(blocks(sizes), grown), joined)


def repeated(labels: Column, times: int) -> Column:
    """For each element of an array whether its label is not null and stands there ``times`` times at least.

    Equal labels are neighbours once they are sorted with their places, and sorting by
    place brings the answers back.
    """
    def marked(s: Column) -> Column:
        def often(x: Column, j: Column) -> Column:
            ends = [F.get(s, j + k) for k in range(times)]
            begins = [F.get(s, j - k) for k in range(times)]
            runs = [(begins[times - 1 - k]["label"] == ends[k]["label"]) for k in range(times)]
            found = runs[0]
            for r in runs[1:]:
                found = F.coalesce(found, F.lit(False)) | F.coalesce(r, F.lit(False))
            return F.struct(x["at"].alias("at"), (x["label"].isNotNull() & F.coalesce(found, F.lit(False))).alias("yes"))

        return F.transform(F.sort_array(F.transform(s, often)), lambda x: x["yes"])

    return let(F.sort_array(F.transform(labels, lambda x, i: F.struct(x.alias("label"), i.alias("at")))), marked)


def folded(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """What step(state, item) -> struct(state, made of type ``kind``) makes of the items in turn, as an array."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["made"], F.array(r["made"])).alias("made")))

    def block(acc: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("made")), one)
        return let(own, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["made"], F.array(r["made"])).alias("made")))

    return F.flatten(F.aggregate(blocks(items), F.struct(zero.alias("state"), nothing.alias("made")), block)["made"])
