"""Greedy packing of ordered entries by jump pointers: where each pack would end, and from the first entry on which packs begin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["first_where", "greedy_starts", "let", "slices"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: an expression that stands in a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _halvings(n: Column) -> Column:
    """Enough numbers for a binary search or doubling over n entries."""
    return F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))


def first_where(low: Column, n: Column, holds: Callable[[Column], Column]) -> Column:
    """The least place from low on, below n, at which holds; n where there is none. holds, once true, stays true for larger places."""
    start = F.struct(low.alias("low"), n.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        return let(F.floor((s["low"] + s["high"]) / 2).cast("int"), lambda mid: F.when(s["low"] >= s["high"], s).when(holds(mid), F.struct(s["low"].alias("low"), mid.alias("high"))).otherwise(F.struct((mid + 1).alias("low"), s["high"].alias("high"))))

    return F.aggregate(_halvings(n), start, halve)["low"]


def greedy_starts(n: Column, follow: Callable[[Column], Column]) -> Column:
    """Where packs begin, ascending: 0, follow(0), follow(follow(0)) and so on below n. follow(i) > i is the place after a pack that begins at i.

    The pointers of all places are computed side by side and doubled: after k rounds the first 2**k packs are known, so n entries
    take n log n steps, and no array is copied for each entry.
    """
    ends = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, follow(i)).otherwise(n))
    start = F.struct(ends.alias("jump"), F.array(F.lit(0)).alias("found"))

    def double(s: Column, _: Column) -> Column:
        there = F.transform(s["found"], lambda i: F.get(s["jump"], i))
        further = F.filter(there, lambda i: i < n)
        return F.when(F.size(further) == 0, s).otherwise(F.struct(F.transform(s["jump"], lambda i: F.get(s["jump"], i)).alias("jump"), F.concat(s["found"], further).alias("found")))

    return F.when(n > 0, F.aggregate(_halvings(n), start, double)["found"]).otherwise(F.array().cast("array<int>"))


def slices(entries: Column, starts: Column) -> Column:
    """The packs: entries between each start and the next."""
    return let(starts, lambda found: F.transform(found, lambda s, i: F.slice(entries, s + 1, F.coalesce(F.get(found, i + 1), F.size(entries)) - s)))
