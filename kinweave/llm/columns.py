"""Small column builders shared by the operators on DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def running_sum(values: Column) -> Column:
    """Sum of all elements before each element of an array of longs, in blocks so that long arrays stay near linear."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda t, x: t + x)

    def prefix(items: Column, start: Column) -> Column:
        grown = F.aggregate(items, F.struct(start.alias("at"), F.array().cast("array<long>").alias("out")),
                            lambda t, x: F.struct((t["at"] + x).alias("at"), F.concat(t["out"], F.array(t["at"])).alias("out")))
        return grown["out"]

    def run(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda s: F.slice(v, s, F.lit(_BLOCK)))
        joined = let(blocks, lambda b: let(prefix(F.transform(b, total), zero), lambda at: F.flatten(F.zip_with(b, at, prefix))))
        return F.when(F.size(v) > 0, joined).otherwise(F.array().cast("array<long>"))

    return let(values, run)


def match_spans(text: Column, pattern: str, *groups: int) -> Column:
    """Array of (start, end, g0, g1, ...) of all matches, left to right, in code points, end exclusive.

    The text between matches has known lengths, so positions are running sums of them.
    """
    groups = groups or (0,)
    kind = "array<struct<start:bigint,end:bigint," + ",".join(f"g{k}:string" for k in range(len(groups))) + ">>"

    def found(t: Column) -> Column:
        whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.split(t, pattern, -1)
        sizes = F.zip_with(gaps, whole, lambda g, m: F.char_length(g).cast("long") + F.coalesce(F.char_length(m), F.lit(0)).cast("long"))
        parts = [F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in groups]
        packed = F.arrays_zip(F.slice(running_sum(sizes), F.lit(1), F.size(whole)).alias("at"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"),
                              whole.alias("m"), *[p.alias(f"g{k}") for k, p in enumerate(parts)])
        names = ["at", "gap", "m", *[f"g{k}" for k in range(len(groups))]]
        return F.transform(packed.cast("array<struct<" + ",".join(f"{n}:{'bigint' if n == 'at' else 'string'}" for n in names) + ">>"), lambda x: F.struct(
            (x["at"] + F.char_length(x["gap"])).alias("start"), (x["at"] + F.char_length(x["gap"]) + F.char_length(x["m"])).alias("end"),
            *[x[f"g{k}"].alias(f"g{k}") for k in range(len(groups))]))

    return F.when(text.rlike(pattern), let(text, found).cast(kind)).otherwise(F.array().cast(kind))
