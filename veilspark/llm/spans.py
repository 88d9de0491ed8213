"""Spans of a regex in a text column, in code points, with DataFrame functions only.

Spark has no function that returns match offsets.  The matches and the gaps between them, from
`regexp_extract_all` and `split` with the same regex, give them: a match starts where the texts before it end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,m:string>"


def spans(text: Column, regex: str) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches; `regex` must not match the empty text."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["g"])
        end = start + F.length(pair["m"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), pair["m"].alias("m"))).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    out = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), empty, step)["out"]
    return F.when(text.rlike(regex), out).otherwise(F.array().cast(f"array<{SPAN}>"))


def before(text: Column, start: Column, n: int) -> Column:
    """Up to `n` code points before offset `start`."""
    return F.substring(text, F.greatest(start - n + 1, F.lit(1)), F.least(start, F.lit(n)))


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))


def joined(rows: Column) -> Column:
    """'kind:start:end' of sorted structs, comma-joined."""
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
