"""Column helpers: bound values, digit arrays and regex spans in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(clean: Column) -> Column:
    """array<int> of a string of ASCII digits."""
    return F.transform(F.filter(F.split(clean, ""), lambda c: c != ""), lambda c: c.cast("int"))


def weighted(d: Column, weights: list[int]) -> Column:
    """Sum of the first digits times the weights."""
    terms = F.zip_with(F.slice(d, 1, len(weights)), F.expr(f"array({', '.join(map(str, weights))})"), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _locate(part: Column, text: Column, start: Column) -> Column:
    """The place from 1 of the first `part` that starts at `start` or later; 0 without one."""
    return F.call_function("locate", part, text, start)


def match_spans(text: Column, regex: Column) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches."""
    return let(F.regexp_extract_all(text, regex, F.lit(0)), lambda found: found_spans(text, regex, found))


def found_spans(text: Column, regex: Column, found: Column) -> Column:
    """The spans of `found`, all matches of `regex` in `text`.

    A match starts where the gaps and matches before it end; gaps come from `split`.  A single match is where its text is, if that is there once.
    """
    kind = "array<struct<s:int,e:int,m:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        s = state["at"] + F.length(pair["g"])
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.array_append(state["out"], F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m"))).alias("out"))

    def by_gaps() -> Column:
        pairs = F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        return F.aggregate(pairs, start, step)["out"]

    def single(x: Column) -> Column:
        m, s = x["m"], x["s"]
        alone = (F.length(m) > 0) & (_locate(m, text, s + 2) == 0)
        return F.when(alone, F.array(F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"))).cast(kind)).otherwise(by_gaps())

    m = F.get(found, F.lit(0))
    one = let(F.struct(m.alias("m"), (_locate(m, text, F.lit(1)) - 1).alias("s")), single)
    return F.when(F.size(found) > 1, by_gaps()).when(F.size(found) > 0, one).otherwise(F.array().cast(kind))


def blocks(text: Column, n: int) -> Column:
    """`text` in pieces of `n` code points, so that a context is cut from two of them and not from the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def left_context(pieces: Column, start: Column, n: int) -> Column:
    """Up to `n` code points before offset `start` of a text in `blocks` of `n`."""
    k = F.floor(start / n).cast("int")
    two = F.concat(F.when(k > 0, F.get(pieces, k - 1)).otherwise(F.lit("")), F.coalesce(F.get(pieces, k), F.lit("")))
    return F.when(k > 0, F.substring(two, start - k * n + 1, F.lit(n))).otherwise(F.substring(two, F.lit(1), start))


def right_context(pieces: Column, end: Column, n: int) -> Column:
    """Up to `n` code points from offset `end` on."""
    k = F.floor(end / n).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(two, end - k * n + 1, F.lit(n))
