"""Detection and redaction as one row-local plan: no join, no shuffle, no state, in batch and in streams.

normalize -> scan with every rule -> validate -> suppress -> drop what lies in the span of a failed checksum -> add structural
dates -> resolve overlaps -> map to original offsets -> replace.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veilspark.functions.expressions import blocks, left_context, let, match_spans, right_context
from veilspark.functions.suppressors import CONTEXT, TYPED, suppressed
from veilspark.functions.validators import VALIDATORS, validate
from veilspark.operators.structural import structural_dates
from veilspark.sources.catalog import Catalog

DETECTION = "struct<entity_type:string,start:int,end:int,text:string,source:string,country:string,confidence:string>"
CANDIDATE = "struct<type:string,s:int,e:int,m:string,country:string,priority:int,rank:int>"
DATES = ("DOB", "DATE_OF_DEATH")


def normalized() -> object:
    """Arrow UDF text -> struct<nfc, map>; map (index in nfc -> index of the original character) is null where the length stays."""

    @F.pandas_udf("struct<nfc:string,map:array<int>>")
    def nfc(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if text is None:
                out.append((None, None))
                continue
            done = unicodedata.normalize("NFC", text)
            if len(done) == len(text):
                out.append((done, None))
                continue
            owner = [i for i, ch in enumerate(text) for _ in unicodedata.normalize("NFD", ch)]
            at, where = 0, []
            for ch in done:
                where.append(owner[min(at, len(owner) - 1)])
                at += len(unicodedata.normalize("NFD", ch))
            out.append((done, where))
        return pd.DataFrame(out, columns=["nfc", "map"])

    return nfc


def original_offset(where: Column, offset: Column) -> Column:
    n = F.size(where)
    return F.when(where.isNull(), offset).when(offset < n, F.get(where, offset)).otherwise(F.get(where, n - 1) + offset - n + 1)


def features(text: Column) -> Column:
    """What decides which rules can match: whether the text is ASCII, its digits, the most of them in a row, the most of them right behind a word
    boundary, and its capitals A-Z (of these two, no less than there are)."""
    ascii = F.length(text) == F.octet_length(text)
    found = lambda regex: F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    sizes = lambda regex: F.transform(F.when(ascii, found(regex)).otherwise(found(f"(?U){regex}")), lambda d: F.length(d))
    most = lambda runs: F.coalesce(F.array_max(runs), F.lit(0))
    few = F.length(text) <= 1000  # longer texts nearly always have what rules ask for: bounds will do
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return let(sizes(r"\d+"), lambda r: F.struct(
        ascii.alias("ascii"), F.aggregate(r, F.lit(0), lambda a, b: a + b).alias("digits"), most(r).alias("run"),
        F.when(few, most(sizes(r"\b\d+"))).otherwise(most(r)).alias("head"), F.when(few, capitals).otherwise(F.length(text)).alias("capitals"),
    ))


def matching(text: Column, catalog: Catalog, has: Column) -> Column:
    """The numbers of the rules that match, joined by commas.  A rule runs only on texts with the literals and digits that each of its matches holds;
    on ASCII texts it runs without Unicode classes, which find the same there and take longer.

    Each rule is an expression of its own that keeps its compiled regex from row to row, and only functions that Spark compiles stand around them.
    """
    least, groups = ("digits", "run", "head", "capitals"), {}
    for rule in catalog.rows():
        groups.setdefault((*(rule[k] for k in least), rule["char"] or ""), []).append(rule)

    def of_rule(rule: dict) -> Column:
        found = F.when(has["ascii"], text.rlike(f"(?d){rule['regex'].removeprefix('(?Ud)')}")).otherwise(text.rlike(rule["regex"]))
        return F.when(F.contains(text, F.lit(rule["literal"])) & found if rule["literal"] else found, F.lit(str(rule["rule"])))

    def of_group(key: tuple, rules: list[dict]) -> Column:
        asks = [has[k] >= n for k, n in zip(least, key, strict=False) if n] + [F.contains(text, F.lit(key[-1]))] * bool(key[-1])
        found = F.concat_ws(",", *map(of_rule, rules))
        return F.when(reduce(and_, asks), found) if asks else found

    apart = F.get(F.transform(F.array(text), lambda _: F.lit(None).cast("string")), F.lit(0))  # null; keeps the step out of whole-stage code, which can't be cut into methods
    return F.concat_ws(",", *[of_group(k, g) for k, g in sorted(groups.items())], apart)


def scan(text: Column, catalog: Catalog, has: Column, which: Column) -> Column:
    """array of match rows of the rules `which`, of `matching`.  Rules whose keywords are nowhere in the text are left out: all their matches lack
    context, and they make no zones."""
    table, kind = catalog.literal(), "array<struct<type:string,country:string,validator:string,needs:array<string>,required:boolean,rank:int,s:int,e:int,m:string>>"

    def of_rule(rule: Column) -> Column:
        regex = F.when(has["ascii"], F.concat(F.lit("(?d)"), F.substring(rule["regex"], F.lit(6), F.length(rule["regex"])))).otherwise(rule["regex"])
        return F.transform(let(regex, lambda rx: match_spans(text, rx)), lambda x: F.struct(
            rule["type"].alias("type"), rule["country"].alias("country"), rule["validator"].alias("validator"), F.when(rule["required"], rule["needs"]).alias("needs"),
            rule["required"].alias("required"), rule["rule"].alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"),
        ))

    def of_text(low: Column) -> Column:
        able = lambda rule: rule["words"].isNull() | F.exists(rule["words"], lambda k: F.contains(low, k))
        rules = F.filter(F.transform(F.filter(F.split(which, ","), lambda n: n != ""), lambda n: F.get(table, n.cast("int"))), able)
        return F.flatten(F.transform(rules, of_rule)).cast(kind)

    return F.when(which != "", let(F.lower(text), of_text)).otherwise(F.array().cast(kind))


def judged(matches: Column, names: list[str], more: dict | None = None) -> Column:
    """Match rows with `valid`."""
    fields = ("type", "country", "validator", "needs", "required", "rank", "s", "e", "m")
    return F.transform(matches, lambda x: F.struct(*[x[f].alias(f) for f in fields], validate(x["validator"], x["m"], names, more).alias("valid")))


def outside_zones(rows: Column) -> Column:
    """Valid matches, without those that have no validator and lie in the span of a failed checksum.

    A sweep by start: a match lies in a zone if the furthest end of the zones that start no later is not before its own.
    """
    zone = lambda x: ~x["valid"] & ~x["required"]
    keyed = F.array_sort(F.transform(F.filter(rows, lambda x: x["valid"] | zone(x)), lambda x: F.struct(x["s"].alias("a"), x["valid"].cast("int").alias("b"), x["rank"].alias("c"), x.alias("x"))))

    def step(state: Column, k: Column) -> Column:
        x = k["x"]
        stays = x["valid"] & (x["validator"].isNotNull() | (x["e"] > state["end"]))
        return F.struct(
            F.when(x["valid"], state["end"]).otherwise(F.greatest(state["end"], x["e"])).alias("end"), F.when(stays, F.array_append(state["out"], x)).otherwise(state["out"]).alias("out")
        )

    valid = F.filter(rows, lambda x: x["valid"])
    start = F.struct(F.lit(-1).alias("end"), F.slice(valid, 1, 0).alias("out"))
    return F.when(F.exists(rows, zone), F.aggregate(keyed, start, step)["out"]).otherwise(valid)


def candidates(rows: Column, pieces: Column, priority: Callable[[Column], Column], more: tuple = ()) -> Column:
    """Those of `outside_zones` that no context rule discards.  Contexts are cut only for matches of rules and types that look at them."""
    asks = lambda x: x["needs"].isNotNull() | x["type"].isin(*TYPED, *(kind for kind, _ in more))
    fields = ("type", "country", "validator", "needs", "rank", "s", "e", "m")
    seen = F.transform(outside_zones(rows), lambda x: F.struct(
        *[x[f].alias(f) for f in fields], F.when(asks(x), left_context(pieces, x["s"], CONTEXT)).alias("before"), F.when(asks(x), right_context(pieces, x["e"], CONTEXT)).alias("after"),
    ))
    kept = F.filter(seen, lambda x: ~suppressed(x, more))
    return F.transform(kept, lambda x: F.struct(x["type"].alias("type"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["country"].alias("country"), priority(x).alias("priority"), x["rank"].alias("rank"))).cast(f"array<{CANDIDATE}>")


def resolved(rows: Column) -> Column:
    """Greedy: by priority, then length, then rule order; a candidate stays when it overlaps nothing kept.

    Candidates are first cut into clusters that overlap one another, which a sweep by start finds; only those of a cluster are compared.
    """
    kind = f"array<{CANDIDATE}>"
    by_start = F.transform(F.array_sort(F.transform(rows, lambda x: F.struct(x["s"].alias("a"), x["e"].alias("b"), x["rank"].alias("c"), x.alias("x")))), lambda k: k["x"])
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        apart = x["s"] >= state["end"]
        return F.struct(
            F.when(apart, x["e"]).otherwise(F.greatest(state["end"], x["e"])).alias("end"), F.when(apart, F.array(x).cast(kind)).otherwise(F.array_append(state["now"], x)).alias("now"),
            F.when(apart, F.array_append(state["out"], state["now"])).otherwise(state["out"]).alias("out"),
        )

    clusters = F.aggregate(by_start, start, step, lambda state: F.array_append(state["out"], state["now"]))
    return F.flatten(F.transform(clusters, lambda c: F.when(F.size(c) < 2, c).otherwise(_greedy(c))))


def _greedy(rows: Column) -> Column:
    keyed = F.array_sort(F.transform(rows, lambda x: F.struct((-x["priority"]).alias("a"), (x["s"] - x["e"]).alias("b"), x["rank"].alias("c"), x["s"].alias("d"), x["type"].alias("f"), x.alias("x"))))
    clash = lambda kept, x: F.exists(kept, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
    return F.aggregate(keyed, F.array().cast(f"array<{CANDIDATE}>"), lambda kept, k: F.when(clash(kept, k["x"]), kept).otherwise(F.array_append(kept, k["x"])))


def replaced(text: Column, rows: Column, tag) -> Column:
    """`text` with each detection's span replaced by tag(detection); spans are disjoint and ascend."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda state, d: F.struct(d["end"].alias("at"), F.concat(state["out"], F.substring(text, state["at"] + 1, d["start"] - state["at"]), tag(d)).alias("out"))
    return F.aggregate(rows, start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))


@dataclass(frozen=True)
class Redactor:
    """Immutable configuration.  `countries` None: all 31.  Dates of birth and death are reported only with `detect_dates`.

    `validators` (name, function of the match) and `context` (type, function of a match row of `functions.suppressors`) add to the registered ones.
    """

    catalog: Catalog = Catalog()
    detect_dates: bool = False
    normalize: bool = True
    validators: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    context: tuple[tuple[str, Callable[[Column], Column]], ...] = ()

    @classmethod
    def of(cls, countries: Sequence[str] | None = None, detect_dates: bool = False, more: dict[str, Sequence[tuple]] | None = None) -> Redactor:
        return cls(Catalog.of(countries, more), detect_dates)

    def with_custom(self, name: str, regex: str) -> Redactor:
        return replace(self, catalog=self.catalog.with_custom(name, regex))

    def with_validator(self, name: str, valid: Callable[[Column], Column]) -> Redactor:
        """A validator by the name that rules of one's own give; it replaces a registered one of that name."""
        return replace(self, validators=(*((n, f) for n, f in self.validators if n != name), (name, valid)))

    def with_context_rule(self, entity_type: str, discards: Callable[[Column], Column]) -> Redactor:
        return replace(self, context=(*self.context, (entity_type, discards)))

    def detect(self, df: DataFrame, text: str = "text") -> DataFrame:
        """`df` with `detections`, an array of DETECTION by start; null text has none.

        The column is made once: filters and projections above it can't cross the Project that makes it, as that isn't deterministic to the optimiser.
        """
        _refuse(df, ["detections"])
        for name, column, spent in _steps(self, text):
            df = df.withColumn(name, column).drop(*spent)
        return df

    def redact(self, df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        """`df` with `redacted_text` ([TYPE] for each detection), `detections`, `source` and `degraded`, behind `prefix`.

        Columns of `df` are never replaced: where it has one of these names, the call fails and asks for a prefix.
        """
        made = ("redacted_text", "detections", "source", "degraded")
        _refuse(df, [prefix + name for name in made])
        out = self.detect(df.withColumnRenamed("detections", "_vs_own"), text)
        tagged = replaced(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col("detections"), lambda d: F.concat(F.lit("["), d["entity_type"], F.lit("]")))
        own = [F.col("_vs_own" if c == "detections" else f"`{c}`").alias(c) for c in df.columns]
        return out.select(*own, tagged.alias(f"{prefix}redacted_text"), F.col("detections").alias(f"{prefix}detections"), F.lit("rules").alias(f"{prefix}source"), F.lit(False).alias(f"{prefix}degraded"))

    def redact_distinct(self, df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        """The same for tables with many copies: each distinct text is scanned once and joined back by its hash."""
        whole = F.col(f"`{text}`")
        key = F.sha2(F.coalesce(whole, F.lit("")), 256)
        keyed = df.withColumn("_vs_key", key)
        once = keyed.select("_vs_key", whole.alias("_vs_text")).groupBy("_vs_key").agg(F.first("_vs_text").alias("_vs_text"))
        once = self.redact(once, "_vs_text", prefix).drop("_vs_text")
        return keyed.join(once, "_vs_key").drop("_vs_key")

    def redact_iter(self, df: DataFrame, text: str = "text") -> Iterator[Row]:
        """Rows one partition at a time."""
        yield from self.redact(df, text).toLocalIterator(prefetchPartitions=True)


@lru_cache(maxsize=32)
def _steps(of: Redactor, text: str) -> tuple[tuple[str, Column, tuple[str, ...]], ...]:
    """(name, column, columns that no later step reads) of `detect`, in order.  They depend on names only, and making them takes seconds, so they are kept."""
    more = dict(of.validators)
    names = sorted({r["validator"] for r in of.catalog.rows() if r["validator"]})
    whole, steps = F.col(f"`{text}`"), []
    if of.normalize:
        plain = F.coalesce(F.length(whole) == F.octet_length(whole), F.lit(True))  # ASCII stays as it is
        steps.append(("_vs_u", normalized()(F.when(plain, F.lit(None)).otherwise(whole)), ()))
        steps.append(("_vs_t", F.coalesce(F.col("_vs_u.nfc"), whole, F.lit("")), ()))
        steps.append(("_vs_map", F.col("_vs_u.map"), ("_vs_u",)))
    else:
        steps.append(("_vs_t", F.coalesce(whole, F.lit("")), ()))
        steps.append(("_vs_map", F.lit(None).cast("array<int>"), ()))
    steps.append(("_vs_f", features(F.col("_vs_t")), ()))
    steps.append(("_vs_h", matching(F.col("_vs_t"), of.catalog, F.col("_vs_f")), ()))
    steps.append(("_vs_m", scan(F.col("_vs_t"), of.catalog, F.col("_vs_f"), F.col("_vs_h")), ("_vs_f", "_vs_h")))
    steps.append(("_vs_b", F.when(F.size("_vs_m") > 0, blocks(F.col("_vs_t"), CONTEXT)), ()))
    steps.append(("_vs_j", judged(F.col("_vs_m"), names, more), ("_vs_m",)))
    priority = lambda x: F.when(x["validator"].isin(*VALIDATORS, *more), 3).when(x["country"] == "CUSTOM", 2).otherwise(1)
    found = candidates(F.col("_vs_j"), F.col("_vs_b"), priority, of.context)
    steps.append(("_vs_c", F.concat(found, structural_dates(F.col("_vs_t")).cast(f"array<{CANDIDATE}>")), ("_vs_j", "_vs_b")))
    steps.append(("_vs_r", resolved(F.col("_vs_c")), ("_vs_c",)))
    rows = F.col("_vs_r") if of.detect_dates else F.filter("_vs_r", lambda x: ~x["type"].isin(*DATES))
    where = F.col("_vs_map")
    final = F.transform(rows, lambda x: F.struct(
        x["type"].alias("entity_type"), original_offset(where, x["s"]).alias("start"), original_offset(where, x["e"]).alias("end"), x["m"].alias("text"),
        F.lit("rules").alias("source"), F.when(~x["country"].isin("SHARED", "CUSTOM"), x["country"]).alias("country"), F.lit("high").alias("confidence"),
    )).cast(f"array<{DETECTION}>")
    ordered = F.transform(F.array_sort(F.transform(final, lambda d: F.struct(d["start"].alias("a"), (-d["end"]).alias("b"), d["entity_type"].alias("c"), d.alias("d")))), lambda k: k["d"])
    once = F.coalesce(F.when(F.rand(0) + 1 >= 0, ordered), F.array().cast(f"array<{DETECTION}>"))  # always `ordered`
    return (*steps, ("detections", once, ("_vs_t", "_vs_map", "_vs_r")))


def _refuse(df: DataFrame, made: list[str]) -> None:
    if taken := [c for c in df.columns if c.lower() in {m.lower() for m in made}]:
        raise ValueError(f"the input has columns named {', '.join(taken)}; rename them or give a prefix")
