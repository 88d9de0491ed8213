"""Secret scan: base patterns and sliding-window entropy (DataFrame functions only; one pass, no shuffle).

Base kinds (`assign`, `access`, `hex`) are leftmost non-overlapping matches whose failing ones are dropped.
Beyond them, candidate strings (runs of at least `WINDOW` token characters that hold a letter and a digit) are
scanned by a window: the counts of its characters and the sum of c * log2(c) are carried from position to position, so
each step costs the same whatever the window's width.  Counts are held in 5 bits each, 12 to a long, so that a step writes 6 longs and not the whole alphabet.  Within a candidate every run of hexadecimal and of alphanumeric characters that is as long
as the window is scanned by the threshold of the narrowest class that holds it, and the whole candidate by that of its own class, so that a key behind a prefix
(`id_9F86...`) is judged as what it is; a reported span is from the first to the last window that reaches the threshold, and of
two spans one of which holds the other the outer one stays (of equal ones the narrower class).  Allow-listed candidates (UUIDs, dates with words, checksums that are named so) and those that overlap a base span
are not reported; placeholder words and counting sequences cut a candidate into pieces, which are scanned each.

Defined results: null text is empty; no span is dropped or capped; rows are independent of each other, so copies, ties and
repeated ids give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.spans import before, joined, spans

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: A run of the class starts at its first AKIA; shorter rests of it are shorter still, so the length can stand in the regex.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex")

WINDOW = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: A count of at most WINDOW + 1 takes so many bits; so many of them fill a long.
BITS, PER_LONG = 5, 12
#: (class, all its characters, bits a window must reach)
RUNS = tuple(rf"[{c}]{{{WINDOW},}}+" for c in ("0-9a-fA-F", "A-Za-z0-9"))
CLASSES = (("entropy_hex", r"^[0-9a-fA-F]+$", 3.0), ("entropy_alnum", r"^[A-Za-z0-9]+$", 3.7), ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", 3.85))
#: What is known to be harmless, by the form of the whole candidate and by the 24 code points before it.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:sha1-(?:[A-Za-z0-9+/]{27}=|[0-9a-fA-F]{40})|sha256-(?:[A-Za-z0-9+/]{43}=|[0-9a-fA-F]{64})|sha384-(?:[A-Za-z0-9+/]{64}|[0-9a-fA-F]{96})|sha512-(?:[A-Za-z0-9+/]{86}==|[0-9a-fA-F]{128}))$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[-_/T](?:[0-9]{1,9}|[a-z]+))*+$",
)
#: Words of placeholders and counting sequences; they cut a candidate, and the rest of it is scanned.
ALLOWED_WORDS = r"(?i:example|placeholder|changeme|dummy|x{4,}+)|0123456789|abcdefghij|ABCDEFGHIJ"
ALLOWED_BEFORE = r"(?i)(?:commit|checksum|sha1|sha256|md5|digest|integrity|isbn|://\S{0,20})[\x20:=/\"']*$"

_SPAN = "struct<kind:string,start:int,end:int,text:string,bits:double>"


def window_scan(token: Column, threshold: Column) -> Column:
    """struct<first, last, best>: starts of the first and the last window that reach `threshold`, or -1; the most bits."""
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    units = F.array(*[F.lit(1 << BITS * i).cast("long") for i in range(PER_LONG)])
    place = lambda code: F.struct(
        F.call_function("div", code, F.lit(PER_LONG)).cast("int").alias("slot"), (code % PER_LONG * BITS).alias("shift"), F.get(units, code % PER_LONG).alias("unit")
    )
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: place(F.instr(F.lit(ALPHABET), c) - 1))
    none = F.struct(F.lit(0).alias("slot"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("unit"))
    count = lambda counts, x: F.call_function("shiftright", F.get(counts, x["slot"]), x["shift"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")
    zero = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PER_LONG)).alias("counts"), F.lit(0.0).alias("s"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0.0).alias("best"),
    )

    def step(state: Column, pair: Column) -> Column:
        new, old, i = pair["new"], pair["old"], state["i"]
        had = count(state["counts"], new)
        s = state["s"] + F.get(term, had + 1) - F.get(term, had)
        gone = count(state["counts"], old) + F.when((old["slot"] == new["slot"]) & (old["unit"] == new["unit"]), 1).otherwise(0)
        s = F.when(old["unit"] > 0, s - F.get(term, gone) + F.get(term, gone - 1)).otherwise(s)
        share = lambda x, j: F.when(j == x["slot"], x["unit"]).otherwise(F.lit(0).cast("long"))
        counts = F.transform(state["counts"], lambda c, j: c + share(new, j) - share(old, j))
        bits = F.when(i >= WINDOW - 1, F.lit(math.log2(WINDOW)) - s / WINDOW).otherwise(F.lit(0.0))
        hit = (i >= WINDOW - 1) & (bits >= threshold)
        at = i - (WINDOW - 1)
        return F.struct(
            (i + 1).alias("i"), counts.alias("counts"), s.alias("s"), F.when(hit & (state["first"] < 0), at).otherwise(state["first"]).alias("first"),
            F.when(hit, at).otherwise(state["last"]).alias("last"), F.greatest(state["best"], bits).alias("best"),
        )

    late = F.concat(F.array_repeat(none, WINDOW), codes)
    pairs = F.zip_with(codes, F.slice(late, F.lit(1), F.size(codes)), lambda n, o: F.struct(n.alias("new"), o.alias("old")))
    return F.aggregate(pairs, zero, step, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["best"].alias("best")))


def _pieces(x: Column, words: str) -> Column:
    """The parts of a candidate's span between the matches of `words`, as spans of the text."""
    cut = spans(x["m"], words)
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda w: w["end"]))
    ends = F.concat(F.transform(cut, lambda w: w["start"]), F.array(F.length(x["m"])))
    return F.zip_with(starts, ends, lambda s, e: F.struct((x["start"] + s).alias("start"), (x["start"] + e).alias("end"), F.substring(x["m"], s + 1, e - s).alias("m")))


def entropy_spans(text: Column, allowed: tuple[str, ...] = ALLOWED, allowed_before: str = ALLOWED_BEFORE, words: str = ALLOWED_WORDS) -> Column:
    """Added spans of a text, those that overlap base spans included."""
    is_mixed = lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]")
    mixed = F.filter(spans(text, TOKEN), is_mixed)
    safe = lambda x: F.concat_ws("", before(text, x["start"], 24)).rlike(allowed_before)
    for rx in allowed:
        safe = lambda x, rest=safe, rx=rx: x["m"].rlike(rx) | rest(x)
    pieces = F.flatten(F.transform(F.filter(mixed, lambda x: ~safe(x)), lambda x: F.when(x["m"].rlike(words), _pieces(x, words)).otherwise(F.array(x))))
    pieces = F.filter(pieces, lambda x: (F.length(x["m"]) >= WINDOW) & is_mixed(x))
    return F.flatten(F.transform(pieces, lambda piece: _outer(_hits(F.filter(_runs(piece), is_mixed))))).cast(f"array<{_SPAN}>")


def _hits(runs: Column) -> Column:
    scanned = F.transform(runs, lambda x: F.struct(x.alias("x"), _class_of(x["m"]).alias("c")))
    scanned = F.transform(scanned, lambda y: F.struct(y["x"].alias("x"), y["c"].alias("c"), window_scan(y["x"]["m"], y["c"]["bits"]).alias("w")))
    hits = F.filter(scanned, lambda y: y["w"]["first"] >= 0)
    return F.transform(hits, lambda y: F.struct(
        y["c"]["kind"].alias("kind"), (y["x"]["start"] + y["w"]["first"]).alias("start"), (y["x"]["start"] + y["w"]["last"] + WINDOW).alias("end"),
        F.substring(y["x"]["m"], y["w"]["first"] + 1, y["w"]["last"] - y["w"]["first"] + WINDOW).alias("text"), y["w"]["best"].alias("bits"),
    )).cast(f"array<{_SPAN}>")


def _runs(piece: Column) -> Column:
    """A piece and the runs in it that belong to narrower classes than it does, as spans of the text."""
    inner = lambda rx: F.transform(
        F.filter(spans(piece["m"], rx), lambda r: F.length(r["m"]) < F.length(piece["m"])),
        lambda r: F.struct((piece["start"] + r["start"]).alias("start"), (piece["start"] + r["end"]).alias("end"), r["m"].alias("m")),
    )
    hexes, alnums = map(inner, RUNS)
    return F.concat(hexes, F.filter(alnums, lambda r: ~r["m"].rlike(CLASSES[0][1])), F.array(piece)).cast("array<struct<start:int,end:int,m:string>>")


def _outer(hits: Column) -> Column:
    """The spans of one piece that no other of its spans holds; of equal ones the first, that is the narrowest class."""

    def kept(found: Column) -> Column:
        wider = lambda x, y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
        same = lambda x, y: (y["start"] == x["start"]) & (y["end"] == x["end"])
        first = lambda x, i: F.forall(F.slice(found, F.lit(1), i), lambda y: ~same(x, y))
        return F.filter(found, lambda x, i: ~F.exists(found, lambda y: wider(x, y)) & first(x, i))

    # a one-element transform binds the spans once
    return F.get(F.transform(F.array(hits), kept), F.lit(0))


def _class_of(token: Column) -> Column:
    out = None
    for kind, rx, bits in CLASSES:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(bits).alias("bits"))
        out = F.when(token.rlike(rx), value) if out is None else out.when(token.rlike(rx), value)
    return out


def base_spans(text: Column) -> Column:
    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("text"), F.lit(None).cast("double").alias("bits"))).cast(f"array<{_SPAN}>")

    assign = F.filter(spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN_VALUE, 1)) >= 12)
    return F.concat(of("assign", assign), of("access", spans(text, ACCESS)), of("hex", spans(text, HEX)))


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base` and `added`: arrays of struct<kind, start, end, text, bits>, sorted by start, then kind as listed."""
    whole = docs.withColumn("_ss_text", F.coalesce(F.col(text), F.lit("")))
    found = whole.withColumn("_ss_base", base_spans(F.col("_ss_text"))).withColumn("_ss_more", entropy_spans(F.col("_ss_text")))
    free = F.filter("_ss_more", lambda x: ~F.exists("_ss_base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    out = found.withColumn("base", _by_start(F.col("_ss_base"))).withColumn("added", _by_start(free))
    return out.drop("_ss_text", "_ss_base", "_ss_more")


def _by_start(rows: Column) -> Column:
    order = (*KINDS, *(c[0] for c in CLASSES))
    rank = lambda k: F.array_position(F.array(*map(F.lit, order)), k)
    keyed = F.transform(rows, lambda x: F.struct(x["start"].alias("a"), rank(x["kind"]).alias("b"), x["end"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_spans(docs).select("doc_id", "base", "added")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(_by_start(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
