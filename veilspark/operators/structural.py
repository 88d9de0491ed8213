"""Dates of birth in JSON-like pairs and in delimited text with a header, as candidates of priority 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.expressions import let, match_spans

# Names of date-of-birth fields and the shape of a date.
FIELDS = (
    "geboortedatum", "date_naissance", "date de naissance", "geburtsdatum", "dob", "birth_date", "birthdate", "date_of_birth", "fecha_nacimiento",
    "data_nascita", "born", "naissance", "geboren",
)
DATE = r"(?U)(?:0[1-9]|[12]\d|3[01])[/.\-](?:0[1-9]|1[0-2])[/.\-](?:19|20)\d{2}|(?:19|20)\d{2}[/.\-](?:0[1-9]|1[0-2])[/.\-](?:0[1-9]|[12]\d|3[01])"
PAIR = r"(?U)\"([^\"]+?)\"\s*:\s*\"([^\"]*?)\""
PAIR_START = r"(?U)^\"[^\"]+?\"\s*:\s*\""
#: After every rule of the catalog.
RANK = 1_000_000


def _named(field: Column) -> Column:
    return F.exists(F.array(*map(F.lit, FIELDS)), lambda k: F.contains(F.lower(field), k))


def _first_date(value: Column, offset: Column, rank: int) -> Column:
    """An array with the first date of `value`, or an empty one."""
    return F.transform(F.slice(match_spans(value, F.lit(DATE)), 1, 1), lambda x: F.struct(
        F.lit("DOB").alias("type"), (offset + x["s"]).alias("s"), (offset + x["e"]).alias("e"), x["m"].alias("m"), F.lit("SHARED").alias("country"), F.lit(1).alias("priority"),
        F.lit(rank).alias("rank"),
    ))


def json_dates(text: Column) -> Column:
    """The pair's key holds a field name; the value need not be in valid JSON."""
    pairs = F.filter(match_spans(text, F.lit(PAIR)), lambda x: _named(F.regexp_extract(x["m"], PAIR, 1)))
    lead = lambda m: F.length(F.regexp_substr(m, F.lit(PAIR_START)))
    return F.flatten(F.transform(pairs, lambda x: _first_date(F.regexp_extract(x["m"], PAIR, 2), x["s"] + lead(x["m"]), RANK)))


def delimited_dates(text: Column) -> Column:
    """The delimiter is the first of | ; tab , that the first line holds at least twice; there is no quoting."""

    def of_lines(lines: Column) -> Column:
        head = F.get(lines, F.lit(0))
        often = lambda c: F.length(head) - F.length(F.replace(head, F.lit(c), F.lit(""))) >= 2
        mark = F.when(often("|"), "|").when(often(";"), ";").when(often("\t"), "\t").when(often(","), ",")
        quoted = F.concat(F.lit("\\Q"), mark, F.lit("\\E"))
        wanted = F.transform(F.split(head, quoted, -1), _named)

        def of_line(state: Column, line: Column) -> Column:
            def of_field(inner: Column, field: Column) -> Column:
                here = F.coalesce(F.get(wanted, inner["i"]), F.lit(False)) & (state["i"] > 0) & (F.trim(line) != "")
                found = F.when(here, _first_date(field, inner["at"], RANK + 1)).otherwise(F.array().cast(_ROWS))
                return F.struct((inner["i"] + 1).alias("i"), (inner["at"] + F.length(field) + 1).alias("at"), F.concat(inner["out"], found).alias("out"))

            start = F.struct(F.lit(0).alias("i"), state["at"].alias("at"), state["out"].alias("out"))
            done = F.aggregate(F.split(line, quoted, -1), start, of_field)
            return F.struct((state["i"] + 1).alias("i"), (state["at"] + F.length(line) + 1).alias("at"), done["out"].alias("out"))

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast(_ROWS).alias("out"))
        rows = F.aggregate(lines, zero, of_line)["out"]
        return F.when(mark.isNotNull() & (F.size(lines) > 1) & F.exists(wanted, lambda w: w), rows).otherwise(F.array().cast(_ROWS))

    return let(F.split(text, "\n", -1), of_lines)


_ROWS = "array<struct<type:string,s:int,e:int,m:string,country:string,priority:int,rank:int>>"


def structural_dates(text: Column) -> Column:
    dated = text.rlike(DATE)
    return F.when(dated, F.concat(json_dates(text).cast(_ROWS), delimited_dates(text))).otherwise(F.array().cast(_ROWS))
