"""The rule catalog as rows: which rules a call uses, in which order ties between them are decided."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.catalog_national import NATIONAL
from veilspark.sources.catalog_shared import SHARED
from veilspark.sources.pattern_needs import boundary_needs_of, needs_of

ROW = "struct<rule:int,country:string,ordinal:int,type:string,regex:string,validator:string,needs:array<string>,required:boolean,literal:string,char:string,digits:int,run:int,head:int,capitals:int,words:array<string>>"


class UnknownCountry(ValueError):
    """A country code without rules."""


def available_countries() -> list[str]:
    return sorted(NATIONAL)


def outer_parts(regex: str) -> list[str]:
    """The top-level alternatives of a regex, with groups left out and classes reduced to `[]`."""
    parts, depth, i = [""], 0, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            piece, i = regex[i : i + 2], i + 2
        elif c == "[":
            piece, i = "[]", regex.index("]", i + 2) + 1
        else:
            piece, i = c, i + 1
            depth += c == "("
        if depth == 0:
            if piece == "|":
                parts.append("")
            else:
                parts[-1] += piece
        elif piece == ")":
            depth -= 1
            parts[-1] += "()" if depth == 0 else ""
    return parts


def required_literal(regex: str) -> str | None:
    """A text that every match starts with, or None."""
    parts = outer_parts(regex)
    found = re.match(r"(?:\\b)?((?:[A-Za-z0-9_@:-]|\\[+.\-])+)([?*{+]?)", parts[0]) if len(parts) == 1 else None
    if not found:
        return None
    plain = re.findall(r"\\?(.)", found[1])
    return "".join(plain[:-1] if found[2] else plain) or None


def parts_of_keywords(words: Sequence[str] | None) -> list[str] | None:
    """The longest part without spaces of each keyword, lower case: a context (its two sides are joined by a space) with a keyword is of a text
    with that part.  None where nothing can be told so: without keywords, or as a sigma's lower case depends on its neighbours."""
    parts = sorted({max(w.lower().split(" "), key=len) for w in words or ()})
    return None if not parts or any(c in p for p in parts for c in "σςΣ") else parts


@dataclass(frozen=True)
class Catalog:
    """Immutable.  `countries` None: all; order of explicit countries is kept and shared rules come last among ties."""

    countries: tuple[str, ...] | None = None
    custom: tuple[tuple[str, str], ...] = field(default=())
    #: Countries of one's own, or other rules for a known one: (code, ((type, regex, validator or None, keywords or None), ...)).
    more: tuple[tuple[str, tuple[tuple, ...]], ...] = field(default=())

    @classmethod
    def of(cls, countries: Sequence[str] | None = None, more: dict[str, Sequence[tuple]] | None = None) -> Catalog:
        """`more`: rules of countries of one's own, by code: (type, regex, validator or None, keywords or None) each."""
        own = tuple(sorted((code.upper(), tuple((*r[:3], None if r[3] is None else tuple(r[3])) for r in rules)) for code, rules in (more or {}).items()))
        if countries is None:
            return cls(more=own)
        codes = tuple(dict.fromkeys(c.upper() for c in countries))
        if missing := [c for c in codes if c not in NATIONAL and c not in dict(own)]:
            raise UnknownCountry(f"no rules for {', '.join(missing)}; known: {', '.join(available_countries())}")
        return cls(codes, more=own)

    def with_custom(self, name: str, regex: str) -> Catalog:
        """A catalog with one more rule, which is active for any countries."""
        return replace(self, custom=(*self.custom, (name, regex)))

    @lru_cache(maxsize=32)  # noqa: B019
    def rows(self) -> list[dict]:
        national = NATIONAL | dict(self.more)
        slices = [("SHARED", SHARED), *sorted(national.items())] if self.countries is None else [*((c, national[c]) for c in self.countries), ("SHARED", SHARED)]
        slices.append(("CUSTOM", [(name, regex, None, None) for name, regex in self.custom]))
        out = []
        for country, rules in slices:
            for ordinal, (kind, regex, validator, words) in enumerate(rules, 1):
                digits, run, char = needs_of(regex)
                head, capitals = boundary_needs_of(regex)
                out.append({
                    "rule": len(out), "country": country, "ordinal": ordinal, "type": kind, "regex": f"(?Ud){regex}", "validator": validator,
                    "needs": sorted({w.lower() for w in words}) if words else None, "required": words is not None,
                    "literal": required_literal(regex), "char": char, "digits": digits, "run": run, "head": head, "capitals": capitals,
                    "words": parts_of_keywords(words),
                })
        return out

    def literal(self) -> Column:
        """The rows as one constant array."""
        return F.from_json(F.lit(json.dumps(self.rows(), ensure_ascii=False)), f"array<{ROW}>")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows()], ROW)
