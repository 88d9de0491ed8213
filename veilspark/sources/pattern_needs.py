"""What every match of a regex holds: so many digits, so many of them in a row, one literal character, digits behind a word boundary, capitals.

Read from the regex's parse tree; a text that lacks any of it can't match, and the rule need not run on it.  Regexes that Python can't
parse (of custom rules) ask for nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

#: Characters that a text rarely has, rarest first; a rule that needs one of them is skipped on most texts.
RARE = "@#|;+/=_:,-."


@dataclass(frozen=True)
class Needs:
    """Of every match: digits in all, in a row anywhere, at its start and at its end; whether it is digits only; characters it holds; capitals A-Z."""

    digits: int = 0
    run: int = 0
    first: int = 0
    last: int = 0
    only: bool = True
    chars: frozenset[str] = frozenset()
    capitals: int = 0

    def then(self, other: Needs) -> Needs:
        return Needs(
            self.digits + other.digits, max(self.run, other.run, self.last + other.first), self.first + other.first if self.only else self.first,
            self.last + other.last if other.only else other.last, self.only and other.only, self.chars | other.chars,
            self.capitals + other.capitals,
        )

    def either(self, other: Needs) -> Needs:
        return Needs(
            min(self.digits, other.digits), min(self.run, other.run), min(self.first, other.first), min(self.last, other.last), self.only and other.only,
            self.chars & other.chars, min(self.capitals, other.capitals),
        )


_DIGIT, _ANY, _CAPITAL = Needs(1, 1, 1, 1), Needs(only=False), Needs(only=False, capitals=1)


def _only_digits(items: list) -> bool:
    return all(
        (kind is op.CATEGORY and value is op.CATEGORY_DIGIT) or (kind is op.LITERAL and 48 <= value <= 57) or (kind is op.RANGE and 48 <= value[0] and value[1] <= 57)
        for kind, value in items
    )


def _only_capitals(items: list) -> bool:
    return all((kind is op.LITERAL and 65 <= value <= 90) or (kind is op.RANGE and 65 <= value[0] and value[1] <= 90) for kind, value in items)


def _of(tree) -> Needs:
    out = Needs()
    for kind, value in tree:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        if kind is op.LITERAL:
            one = _DIGIT if 48 <= value <= 57 else Needs(only=False, chars=frozenset(chr(value)), capitals=int(65 <= value <= 90))
        elif kind is op.IN:
            one = _DIGIT if _only_digits(value) else _CAPITAL if _only_capitals(value) else _ANY
        elif kind is op.BRANCH:
            one = _of(value[1][0])
            for part in value[1][1:]:
                one = one.either(_of(part))
        elif kind is op.SUBPATTERN:
            one = _of(value[3])
        elif kind is op.ATOMIC_GROUP:
            one = _of(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, _, part = value
            each = _of(part)
            one = Needs(only=each.only)
            for _ in range(min(least, 64)):
                one = one.then(each)
            if not each.only and least:  # further repetitions may stand behind: only the last one's end is known
                one = Needs(one.digits, one.run, one.first, each.last, False, one.chars, one.capitals)
        else:
            one = _ANY
        out = out.then(one)
    return out


def needs_of(regex: str) -> tuple[int, int, str | None]:
    """(digits, digits in a row, a rare literal character or None) that every match holds."""
    try:
        found = _of(parser.parse(regex))
    except re.error:
        return 0, 0, None
    return found.digits, found.run, next((c for c in RARE if c in found.chars), None)


def _starts_at_boundary(tree) -> bool:
    kind, value = tree[0] if len(tree) else (None, None)
    return kind is op.AT and value is op.AT_BOUNDARY


def boundary_needs_of(regex: str) -> tuple[int, int]:
    """(digits in a row right behind a word boundary, capitals A-Z) that every match holds; capitals only where no part of the regex ignores case."""
    try:
        tree = parser.parse(regex)
    except re.error:
        return 0, 0
    found = _of(tree)
    return found.first if _starts_at_boundary(tree) else 0, 0 if re.search(r"\(\?[a-zA-Z]*i", regex) else found.capitals
