"""Check-digit and format validators as Column expressions, by name.

Each entry says what is stripped from the candidate, the form of the rest, and the rule on its digits.
Nothing runs in Python; `validate` dispatches on a column of names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.expressions import digits, let, weighted

Rule = Callable[[Column], Column]

# Total lengths of IBANs by country; tables of check letters.
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BY": 28, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28, "CZ": 24, "DK": 18,
    "DO": 28, "TL": 23, "EE": 20, "FO": 18, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27, "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IQ": 23,
    "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KZ": 20, "XK": 20, "KW": 30, "LV": 21, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "MT": 31, "MR": 27, "MU": 30,
    "MC": 27, "MD": 24, "ME": 22, "NL": 18, "MK": 19, "NO": 15, "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "LC": 32, "SM": 27, "SA": 24,
    "RS": 22, "SC": 31, "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TN": 24, "TR": 26, "UA": 29, "AE": 23, "GB": 22, "VA": 22, "VG": 24,
}
FINNISH_LETTERS = "0123456789ABCDEFHJKLMNPRSTUVWXY"
SPANISH_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ITALIAN_ODD = {
    "0": 1, "1": 0, "2": 5, "3": 7, "4": 9, "5": 13, "6": 15, "7": 17, "8": 19, "9": 21, "A": 1, "B": 0, "C": 5, "D": 7, "E": 9, "F": 13, "G": 15, "H": 17,
    "I": 19, "J": 21, "K": 2, "L": 4, "M": 18, "N": 20, "O": 11, "P": 3, "Q": 6, "R": 8, "S": 12, "T": 14, "U": 16, "V": 10, "W": 22, "X": 25, "Y": 24, "Z": 23,
}


def _stripped(rx: str, form: str, rule: Rule | None = None, upper: bool = False, prefix: str = "") -> Rule:
    """Strip `rx` (and a country prefix), require `form`, then apply `rule` to the rest."""

    def build(text: Column) -> Column:
        clean = F.regexp_replace(text, rx, "") if rx else F.trim(text)
        clean = F.upper(clean) if upper else clean
        clean = F.regexp_replace(clean, f"^{prefix}", "") if prefix else clean
        return let(clean, lambda c: F.when(c.rlike(form), rule(c)).otherwise(False) if rule else c.rlike(form))

    return build


def _on_digits(rx: str, form: str, rule: Rule, **more) -> Rule:
    return _stripped(rx, form, lambda c: let(digits(c), rule), **more)


def _luhn(d: Column) -> Column:
    doubled = F.transform(F.reverse(d), lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod(digits_text: Column, n: int) -> Column:
    """The number modulo n, for up to 18 digits."""
    return digits_text.cast("long") % n


def _iso_7064(d: Column) -> Column:
    def step(product: Column, x: Column) -> Column:
        total = (x + product) % 10
        return (F.when(total == 0, 10).otherwise(total) * 2) % 11

    return (11 - F.aggregate(F.slice(d, 1, 10), F.lit(10), step)) % 10 == F.get(d, F.lit(10))


def _at(d: Column, i: int) -> Column:
    return F.get(d, F.lit(i))


def _complement(weights: list[int], place: int, eleven: int | None = 0, ten: int | None = None) -> Rule:
    """11 - (weighted sum mod 11) is the digit at `place`; 11 counts as `eleven` and 10 as `ten` (None: invalid)."""

    def rule(d: Column) -> Column:
        def compare(c: Column) -> Column:
            want = F.when(c == 11, F.lit(eleven)).when(c == 10, F.lit(ten)).otherwise(c)
            return F.coalesce(want.cast("int") == _at(d, place), F.lit(False))

        return let(11 - weighted(d, weights) % 11, compare)

    return rule


def _remainder(weights: list[int], place: int, modulus: int = 11, as_digit: dict[int, int] | None = None) -> Rule:
    """The weighted sum modulo `modulus` (replaced as in `as_digit`) is the digit at `place`."""

    def rule(d: Column) -> Column:
        value = weighted(d, weights) % modulus
        for r, digit in (as_digit or {}).items():
            value = F.when(value == r, digit).otherwise(value)
        return value == _at(d, place)

    return rule


def _iban(text: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for pair in sorted(IBAN_LENGTHS.items()) for x in pair])

    def rule(c: Column) -> Column:
        size = F.try_element_at(lengths, F.substring(c, 1, 2))
        turned = F.filter(F.split(F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4)), ""), lambda x: x != "")

        def step(r: Column, x: Column) -> Column:  # letters are the two digits 10 ... 35
            return F.when(x.rlike("[0-9]"), (r * 10 + x.cast("int")) % 97).otherwise((r * 100 + F.ascii(x) - 55) % 97)

        return (size.isNull() | (size == F.length(c))) & (F.aggregate(turned, F.lit(0), step) == 1)

    return let(F.upper(F.regexp_replace(text, "[ \\-]", "")), lambda c: F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), rule(c)).otherwise(False))


def _belgian_nn(c: Column) -> Column:
    check = F.substring(c, 10, 2).cast("int")
    nine = F.substring(c, 1, 9)
    return (97 - _mod(nine, 97) == check) | (97 - _mod(F.concat(F.lit("2"), nine), 97) == check)


def _french_nir(c: Column) -> Column:
    """Corsican numbers have A or B; the letter counts as 0 and 1,000,000 or 2,000,000 is taken off."""
    number = F.translate(c, "AB", "00")
    first = F.substring(number, 1, 13).cast("long") - F.when(F.contains(c, F.lit("A")), 1_000_000).when(F.contains(c, F.lit("B")), 2_000_000).otherwise(0)
    return number.rlike("^[0-9]{15}$") & ~(F.contains(c, F.lit("A")) & F.contains(c, F.lit("B"))) & (97 - F.pmod(first, F.lit(97)) == F.substring(number, 14, 2).cast("int"))


def _date(c: Column, month: int, day: int) -> Column:
    return F.substring(c, month, 2).cast("int").between(1, 12) & F.substring(c, day, 2).cast("int").between(1, 31)


def _swedish(c: Column) -> Column:
    return let(F.when(F.length(c) == 12, F.substring(c, 3, 10)).otherwise(c), lambda x: _date(x, 3, 5) & _luhn(digits(x)))


def _letter(number: Column, letters: str, c: Column, place: int) -> Column:
    return F.substring(F.lit(letters), (number % len(letters) + 1).cast("int"), F.lit(1)) == F.substring(c, place, 1)


def _italian(c: Column) -> Column:
    odd = F.create_map(*[F.lit(x) for pair in ITALIAN_ODD.items() for x in pair])
    even = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 65)
    values = F.transform(F.filter(F.split(F.substring(c, 1, 15), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, F.element_at(odd, x)).otherwise(even(x)))
    return F.chr(65 + F.aggregate(values, F.lit(0), lambda a, b: a + b) % 26) == F.substring(c, 16, 1)


def _irish(c: Column) -> Column:
    second = F.when(F.length(c) == 9, (F.ascii(F.substring(c, 9, 1)) - 64) * 9).otherwise(0)
    r = (weighted(digits(F.substring(c, 1, 7)), [8, 7, 6, 5, 4, 3, 2]) + second) % 23
    return F.when(r == 0, F.lit("W")).otherwise(F.chr(64 + r)) == F.substring(c, 8, 1)


def _estonian(d: Column) -> Column:
    first, second = weighted(d, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1]) % 11, weighted(d, [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]) % 11
    return F.when(first != 10, first).when(second != 10, second).otherwise(0) == _at(d, 10)


def _entropy(text: Column) -> Column:
    def rule(c: Column) -> Column:
        n = F.length(c)
        chars = F.filter(F.split(c, ""), lambda x: x != "")
        counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
        bits = -F.aggregate(F.transform(counts, lambda p: p * F.log2(p)), F.lit(0.0), lambda a, b: a + b)
        special = c.rlike("[^a-zA-Z0-9]")
        least = F.when(c.rlike("^[a-fA-F0-9]+$"), 3.0).when(n < 24, 3.0).otherwise(3.5)
        return (
            F.when(n < 8, False)
            .when((n < 24) & c.rlike("[a-zA-Z]") & c.rlike(r"(?U)\d") & special, True)
            .when((n < 16) & ~special, False)
            .otherwise(bits >= least - math.ulp(1.0) * 4)
        )

    return let(F.trim(text), rule)


_WS, _DOT, _DASH = r"(?U)\s", r"(?U)[\s.\-]", r"(?U)[\s\-]"

VALIDATORS: dict[str, Rule] = {
    "iban": _iban,
    "bsn": _on_digits(_DOT, "^[0-9]{9}$", lambda d: let(weighted(d, [9, 8, 7, 6, 5, 4, 3, 2, -1]), lambda s: (s % 11 == 0) & (s != 0))),
    "belgian_nn": _stripped(_DOT, "^[0-9]{11}$", _belgian_nn),
    "luhn": _on_digits(_DASH, "^[0-9]{12,}$", _luhn),
    "belgian_vat": _stripped(_DOT, "^0[0-9]{9}$", lambda c: 97 - _mod(F.substring(c, 1, 8), 97) == F.substring(c, 9, 2).cast("int"), upper=True, prefix="BE"),
    "vat_nl": _stripped(_DOT, "^[0-9]{9}B[0-9]{2}$", upper=True, prefix="NL"),
    "vat_de": _stripped(_DOT, "^[0-9]{9}$", upper=True, prefix="DE"),
    "vat_fr": _stripped(_DOT, "^[0-9A-HJ-NP-Z]{2}[0-9]{9}$", upper=True, prefix="FR"),
    "vat_lu": _stripped(_DOT, "^[0-9]{8}$", upper=True, prefix="LU"),
    "german_tax_id": _on_digits(r"(?U)[\s.\-/]", "^[1-9][0-9]{10}$", _iso_7064),
    "french_nir": _stripped(_DOT, "^[0-9AB]{15}$", _french_nir, upper=True),
    "vin": _stripped("[ \\-]", "^[^IOQ]{17}$", upper=True),
    "bic": _stripped(" ", r"^\p{L}{6}[\p{L}\p{N}]{2}(?:[\p{L}\p{N}]{3})?$", upper=True),
    "kvk": _stripped(_DOT, "^[0-9]{8}$"),
    "swedish_pnr": _stripped(r"(?U)[\s\-+]", "^(?:[0-9]{10}|[0-9]{12})$", _swedish),
    "norwegian_fnr": _on_digits(
        _DASH, "^[0-9]{11}$", lambda d: _complement([3, 7, 6, 1, 8, 9, 4, 5, 2], 9)(d) & _complement([5, 4, 3, 2, 7, 6, 5, 4, 3, 2], 10)(d)
    ),
    "finnish_hetu": _stripped(
        "", "^[0-9]{6}[-+ABCDEFYXWVU][0-9]{3}.$", lambda c: _letter(F.concat(F.substring(c, 1, 6), F.substring(c, 8, 3)).cast("long"), FINNISH_LETTERS, c, 11)
    ),
    "icelandic_kt": _on_digits(_DASH, "^[0-9]{10}$", _complement([3, 2, 7, 6, 5, 4, 3, 2], 8)),
    "danish_vat": _on_digits(_DASH, "^[0-9]{8}$", lambda d: weighted(d, [2, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0, upper=True, prefix="DK"),
    "finnish_business_id": _on_digits(r"(?U)\s|(?<=^[^-]{0,40})-(?=[^-]*$)", "^[0-9]{8}$", _complement([7, 9, 10, 5, 8, 4, 2], 7)),
    "imei": _on_digits(r"(?U)[\s\-/]", "^(?!00000000)[0-9]{15}$", _luhn),
    "danish_cpr": _stripped(_DASH, "^[0-9]{10}$", lambda c: _date(c, 3, 1)),
    "norwegian_org": _on_digits(_DASH, "^[89][0-9]{8}$", _complement([3, 2, 7, 6, 5, 4, 3, 2], 8)),
    "austrian_svnr": _on_digits(_WS, "^[0-9]{10}$", _remainder([3, 7, 9, 0, 5, 8, 4, 2, 1, 6], 3)),
    "swiss_ahv": _on_digits(_DOT, "^756[0-9]{10}$", lambda d: (10 - weighted(d, [1, 3] * 6) % 10) % 10 == _at(d, 12)),
    "italian_cf": _stripped("", "^[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]$", _italian, upper=True),
    "spanish_dni": _stripped("", "^[0-9]{8}[A-Z]$", lambda c: _letter(F.substring(c, 1, 8).cast("long"), SPANISH_LETTERS, c, 9), upper=True),
    "spanish_nie": _stripped("", "^[XYZ][0-9]{7}[A-Z]$", lambda c: _letter(F.translate(F.substring(c, 1, 8), "XYZ", "012").cast("long"), SPANISH_LETTERS, c, 9), upper=True),
    "portuguese_nif": _on_digits(_DOT, "^[1-35-9][0-9]{8}$", _complement([9, 8, 7, 6, 5, 4, 3, 2], 8, 0, 0)),
    "polish_pesel": _on_digits(_DASH, "^[0-9]{11}$", lambda d: (10 - weighted(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == _at(d, 10)),
    "polish_nip": _on_digits(_DASH, "^[0-9]{10}$", _remainder([6, 5, 7, 2, 3, 4, 5, 6, 7], 9)),
    "czech_birth_number": _stripped(r"(?U)[/\s]", "^[0-9]{9,10}$", lambda c: (F.length(c) == 9) | (_mod(c, 11) == 0)),
    "romanian_cnp": _on_digits(_DASH, "^[1-8][0-9]{12}$", _remainder([2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9], 12, as_digit={10: 1})),
    "hungarian_taj": _on_digits(_DASH, "^[0-9]{9}$", _remainder([3, 7] * 4, 8, modulus=10)),
    "bulgarian_egn": _on_digits(_DASH, "^[0-9]{10}$", _remainder([2, 4, 8, 5, 10, 9, 7, 3, 6], 9, as_digit={10: 0})),
    "croatian_oib": _on_digits(_DASH, "^[0-9]{11}$", _iso_7064),
    "slovenian_emso": _on_digits(_DASH, "^[0-9]{13}$", _complement([7, 6, 5, 4, 3, 2] * 2, 12)),
    "irish_pps": _stripped("", "^[0-9]{7}[A-W][ABWTXZ]?$", _irish, upper=True),
    "estonian_id": _on_digits(_DASH, "^[1-6][0-9]{10}$", _estonian),
    "uk_nhs": _on_digits(_DASH, "^[0-9]{10}$", _complement([10, 9, 8, 7, 6, 5, 4, 3, 2], 9)),
    "greek_afm": _on_digits(_DASH, "^[0-9]{9}$", lambda d: weighted(d, [2 ** (8 - i) for i in range(8)]) % 11 % 10 == _at(d, 8)),
    "greek_amka": _on_digits(_DASH, "^[0-9]{11}$", _luhn),
    "high_entropy": _entropy,
}


def validate(name: Column, text: Column, names: list[str] | None = None, more: dict[str, Rule] | None = None) -> Column:
    """Whether `text` passes the validator `name`, of `more` or registered; true where the name is null or unknown."""
    known, out = VALIDATORS | (more or {}), None
    for key in (k for k in (names if names is not None else known) if k in known):
        out = F.when(name == key, known[key](text)) if out is None else out.when(name == key, known[key](text))
    return F.lit(True) if out is None else F.when(name.isNull(), True).otherwise(F.coalesce(out, F.lit(True)))
