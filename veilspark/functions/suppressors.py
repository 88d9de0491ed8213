"""Context rules that discard a match, as boolean Columns.

A match row has: type, country, m (its text), s and e (offsets), before and after (up to 150 code points each side),
needs (keywords, lower case, of a rule that requires one; null otherwise).  The result is a plain OR; order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 150
NUMBERS = ("PHONE", "NATIONAL_ID", "SSN", "TAX_ID", "POSTAL_CODE")

# The vocabularies.  (?iUd): ignore case, Unicode classes, only line feeds end lines.
_CURRENCIES = r"EUR|€|\$|USD|GBP|£|CHF|ISK|SEK|NOK|DKK"
CURRENCY_AFTER = rf"(?iUd)^\s*(?:{_CURRENCIES}|euro|euros|dollar|dollars|pond|kronor|kroner|kr)\b"
DECIMALS_AFTER = rf"(?iUd)^[.,]\d{{1,2}}\s*(?:{_CURRENCIES}|euro|euros|kr(?:onor|oner)?|pond)\b"
CURRENCY_BEFORE = rf"(?Ud)(?:{_CURRENCIES})\s*$"
AMOUNT_BEFORE = r"(?iUd)(?:Montant|Beløb|Summa|Summe|Bedrag|Amount|Total|TTC|inkl|Upphæð)\s*:?\s*$"
UNIT_AFTER = (
    r"(?iUd)^\s*(?:kg|km|cm|mm|m[²³]?|m\b|g\b|l\b|ml|mg|GB|MB|KB|TB|%|jaar|maanden|weken|dagen|uur|minuten|seconden|stuks|st\b|pcs|pieces|"
    r"ans|mois|semaines|jours|heures|Jahre|Monate|Wochen|Tage|Stunden)\b"
)
REFERENCE_BEFORE = (
    r"(?iUd)(?:dossier|ref\.?|referentie|reference|référence|factuurnummer|invoice\s*(?:nr|number|no)?|bestelnummer|order\s*(?:nr|number|no)?|"
    r"kenmerk|ordernummer|Aktenzeichen|numéro\s*de\s*(?:dossier|facture|commande)|bestellnummer|Rechnungsnummer|artikelnr|article\s*no|"
    r"contract\s*(?:nr|number|no)?|pagina|page|Seite|blz\.?|Facture\s*n[°o]?|Faktura\s*n[°or]\.?|Lasku\s*n[°or]o?\.?|Rechnung\s*(?:Nr|n[°o])?|"
    r"faktura\s*(?:nr|n[°o])?|bestilling\s*(?:nr|n[°o])?|bestelling\s*n[°or]\.?|Reikningur\s*nr)\s*[:.]?\s*$"
)
LEGAL_BEFORE = r"(?iUd)(?:Art(?:ikel|icle|\.)|§|Artikel|Section|Sectie|Afdeling|paragraaf|Absatz|alinéa|punt|point|Punkt|lid)\s*$"
MATH_BEFORE, MATH_AFTER = r"(?Ud)[=+\-×÷*/]\s*$", r"(?Ud)^\s*[=+\-×÷*/]"
SEQUENCES = r"(?d)^(?:0{6,}|1234567890?|0123456789|9876543210?|1111111111?|000000000|123456789)$"
YEAR = r"(?Ud)^(?:19[4-9]\d|20[0-3]\d)$"
DATE_WORDS = (
    r"(?iUd)(?:jaar|year|année|Jahr|datum|date|Datum|in\s+\d{4}|since|sinds|depuis|seit|født|fødselsdato|fødsel|Fødselsdato|född|födelsedatum|"
    r"födelsedag|syntynyt|syntymäaika|fæddur|fæðingardagur|\d{2}\.\d{2}\.|(?:januar|februar|marts|april|maj|juni|juli|august|september|oktober|november|"
    r"december|januari|februari|mars|april|mei|juin|juillet|août|Tiltr[æa]delsesdato|Tiltredelsesdato))"
)
ID_LABEL_BEFORE = (
    r"(?iUd)(?:BSN|RR|NN|NIR|INSZ|NISS|NIS|Steuer-?ID|TIN|NIF|NIE|SSN|rijksregisternummer|numéro\s*national|national\s*number|matricule|Ausweisnummer|"
    r"Personalausweis|Versichertennummer|KVNR|KV-Nr|Steuernummer|St\.\-Nr|StNr|Finanzamt\s+ist|Ondernemingen\s+onder\s+nummer|ondernemingsnummer|"
    r"numéro\s*d'entreprise|enterprise\s*number|Kruispuntbank)\s*[:.]?\s*$"
)
SERVICE_NUMBER = r"(?Ud)^0800[\-\s]"
WHOLE_DATE = r"(?Ud)^\d{2}[-/.]\d{2}[-/.]\d{4}$"
PLATE_STOP_WORDS = ("ID", "NR", "NO", "ST", "DR", "MR", "MS", "HR", "FR", "IM", "IN", "OR", "IF", "IS", "IT", "AT", "AD", "AG", "AV", "BE", "DE", "EU", "NL", "LU", "WS", "SS", "IP")
PASSPORT_BEFORE = r"(?iUd)(?:Reisepass|passport|passeport|paspoort|Bisheriger\s+Reisepass)\s*(?:Nr\.?|Nummer|nummer|number|n[°o])?\s*[:.]?\s*$"
SWEDISH_ORGANISATION_BEFORE = r"(?iUd)(?:org\.?\s*nr\.?|organisationsnummer|organisationsnr|Bolagsverket|företag)\s*[:.]?\s*$"

Match = Column
Rule = Callable[[Match], Column]


def sequential(x: Match) -> Column:
    return F.regexp_replace(x["m"], r"(?U)[\s.\-]", "").rlike(SEQUENCES)


def currency(x: Match) -> Column:
    return x["after"].rlike(CURRENCY_AFTER) | x["before"].rlike(CURRENCY_BEFORE) | x["after"].rlike(DECIMALS_AFTER) | x["before"].rlike(AMOUNT_BEFORE)


def units(x: Match) -> Column:
    return x["after"].rlike(UNIT_AFTER)


def reference(x: Match) -> Column:
    return x["before"].rlike(REFERENCE_BEFORE)


def legal(x: Match) -> Column:
    return x["before"].rlike(LEGAL_BEFORE)


def arithmetic(x: Match) -> Column:
    return x["before"].rlike(MATH_BEFORE) | x["after"].rlike(MATH_AFTER)


def year_as_postal(x: Match) -> Column:
    address = x["before"].endswith(", ") | x["before"].endswith(",\n")
    return F.trim(x["m"]).rlike(YEAR) & ~address & F.concat(x["before"], x["after"]).rlike(DATE_WORDS)


def phone_after_id_label(x: Match) -> Column:
    return x["before"].rlike(ID_LABEL_BEFORE)


def phone_service_number(x: Match) -> Column:
    return x["m"].rlike(SERVICE_NUMBER)


def phone_is_date(x: Match) -> Column:
    return F.trim(x["m"]).rlike(WHOLE_DATE)


def plate_in_compound(x: Match) -> Column:
    """Part of a hyphenated word; a word that is no place code beside digits; a register number; a semester."""
    first = F.regexp_extract(F.trim(x["m"]), r"(?U)^([^\s\-]*)", 1)
    compound = (x["s"] >= 3) & F.right(x["before"], F.lit(10)).rlike(r"[A-Za-zÄÖÜäöüß]{2,}-$")
    stopped = first.isin(*PLATE_STOP_WORDS) & (x["after"].rlike(r"(?U)^\d") | x["before"].endswith("-"))
    return compound | stopped | first.isin("WS", "SS") | ((first == "IP") & x["after"].rlike(r"(?U)^\.\d")) | F.trim(x["m"]).rlike("^HR[AB]")


def id_as_passport(x: Match) -> Column:
    return x["before"].rlike(PASSPORT_BEFORE)


def swedish_organisation(x: Match) -> Column:
    return (x["country"] == "SE") & x["before"].rlike(SWEDISH_ORGANISATION_BEFORE)


def postal_inside_iban(x: Match) -> Column:
    inside = x["before"].rlike(r"[\p{L}\p{N}]$") & x["after"].rlike(r"^[\p{L}\p{N}]")
    return inside | ((x["s"] >= 5) & x["before"].rlike(r"(?Ud)[A-Z]{2}\d{2}\s$"))


def postal_as_house_number(x: Match) -> Column:
    short = F.length(F.regexp_replace(x["m"], r"(?U)\s", "")) <= 3
    street = F.right(x["before"], F.lit(30)).rlike(r"(?Ud)[a-záéíóúýþæöðA-ZÁÉÍÓÚÝÞÆÖÐ]{3,}\s+$")
    return short & street & ~F.left(x["after"], F.lit(5)).rlike(r"(?U)^,?\s+[A-ZÁÉÍÓÚÝÞÆÖÐ]")


def lacks_context(x: Match) -> Column:
    context = F.lower(F.concat(x["before"], F.lit(" "), x["after"]))
    return x["needs"].isNotNull() & (F.size(x["needs"]) > 0) & ~F.exists(x["needs"], lambda k: F.contains(context, k))


BY_TYPE: dict[str, list[Rule]] = {
    "PHONE": [currency, units, reference, arithmetic, phone_after_id_label, phone_service_number, phone_is_date],
    "NATIONAL_ID": [currency, units, reference, legal, arithmetic, id_as_passport, swedish_organisation],
    "SSN": [currency, units, reference, arithmetic],
    "TAX_ID": [currency, units, reference, arithmetic],
    "POSTAL_CODE": [currency, units, arithmetic, legal, year_as_postal, postal_inside_iban, postal_as_house_number],
    "IBAN": [reference],
    "LICENSE_PLATE": [plate_in_compound],
    "CHAMBER_OF_COMMERCE": [reference],
}


#: The types whose rules look at the context.
TYPED = tuple(BY_TYPE)


def suppressed(x: Match, more: tuple[tuple[str, Rule], ...] = ()) -> Column:
    """Whether any rule that applies to the match's type, of the table or of `more` (type, rule), discards it."""
    typed = None
    for kind in dict.fromkeys((*BY_TYPE, *(kind for kind, _ in more))):
        rules = [*BY_TYPE.get(kind, []), *(rule for other, rule in more if other == kind)]
        any_of = rules[0](x)
        for rule in rules[1:]:
            any_of = any_of | rule(x)
        typed = F.when(x["type"] == kind, any_of) if typed is None else typed.when(x["type"] == kind, any_of)
    return F.coalesce(sequential(x) | lacks_context(x) | typed.otherwise(False), F.lit(False))
