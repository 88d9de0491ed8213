"""Rules of 31 countries, in order of country code file and, in a country, of precedence.

Fixed values: regexes, keywords and validator names, as in `catalog_shared`.  IBANs are built from the country's
layout by `iban` and `compact`; separators and telephone groups are written with the shorthands below.
"""

S = r"[\s\-]?"  # an optional separator of telephone groups


def iban(code: str, *groups: str) -> tuple:
    """The grouped form: country, two check digits, then groups such as '4' (digits), 'A4' (letters), 'X4' (either)."""
    kinds = {"A": "[A-Z]", "X": "[A-Z0-9]"}
    parts = [kinds.get(g[0], r"\d") + (f"{{{n}}}" if (n := g.lstrip("AX")) != "1" else "") for g in groups]
    return ("IBAN", rf"\b{code}\d{{2}}\s?" + r"\s?".join(parts) + r"\b", "iban", None)


def compact(code: str, rest: str) -> tuple:
    return ("IBAN", rf"\b{code}{rest}\b", "iban", None)


ADDRESS_CODE = ("POSTAL_CODE", r"(?<=, )[1-9]\d{3}(?= [A-Z])", None, None)


def four_digits(*words: str) -> tuple:
    return ("POSTAL_CODE", r"\b[1-9]\d{3}\b", None, list(words))


def any_digits(regex: str, *words: str) -> tuple:
    return ("POSTAL_CODE", regex, None, list(words))


def phone(regex: str) -> tuple:
    return ("PHONE", regex, None, None)


def vat(regex: str, validator: str | None = None) -> tuple:
    return ("VAT", regex, validator, None)


def national(regex: str, validator: str | None = None) -> tuple:
    return ("NATIONAL_ID", regex, validator, None)


_FRENCH_ID_MONTH = r"(?:0[1-9]|1[0-2]|[2-9]\d)"
_DAY, _MONTH = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])"
_SWEDISH_ADDRESS = ["postnummer", "postort", "postkod", "adress", "bostadsadress", "gatuadress", "boende", "gatan", "vägen", "gata", "väg", "allé"]

NATIONAL = {
    "AT": [
        national(r"\b\d{4}\s?\d{6}\b", "austrian_svnr"),
        iban("AT", "4", "4", "4", "4"),
        vat(r"\bATU\d{8}\b"),
        phone(rf"\b0\d{{3,4}}{S}\d{{5,8}}\b"),
        phone(rf"\+43\s?\d{{3,4}}{S}\d{{5,8}}"),
        ("LICENSE_PLATE", r"\b[A-ZÄÖÜ]{1,2}\s?\d{1,5}\s?[A-Z]{1,2}\b", None, ["Kennzeichen", "Nummernschild", "Kfz-Kennzeichen"]),
        four_digits("PLZ", "Postleitzahl", "Adresse", "Anschrift", "Straße", "Str.", "Gasse", "Weg", "Platz", "Postal:", "Wohnort"),
        ADDRESS_CODE,
    ],
    "BE": [
        national(r"\b\d{2}\.?\d{2}\.?\d{2}[\-.]?\d{3}\.?\d{2}\b", "belgian_nn"),
        iban("BE", "4", "4", "4"),
        vat(r"\bBE\s?0\d{3}\.?\d{3}\.?\d{3}\b", "belgian_vat"),
        (
            "CHAMBER_OF_COMMERCE",
            r"\b0\d{3}\.?\d{3}\.?\d{3}\b",
            None,
            ["KBO", "BCE", "ondernemingsnummer", "numéro d'entreprise", "enterprise number", "bedrijfsnummer"],
        ),
        phone(r"\b0[1-9]\d{0,2}[/\s.\-]?\d{2,3}[.\s\-]?\d{2,3}[.\s\-]?\d{2,3}\b"),
        phone(r"\+32\s?\d{1,3}[\s.\-]?\d{2,3}[\s.\-]?\d{2}[\s.\-]?\d{2}"),
        ("PASSPORT", r"\b[A-Z]{2}\d{6}\b", None, ["paspoort", "passport", "passeport", "reisdocument", "travel document", "document de voyage"]),
        ("DRIVERS_LICENSE", r"\b\d{10}\b", None, ["rijbewijs", "permis de conduire", "driving licence", "driving license", "rijbewijsnummer"]),
        ("LICENSE_PLATE", r"\b[12][\-\s]?[A-Z]{3}[\-\s]?\d{3}\b", None, None),
        four_digits(
            "postcode", "code postal", "postnummer", "postal code", "zip", "B-", "adres", "adresse", "wonende", "woonplaats", "rue", "straat", "laan",
            "avenue", "boulevard", "plein", "steenweg", "chaussée", "domicilié", "gedomicilieerd", "Levering:", "siège",
        ),
        ADDRESS_CODE,
        (
            "HEALTHCARE_PROVIDER",
            r"\b\d{1}[\-.]?\d{5}[\-.]?\d{2}[\-.]?\d{3}\b",
            None,
            ["RIZIV", "INAMI", "arts", "médecin", "zorgverlener", "prestataire", "dokter", "doctor"],
        ),
    ],
    "BG": [
        national(r"\b\d{10}\b", "bulgarian_egn"),
        iban("BG", "A4", "4", "4", "4", "2"),
        vat(r"\bBG\d{9,10}\b"),
        phone(rf"\b0?[89][789]{S}\d{{3}}{S}\d{{3,4}}\b"),
        phone(r"\b0?[89][789]\d{7,8}\b"),
        phone(rf"\+359\s?[89][789]{S}\d{{3}}{S}\d{{3,4}}"),
        four_digits("пощенски код", "пощенски", "адрес", "ул.", "Postal:", "Address:"),
        ADDRESS_CODE,
    ],
    "CH": [
        national(r"\b756\.\d{4}\.\d{4}\.\d{2}\b", "swiss_ahv"),
        national(r"\b756\d{10}\b", "swiss_ahv"),
        ("CHAMBER_OF_COMMERCE", r"\bCHE[\-\s]?\d{3}\.?\d{3}\.?\d{3}\b", None, None),
        vat(r"\bCHE[\-\s]?\d{3}\.?\d{3}\.?\d{3}\s?(?:MWST|TVA|IVA)\b"),
        iban("CH", "X4", "X4", "X4", "X4", "X1"),
        phone(r"\b0\d{2}\s?\d{3}\s?\d{2}\s?\d{2}\b"),
        phone(r"\+41\s?\d{2}\s?\d{3}\s?\d{2}\s?\d{2}"),
        ("LICENSE_PLATE", r"\b[A-Z]{2}\s?\d{1,6}\b", None, ["Kontrollschild", "Nummernschild", "plaque", "immatriculation", "Kennzeichen"]),
        four_digits(
            "PLZ", "Postleitzahl", "code postal", "NPA", "Adresse", "Anschrift", "adresse", "rue", "Straße", "Str.", "Gasse", "chemin", "Postal:", "Wohnort"
        ),
        ADDRESS_CODE,
    ],
    "CY": [
        national(r"\b\d{8}[A-Z]\b"),
        iban("CY", "4", "4", "4", "4", "4", "4"),
        compact("CY", r"\d{26}"),
        vat(r"\bCY\d{8}[A-Z]\b"),
        phone(rf"\b[29]\d{{3}}{S}\d{{4}}\b"),
        phone(rf"\b[29]\d{S}\d{{3}}{S}\d{{3}}\b"),
        phone(r"\b[29]\d{7}\b"),
        phone(rf"\+357\s?[29]\d{S}\d{{3}}{S}\d{{3,4}}"),
        four_digits("Τ.Κ.", "ταχυδρομικός", "address", "Address:", "Postal:", "διεύθυνση"),
        ADDRESS_CODE,
    ],
    "CZ": [
        national(r"\b\d{6}/?\d{3,4}\b", "czech_birth_number"),
        iban("CZ", "4", "4", "4", "4", "4"),
        compact("CZ", r"\d{22}"),
        vat(r"\bCZ\d{8,10}\b"),
        phone(rf"\b[67]\d{{2}}{S}\d{{3}}{S}\d{{3}}\b"),
        phone(r"\b[67]\d{8}\b"),
        phone(rf"\+420\s?[67]\d{{2}}{S}\d{{3}}{S}\d{{3}}"),
        any_digits(r"\b\d{3}\s?\d{2}\b", "PSČ", "poštovní", "adresa", "ulice", "Postal:", "Address:"),
    ],
    "DE": [
        ("TAX_ID", r"\b[1-9]\d{10}\b", "german_tax_id", None),
        ("TAX_ID", r"\b[1-9]\d[\s.]?\d{3}[\s.]?\d{3}[\s.]?\d{3}\b", "german_tax_id", None),
        (
            "NATIONAL_ID",
            r"\b[CFGHJKLMNPRTVWXYZ][0-9A-Z]{8,9}\b",
            None,
            [
                "Personalausweis", "Personalausweisnummer", "Ausweis", "Ausweisnummer", "Ausweis-Nr", "identity card", "Identitätskarte", "Perso",
                "PA-Nummer",
            ],
        ),
        iban("DE", "4", "4", "4", "4", "2"),
        vat(r"\bDE\s?\d{9}\b", "vat_de"),
        phone(r"\b0[1-9]\d{1,4}[\s/\-]?\d{3,8}\b"),
        phone(r"\+49\s?\d{2,5}[\s/\-]?\d{3,8}\b"),
        (
            "PASSPORT",
            r"\b[CFGHJK][0-9A-Z]{8,9}\b",
            None,
            ["Reisepass", "passport", "Passnummer", "Reisepassnummer", "Reisepass Nummer", "Reisepass-Nr", "Pass Nr"],
        ),
        ("LICENSE_PLATE", r"\b[A-ZÄÖÜ]{1,3}[\s\-]?[A-Z]{1,2}[\s\-]?\d{1,4}[EH]?\b", None, None),
        any_digits(
            r"\b\d{5}\b", "PLZ", "Postleitzahl", "postal code", "postcode", "Anschrift", "Adresse", "Wohnort", "Ort", "Stadt", "wohnt", "wohnhaft", "Straße",
            "Str.", "Weg", "Platz", "Allee", "Ring",
        ),
        ("CHAMBER_OF_COMMERCE", r"\bHR[AB]\s?\d{4,6}\b", None, None),
        (
            "SSN",
            r"\b\d{2}[\s]?\d{6}[\s]?[A-Z][\s]?\d{3}\b",
            None,
            [
                "Rentenversicherung", "RV-Nummer", "Sozialversicherung", "SV-Nummer", "Versicherungsnummer", "Rentenversicherungsnummer",
                "Sozialversicherungsnummer",
            ],
        ),
        ("TAX_ID", r"\b\d{2,3}/\d{3,4}/\d{4,5}\b", None, ["Steuernummer", "St.-Nr", "StNr", "Finanzamt", "Steuer"]),
        ("TAX_ID", r"\b\d{13}\b", None, ["Steuernummer", "St.-Nr", "StNr", "Finanzamt", "Steuer"]),
        (
            "HEALTH_INSURANCE",
            r"\b[A-Z]\d{9}\b",
            None,
            [
                "Versichertennummer", "Krankenversicherung", "KV-Nummer", "Krankenkasse", "GKV", "Versichertenkarte", "Versicherter", "Versicherte", "KVNR",
                "Krankenversichertennummer",
            ],
        ),
    ],
    "DK": [
        national(rf"\b{_DAY}{_MONTH}\d{{2}}-\d{{4}}\b"),
        national(rf"\b{_DAY}{_MONTH}\d{{6}}\b", "danish_cpr"),
        iban("DK", "4", "4", "4", "2"),
        vat(r"\bDK\s?\d{8}\b", "danish_vat"),
        ("CHAMBER_OF_COMMERCE", r"\b\d{8}\b", "danish_vat", ["CVR", "CVR-nummer", "virksomhedsnummer", "virksomhedsregisteret"]),
        phone(r"\b[2-9]\d\s?\d{2}\s?\d{2}\s?\d{2}\b"),
        phone(r"\+45\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}"),
        ("LICENSE_PLATE", r"\b[A-Z]{2}\s?\d{2}\s?\d{3}\b", None, ["nummerplade", "registreringsnummer", "reg.nr", "køretøj"]),
        four_digits(
            "postnummer", "postby", "postnr", "adresse", "bopæl", "bopælsadresse", "gade", "vej", "allé", "plads", "torv", "stræde", "boulevard", "Arbejdssted"
        ),
    ],
    "EE": [
        national(r"\b[1-6]\d{10}\b", "estonian_id"),
        iban("EE", "4", "4", "4", "4"),
        compact("EE", r"\d{18}"),
        vat(r"\bEE\d{9}\b"),
        phone(rf"\b5\d{{3}}{S}\d{{4}}\b"),
        phone(r"\b5\d{7}\b"),
        phone(rf"\+372\s?5\d{{3}}{S}\d{{3,4}}"),
        any_digits(r"\b\d{5}\b", "postiindeks", "sihtnumber", "aadress", "address", "Address:", "Postal:"),
    ],
    "EL": [
        ("TAX_ID", r"\b\d{9}\b", "greek_afm", None),
        national(r"\b\d{11}\b", "greek_amka"),
        iban("GR", "4", "4", "4", "4", "4", "3"),
        compact("GR", r"\d{25}"),
        vat(r"\bEL\d{9}\b"),
        phone(rf"\b69\d{S}\d{{3,4}}{S}\d{{4}}\b"),
        phone(r"\b69\d{8}\b"),
        phone(rf"\b2\d{{1,3}}{S}\d{{3,4}}{S}\d{{3,4}}\b"),
        phone(rf"\+30\s?\d{{2,4}}{S}\d{{3,4}}{S}\d{{3,4}}"),
        any_digits(r"\b\d{3}\s?\d{2}\b", "Τ.Κ.", "ταχυδρομικός", "address", "Address:", "Postal:", "διεύθυνση", "οδός"),
    ],
    "ES": [
        national(r"\b\d{8}[A-Z]\b", "spanish_dni"),
        national(r"\b[XYZ]\d{7}[A-Z]\b", "spanish_nie"),
        iban("ES", "4", "4", "4", "4", "4"),
        vat(r"\bES[A-Z0-9]\d{7}[A-Z0-9]\b"),
        phone(rf"\b[679]\d{{2}}{S}\d{{3}}{S}\d{{3}}\b"),
        phone(r"\b[679]\d{8}\b"),
        phone(rf"\b[679]\d{S}\d{{3}}{S}\d{{2}}{S}\d{{2}}\b"),
        phone(rf"\+34\s?[679]\d{{2}}{S}\d{{3}}{S}\d{{3}}"),
        ("LICENSE_PLATE", r"\b\d{4}\s?[BCDFGHJKLMNPRSTVWXYZ]{3}\b", None, None),
        any_digits(
            r"\b(?:0[1-9]|[1-4]\d|5[0-2])\d{3}\b", "código postal", "C.P.", "CP", "dirección", "domicilio", "calle", "avenida", "plaza", "paseo", "camino",
            "Postal:",
        ),
    ],
    "FI": [
        national(r"\b\d{6}[-+ABCDEFYXWVU]\d{3}[0-9A-FHJK-NPR-Y]\b", "finnish_hetu"),
        iban("FI", "4", "4", "4", "2"),
        vat(r"\bFI\d{8}\b"),
        ("CHAMBER_OF_COMMERCE", r"\b\d{7}-\d\b", "finnish_business_id", None),
        phone(r"\b0\d{1,2}\s?\d{3,4}\s?\d{3,4}\b"),
        phone(rf"\+358\s?\d{{1,3}}{S}\d{{3,4}}{S}\d{{3,4}}"),
        ("LICENSE_PLATE", r"\b[A-Z]{2,3}[\-\s]?\d{3}\b", None, ["rekisteritunnus", "rekisterinumero", "rekisterikilpi", "ajoneuvo"]),
        any_digits(r"\b\d{5}\b", "postinumero", "postitoimipaikka", "osoite", "kotiosoite", "katuosoite"),
    ],
    "FR": [
        national(rf"\b[12]\s?\d{{2}}\s?{_FRENCH_ID_MONTH}\s?\d{{2}}[0-9AB]?\s?\d{{3}}\s?\d{{3}}\s?\d{{2}}\b", "french_nir"),
        ("NATIONAL_ID", r"\b\d{12}\b", None, ["carte d'identité", "CNI", "carte nationale", "identity card", "pièce d'identité"]),
        iban("FR", "4", "4", "4", "4", "4", "3"),
        vat(r"\bFR\s?[0-9A-HJ-NP-Z]{2}\s?\d{9}\b", "vat_fr"),
        phone(r"\b0[1-9][\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}\b"),
        phone(r"\+33\s?[1-9][\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}"),
        ("PASSPORT", r"\b\d{2}[A-Z]{2}\d{5}\b", None, ["passeport", "passport", "numéro de passeport"]),
        ("LICENSE_PLATE", r"\b[A-Z]{2}[\-\s]?\d{3}[\-\s]?[A-Z]{2}\b", None, None),
        any_digits(
            r"\b(?:0[1-9]|[1-8]\d|9[0-5]|97[1-6])\d{3}\b", "code postal", "CP", "postal code", "postcode", "adresse", "domicilié", "résidant", "rue", "avenue",
            "boulevard", "place", "chemin", "allée", "impasse", "ville",
        ),
        (
            "CHAMBER_OF_COMMERCE",
            r"\b\d{3}\s?\d{3}\s?\d{3}\b",
            None,
            ["SIREN", "siren", "RCS", "entreprise", "immatricul", "numéro d'entreprise", "registre du commerce"],
        ),
        ("CHAMBER_OF_COMMERCE", r"\b\d{3}\s?\d{3}\s?\d{3}\s?\d{5}\b", None, ["SIRET", "siret", "établissement", "immatricul"]),
        (
            "TAX_ID",
            r"\b\d{13}\b",
            None,
            ["numéro fiscal", "SPI", "référence fiscale", "avis d'impôt", "impôt sur le revenu", "déclaration fiscale", "fiscal"],
        ),
    ],
    "HR": [
        national(r"\b\d{11}\b", "croatian_oib"),
        iban("HR", "4", "4", "4", "4", "3"),
        compact("HR", r"\d{2}\s\d{4}\s\d{4}\s\d{4}\s\d{5}"),
        compact("HR", r"\d{19}"),
        vat(r"\bHR\d{11}\b"),
        phone(rf"\b0?9[12579]{S}\d{{3}}{S}\d{{3,4}}\b"),
        phone(r"\b0?9[12579]\d{7,8}\b"),
        phone(rf"\+385\s?9[12579]{S}\d{{3}}{S}\d{{3,4}}"),
        any_digits(r"\b[1-5]\d{4}\b", "poštanski broj", "poštanski", "adresa", "ulica", "Postal:", "Address:"),
    ],
    "HU": [
        national(r"\b\d{9}\b", "hungarian_taj"),
        national(r"\b\d{3}\s\d{3}\s\d{3}\b", "hungarian_taj"),
        ("TAX_ID", r"\b8\d{9}\b", None, ["adóazonosító", "adószám", "adóazonosító jel"]),
        vat(r"\bHU\d{8,11}\b"),  # its keywords are inert
        iban("HU", "4", "4", "4", "4", "4", "4"),
        compact("HU", r"\d{26}"),
        phone(rf"\b06\s?\d{{1,2}}{S}\d{{3}}{S}\d{{3,4}}\b"),
        phone(rf"\+36\s?\d{{1,2}}{S}\d{{3}}{S}\d{{3,4}}"),
        four_digits("irányítószám", "postai", "cím", "utca", "Postal:", "Address:"),
        ADDRESS_CODE,
    ],
    "IE": [
        national(r"\b\d{7}[A-W][ABWTXZ]?\b", "irish_pps"),
        iban("IE", "A4", "4", "4", "4", "2"),
        compact("IE", r"\d{2}[A-Z]{4}\d{14}"),
        vat(r"\bIE\d{7}[A-Z]\b"),
        phone(rf"\b0[89]\d{S}\d{{3}}{S}\d{{4}}\b"),
        phone(r"\b0[89]\d{8}\b"),
        phone(rf"\b0[1-9]\d{{0,2}}{S}\d{{5,8}}\b"),
        phone(rf"\+353\s?\d{{1,3}}{S}\d{{3,4}}{S}\d{{3,4}}"),
        any_digits(r"\b[A-Z]\d{2}\s?[A-Z0-9]{4}\b", "Eircode", "postcode", "postal code", "address", "Address:", "Postal:"),
    ],
    "IS": [
        national(r"\b\d{6}-?\d{4}\b", "icelandic_kt"),
        iban("IS", "4", "4", "4", "4", "4", "2"),
        phone(r"\b[3-9]\d{2}\s\d{4}\b"),
        (
            "PHONE",
            r"\b[3-9]\d{6}\b",
            None,
            ["sími", "símanúmer", "farsími", "gsm", "phone", "tel", "hringja", "hringdu", "ná í", "nás á", "nás", "SMS", "sent to"],
        ),
        phone(r"\+354\s?\d{3}\s?\d{4}"),
        ("LICENSE_PLATE", r"\b[A-Z]{2}\s?\d{3}\b", None, ["skráningarnúmer", "bílnúmer", "ökutæki", "bifreið", "plata"]),
        any_digits(r"\b[1-9]\d{2}\b", "póstnúmer", "póstfang", "staður", "heimilisfang"),
    ],
    "IT": [
        national(r"\b[A-Z]{6}\d{2}[ABCDEHLMPRST]\d{2}[A-Z]\d{3}[A-Z]\b", "italian_cf"),
        ("IBAN", r"\bIT\d{2}\s?[A-Z]\d{3}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{3}\b", "iban", None),
        compact("IT", r"\d{2}[A-Z]\d{22}"),
        vat(r"\bIT\d{11}\b"),
        phone(rf"\b3\d{{2}}{S}\d{{3}}{S}\d{{4}}\b"),
        phone(rf"\b0\d{{1,3}}{S}\d{{6,8}}\b"),
        phone(r"\b0\d{1,2}[\s\-]\d{3}[\s\-]\d{4}\b"),
        phone(rf"\+39\s?\d{{2,3}}{S}\d{{3,4}}{S}\d{{3,4}}"),
        ("LICENSE_PLATE", r"\b[A-Z]{2}\s?\d{3}\s?[A-Z]{2}\b", None, None),
        any_digits(
            r"\b\d{5}\b", "CAP", "codice postale", "codice di avviamento", "indirizzo", "via", "viale", "piazza", "corso", "largo", "vicolo", "Domicilio",
            "domicilio", "Residenza", "residenza", "Postal:",
        ),
    ],
    "LT": [
        national(r"\b[1-6]\d{10}\b", "estonian_id"),
        iban("LT", "4", "4", "4", "4"),
        compact("LT", r"\d{18}"),
        vat(r"\bLT\d{9,12}\b"),
        phone(rf"\b6\d{{2}}{S}\d{{2}}{S}\d{{3}}\b"),
        phone(r"\b6\d{7}\b"),
        phone(rf"\b8{S}6\d{{2}}{S}\d{{2}}{S}\d{{3}}\b"),
        phone(rf"\+370\s?6\d{{2}}{S}\d{{2}}{S}\d{{3}}"),
        ("POSTAL_CODE", r"\bLT-\d{5}\b", None, None),
    ],
    "LU": [
        national(rf"\b(?:19|20)\d{{2}}\s{_MONTH}\s{_DAY}\s\d{{3}}\s\d{{2}}\b"),
        national(rf"\b(?:19|20)\d{{2}}{_MONTH}{_DAY}\d{{5}}\b"),
        iban("LU", "X4", "X4", "X4", "X4"),
        vat(r"\bLU\s?\d{8}\b", "vat_lu"),
        phone(rf"\b(?:2[0-9]|[4-9]\d){S}\d{{2}}{S}\d{{2}}{S}\d{{2}}\b"),
        phone(r"\b(?:2[0-9]|[4-9]\d)\d{6}\b"),
        phone(rf"\b6[2-9]\d{S}\d{{3}}{S}\d{{3}}\b"),
        phone(rf"\+352\s?\d{{2,3}}{S}\d{{2,3}}{S}\d{{2,4}}"),
        ("POSTAL_CODE", r"\bL[\-\s]?\d{4}\b", None, None),
        (
            "LICENSE_PLATE",
            r"\b[A-Z]{2}[\s\-]?\d{3,5}\b",
            None,
            ["plaque", "immatriculation", "Kennzeichen", "nummerplaat", "véhicule", "voiture", "Fahrzeug", "immatriculé"],
        ),
        ("CHAMBER_OF_COMMERCE", r"\b[ABCDEFGJ]\s?\d{4,6}\b", None, ["RCS", "Registre de Commerce", "Handelsregister", "registre", "inscrit"]),
    ],
    "LV": [
        national(r"\b\d{6}-\d{5}\b"),
        ("NATIONAL_ID", rf"\b{_DAY}{_MONTH}\d{{7}}\b", None, ["personas kods", "PK", "identifikācijas"]),
        iban("LV", "A4", "4", "4", "4", "1"),
        compact("LV", r"\d{2}[A-Z]{4}\d{13}"),
        vat(r"\bLV\d{11}\b"),
        phone(rf"\b[2]\d{{3}}{S}\d{{4}}\b"),
        phone(r"\b[2]\d{7}\b"),
        phone(rf"\+371\s?[2]\d{{3}}{S}\d{{3,4}}"),
        ("POSTAL_CODE", r"\bLV-\d{4}\b", None, None),
    ],
    "MT": [
        national(r"\b\d{5,7}[MGAPLHBZ]\b"),
        iban("MT", "A4", "4", "4", "X4", "X4", "X4", "X3"),
        compact("MT", r"\d{2}[A-Z]{4}\d{5}[A-Z0-9]{18}"),
        vat(r"\bMT\d{8}\b"),
        phone(rf"\b[79]\d{{3}}{S}\d{{4}}\b"),
        phone(r"\b[79]\d{7}\b"),
        phone(rf"\+356\s?[79]\d{{3}}{S}\d{{3,4}}"),
        any_digits(r"\b[A-Z]{3}\s?\d{4}\b", "kodiċi postali", "postcode", "address", "Address:", "Postal:"),
    ],
    "NL": [
        national(r"\b[0-9]{9}\b", "bsn"),
        national(r"\b[0-9]{2,4}\.[0-9]{2,4}\.[0-9]{2,4}\b", "bsn"),
        iban("NL", "A4", "4", "4", "2"),
        vat(r"\bNL\d{9}B\d{2}\b", "vat_nl"),
        (
            "CHAMBER_OF_COMMERCE",
            r"\b\d{8}\b",
            "kvk",
            ["KvK", "Kamer van Koophandel", "kvk-nummer", "KVK-nummer", "handelsregister", "chamber of commerce"],
        ),
        phone(rf"\b0[1-9]\d{S}\d{{3}}{S}\d{{4}}\b"),
        phone(rf"\b0[1-9]\d{{2}}{S}\d{{6,7}}\b"),
        phone(rf"\b06{S}\d{{4}}{S}\d{{4}}\b"),
        phone(r"\b06\d{8}\b"),
        phone(rf"\b06{S}\d{{2}}{S}\d{{2}}{S}\d{{2}}{S}\d{{2}}\b"),
        phone(rf"\b0[1-9]\d{{1,2}}{S}\d{{2,3}}{S}\d{{2}}{S}\d{{2}}\b"),
        phone(rf"\+31\s?[1-9]\d{{0,2}}{S}\d{{3,4}}{S}\d{{3,4}}\b"),
        (
            "PASSPORT",
            r"\b[A-Z][A-Z0-9]{8}\b",
            None,
            ["paspoort", "passport", "reisdocument", "travel document", "paspoortnummer", "identiteitsbewijs"],
        ),
        (
            "LICENSE_PLATE",
            r"\b(?:[A-Z]{2}[\-\s]?\d{3}[\-\s]?[A-Z]|\d[\-\s]?[A-Z]{3}[\-\s]?\d{2}|\d{2}[\-\s]?[A-Z]{3}[\-\s]?\d"
            r"|[A-Z]{2}[\-\s]?\d{2}[\-\s]?[A-Z]{2}|\d{2}[\-\s]?[A-Z]{2}[\-\s]?\d{2}|\d[\-\s]?[A-Z]{2}[\-\s]?\d{3})\b",
            None,
            None,
        ),
        ("POSTAL_CODE", r"\b[1-9]\d{3}\s?[A-Z]{2}\b", None, None),
    ],
    "NO": [
        national(r"\b\d{11}\b", "norwegian_fnr"),
        national(r"\b\d{6}\s\d{5}\b", "norwegian_fnr"),
        iban("NO", "4", "4", "3"),
        vat(r"\bNO\s?\d{9}\s?MVA\b"),
        ("CHAMBER_OF_COMMERCE", r"\b[89]\d{8}\b", "norwegian_org", None),
        phone(r"\b[2-9]\d\s?\d{2}\s?\d{2}\s?\d{2}\b"),
        phone(r"\+47\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}"),
        ("LICENSE_PLATE", r"\b[A-Z]{2}\s?\d{5}\b", None, None),
        any_digits(
            r"\b\d{4}\b", "postnummer", "poststed", "postnr", "adresse", "bostedsadresse", "gate", "vei", "veien", "gata", "plass", "stien", "allé"
        ),
    ],
    "PL": [
        national(r"\b\d{11}\b", "polish_pesel"),
        ("TAX_ID", r"\b\d{3}-?\d{3}-?\d{2}-?\d{2}\b", "polish_nip", None),
        iban("PL", "4", "4", "4", "4", "4", "4"),
        compact("PL", r"\d{26}"),
        vat(r"\bPL\d{10}\b"),
        phone(rf"\b[5-8]\d{{2}}{S}\d{{3}}{S}\d{{3}}\b"),
        phone(r"\b[5-8]\d{8}\b"),
        phone(rf"\+48\s?[5-8]\d{{2}}{S}\d{{3}}{S}\d{{3}}"),
        ("POSTAL_CODE", r"\b\d{2}-\d{3}\b", None, None),  # its keywords are inert
    ],
    "PT": [
        national(r"\b[1-35-9]\d{8}\b", "portuguese_nif"),
        national(r"\b[1-35-9]\d{2}[\s.]\d{3}[\s.]\d{3}\b", "portuguese_nif"),
        iban("PT", "4", "4", "4", "4", "5"),
        vat(r"\bPT\d{9}\b"),
        phone(rf"\b[29]\d{{2}}{S}\d{{3}}{S}\d{{3}}\b"),
        phone(r"\b[29]\d{8}\b"),
        phone(rf"\+351\s?[29]\d{{2}}{S}\d{{3}}{S}\d{{3}}"),
        ("LICENSE_PLATE", r"\b[A-Z0-9]{2}-[A-Z0-9]{2}-[A-Z0-9]{2}\b", None, None),
        ("POSTAL_CODE", r"\b\d{4}-\d{3}\b", None, None),
    ],
    "RO": [
        national(r"\b[1-8]\d{12}\b", "romanian_cnp"),
        compact("RO", r"\d{2}[A-Z]{4}\d{16}"),
        vat(r"\bRO\d{2,10}\b"),
        phone(rf"\b0?7[2-9]\d{{1}}{S}\d{{3}}{S}\d{{3,4}}\b"),
        phone(r"\b0?7[2-9]\d{7,8}\b"),
        phone(rf"\+40\s?7[2-9]\d{{1}}{S}\d{{3}}{S}\d{{3,4}}"),
        any_digits(r"\b\d{6}\b", "cod poștal", "cod postal", "adresă", "strada", "Postal:", "Address:"),
    ],
    "SE": [
        national(r"\b\d{8}[-+]?\d{4}\b", "swedish_pnr"),
        national(r"\b\d{6}[-+]\d{4}\b", "swedish_pnr"),
        national(r"\b\d{10}\b", "swedish_pnr"),
        iban("SE", "4", "4", "4", "4", "4"),
        vat(r"\bSE\d{12}\b"),
        phone(r"\b0\d{1,3}[\-\s]?\d{2,3}[\s]?\d{2,3}[\s]?\d{2}\b"),
        phone(rf"\+46\s?\d{{1,3}}{S}\d{{2,3}}{S}\d{{2,3}}{S}\d{{2}}"),
        ("LICENSE_PLATE", r"\b[A-Z]{3}\s?\d{2}[A-Z0-9]\b", None, None),
        any_digits(r"\b\d{3}\s?\d{2}\b", *_SWEDISH_ADDRESS, "plats", "torg", "stigen", "Bostadsadress"),
        any_digits(r"\b\d{4}\s\d{2}\b", *_SWEDISH_ADDRESS),
        any_digits(r"\b\d{6}\b", *_SWEDISH_ADDRESS),
        ("CHAMBER_OF_COMMERCE", r"\b\d{6}-?\d{4}\b", None, ["organisationsnummer", "org.nr", "org nr", "Bolagsverket", "registreringsnummer"]),
    ],
    "SI": [
        national(r"\b\d{13}\b", "slovenian_emso"),
        iban("SI", "4", "4", "4", "3"),
        compact("SI", r"\d{17}"),
        vat(r"\bSI\d{8}\b"),
        phone(rf"\b0?[34567]\d{{1}}{S}\d{{3}}{S}\d{{3}}\b"),
        phone(r"\b0?[34567]\d{7}\b"),
        phone(rf"\+386\s?[34567]\d{{1}}{S}\d{{3}}{S}\d{{3}}"),
        four_digits("poštna številka", "poštna", "naslov", "ulica", "Postal:", "Address:"),
        ADDRESS_CODE,
    ],
    "SK": [
        national(r"\b\d{6}/?\d{3,4}\b", "czech_birth_number"),
        iban("SK", "4", "4", "4", "4", "4"),
        compact("SK", r"\d{22}"),
        vat(r"\bSK\d{10}\b"),
        phone(rf"\b0?9\d{{2}}{S}\d{{3}}{S}\d{{3}}\b"),
        phone(rf"\+421\s?9\d{{2}}{S}\d{{3}}{S}\d{{3}}"),
        any_digits(r"\b\d{3}\s?\d{2}\b", "PSČ", "poštové", "adresa", "ulica", "Postal:", "Address:"),
    ],
    "UK": [
        national(r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[ABCD]\b"),
        ("HEALTH_INSURANCE", r"\b\d{3}\s?\d{3}\s?\d{4}\b", "uk_nhs", ["NHS", "NHS number", "health number", "NHS no"]),
        iban("GB", "A4", "4", "4", "4", "2"),
        compact("GB", r"\d{2}[A-Z]{4}\d{14}"),
        vat(r"\bGB\d{9}\b"),
        phone(rf"\b07[4-9]\d{{2}}{S}\d{{3}}{S}\d{{3}}\b"),
        phone(r"\b07[4-9]\d{8}\b"),
        phone(rf"\b0[12]\d{{2}}{S}\d{{3}}{S}\d{{4}}\b"),
        phone(rf"\b0[12]\d{{2}}{S}\d{{4}}{S}\d{{4}}\b"),
        phone(r"\b0[12]\d{9,10}\b"),
        phone(rf"\+44\s?\d{{2,4}}{S}\d{{3,4}}{S}\d{{3,4}}"),
        ("POSTAL_CODE", r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b", None, None),
    ],
}
