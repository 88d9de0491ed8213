"""Rules that hold in every country.

Fixed values: the regexes, keywords and validator names below decide what is found and are stated as they must be.
A rule is (entity type, regex, validator or None, keywords or None); a rule with keywords needs one of them near its match.
"""

_CREDENTIAL_WORDS = [
    "key", "token", "secret", "password", "credential", "api_key", "apikey", "api-key", "auth", "bearer",
    "aws_secret_access_key", "access_key", "private_key", "wachtwoord", "mot de passe", "Passwort", "Schlüssel",
    "clé", "sleutel", "lösenord", "hasło", "heslo", "jelszó", "contraseña", "senha", "parola",
    "kľúč", "nøkkel", "nyckel", "avain", "lykill",
]
_SETTING_WORDS = [
    "AES_KEY", "ENCRYPTION_KEY", "SIGNING_KEY", "ACCOUNT_SID", "AUTH_TOKEN", "TWILIO", "RAILS_SECRET", "SECRET_KEY_BASE",
    "DATABASE_URL", "NPM_TOKEN", "DIGITALOCEAN", "GOOGLE_API", "DB_PASS", "DB_PASSWORD", "DATASOURCE_PASSWORD", "JWT_SIGNING",
    "passwd", "Kennwort",
]
_BIRTH_WORDS = [
    "geboren", "geboortedatum", "date de naissance", "né le", "née le", "né(e) le", "nee le", "nee(e) le", "date of birth", "DOB",
    "Geburtsdatum", "geboren am", "geboren op", "nascido", "nacido", "data di nascita", "nato il", "nata il", "geb.", "geb.datum",
    "geb ", "birth date", "birthday", "naissance", "geboorte", "geburtstag",
]
_ISO_BIRTH_WORDS = [
    "geboren", "geboortedatum", "date de naissance", "né le", "née le", "né(e) le", "nee le", "date of birth", "DOB", "Geburtsdatum",
    "geboren am", "geboren op", "geb.", "birth date", "birthday", "naissance", "geboorte",
]
_DEATH_WORDS = [
    "overleden", "overlijdensdatum", "date de décès", "décédé le", "date of death", "Sterbedatum", "verstorben am", "gestorven",
    "death date", "died on", "mort le", "décès",
]
_DAY_FIRST = r"\b(?:0[1-9]|[12][0-9]|3[01])[/.\-](?:0[1-9]|1[0-2])[/.\-](?:19|20)\d{2}\b"
_HEX = "[0-9a-fA-F]"

SHARED = [
    ("EMAIL", r"\b[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}\b", None, None),
    ("BIC", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", "bic", None),
    (
        "CREDIT_CARD",
        r"\b(?:4[0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}|5[1-5][0-9]{2}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}"
        r"|3[47][0-9]{2}[\s\-]?[0-9]{6}[\s\-]?[0-9]{5})\b",
        "luhn",
        None,
    ),
    ("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", "vin", None),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", None, None),
    (
        "IPV6_ADDRESS",
        rf"\b(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}\b|\b(?:{_HEX}{{1,4}}:){{1,7}}:\b"
        rf"|\b(?:{_HEX}{{1,4}}:){{1,6}}:{_HEX}{{1,4}}\b|\b::(?:{_HEX}{{1,4}}:){{0,5}}{_HEX}{{1,4}}\b",
        None,
        None,
    ),
    ("MAC_ADDRESS", rf"\b(?:{_HEX}{{2}}[:\-]){{5}}{_HEX}{{2}}\b", None, None),
    ("MAC_ADDRESS", rf"\b{_HEX}{{4}}\.{_HEX}{{4}}\.{_HEX}{{4}}\b", None, None),
    ("IMEI", r"\b\d{15}\b", "imei", None),
    ("IMEI", r"\b\d{2}[\-\s]\d{6}[\-\s]\d{6}[\-\s]\d\b", "imei", None),
    (
        "GPS_COORDINATES",
        r"-?(?:[1-8]?\d(?:\.\d{4,})|90(?:\.0{4,}))\s*[,;/]\s*-?(?:1[0-7]\d(?:\.\d{4,})|180(?:\.0{4,})|\d{1,2}(?:\.\d{4,}))",
        None,
        None,
    ),
    ("UUID", rf"\b{_HEX}{{8}}-{_HEX}{{4}}-[1-5]{_HEX}{{3}}-[89abAB]{_HEX}{{3}}-{_HEX}{{12}}\b", None, None),
    ("SOCIAL_HANDLE", r"(?<!\w)@[a-zA-Z][a-zA-Z0-9_.]{1,29}\b", None, None),
    ("SECRET", r"\bAKIA[A-Z0-9]{16}\b", None, None),
    ("SECRET", r"\bgh[poas]_[a-zA-Z0-9]{36,}\b", None, None),
    ("SECRET", r"\bgithub_pat_[a-zA-Z0-9_]{22,}\b", None, None),
    ("SECRET", r"\bgl[a-z]t-[a-zA-Z0-9_\-]{20,}\b", None, None),
    ("SECRET", r"\bglpat-[a-zA-Z0-9_\-]{20,}\b", None, None),
    ("SECRET", r"\b[sp]k_(?:live|test)_[a-zA-Z0-9]{24,}\b", None, None),
    ("SECRET", r"\bsk-(?:ant-)?[a-zA-Z0-9\-_]{20,}\b", None, None),
    ("SECRET", r"\bxox[bpas]-\d[\d\-]{10,}", None, None),
    ("SECRET", r"\bxox[bpas]-[a-zA-Z0-9\-]{10,}", None, None),
    ("SECRET", r"\beyJ[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+\b", None, None),
    ("SECRET", r"\bSG\.[a-zA-Z0-9_\-]{22}\.[a-zA-Z0-9_\-]{43}\b", None, None),
    ("SECRET", r"\bhvs\.[a-zA-Z0-9_\-]{20,}\b", None, None),
    ("SECRET", r"\bkey-[a-f0-9]{20,}\b", None, None),
    ("SECRET", r"\bxapp-\d[\d\-]{20,}", None, None),
    ("SECRET", r"\bxapp-[a-zA-Z0-9\-]{20,}", None, None),
    ("SECRET", r"\bdapi[a-f0-9]{32,}\b", None, None),
    ("SECRET", r"\bnpm_[a-zA-Z0-9]{36,}\b", None, None),
    ("SECRET", r"\bAIza[a-zA-Z0-9_\-]{35}\b", None, None),
    ("SECRET", r"\bdop_v1_[a-f0-9]{64}\b", None, None),
    ("SECRET", r"\bAC[a-f0-9]{32}\b", None, None),
    ("SECRET", r"(?:mongodb|mysql|postgres(?:ql)?|redis|amqp|rabbitmq)://[^\s:]+:[^\s@]+@[^\s]+", None, None),
    ("SECRET", r"(?<=[:=] )[^\s]{8,}|(?<=[:=])[^\s]{8,}", "high_entropy", _CREDENTIAL_WORDS + _SETTING_WORDS),
    ("SECRET", r"\b[A-Za-z0-9_\-+/]{24,}[A-Za-z0-9_\-+/=]*\b", "high_entropy", _CREDENTIAL_WORDS),
    ("DOB", _DAY_FIRST, None, _BIRTH_WORDS),
    ("DATE_OF_DEATH", _DAY_FIRST, None, _DEATH_WORDS),
    ("DOB", r"\b(?:19|20)\d{2}[/.\-](?:0[1-9]|1[0-2])[/.\-](?:0[1-9]|[12][0-9]|3[01])\b", None, _ISO_BIRTH_WORDS),
]
