"""Queries over the provided tables, one or more for each operator family, with SQL for most of them.

Texts with national numbers are not in the tables, so candidates for validators and context rules are built from keys:
the right-most digits of a multiple of o_orderkey, behind a fixed lead where a number needs one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import suppressors
from veilspark.functions.expressions import match_spans
from veilspark.functions.validators import VALIDATORS, validate
from veilspark.operators import evaluate
from veilspark.operators.labels import label_table, redact_with_labels
from veilspark.operators.redact import Redactor, resolved
from veilspark.sources.catalog import Catalog, available_countries
from veilspark.sources.catalog_shared import SHARED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _spread(df: DataFrame) -> DataFrame:
    """Scans are bound by CPU: a table in fewer partitions than there are cores is dealt out; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one detection by the rules of four countries and the shared ones."""
    found = Redactor.of(["NL", "BE", "DE", "FR"]).redact(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.where(F.size("detections") > 0).select("doc_id", F.size("detections").alias("n_detections"), "redacted_text")


def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the rules of all countries, with dates."""
    found = Redactor(detect_dates=True).redact(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    types = F.array_join(F.array_sort(evaluate.distinct_types(F.col("detections"))), ",")
    return found.select("doc_id", F.size("detections").cast("long").alias("n_detections"), types.alias("types"), "redacted_text")


# -- validators ------------------------------------------------------------------------------------------------------------------

def _sum(weights: list[int]) -> str:
    return "(" + " + ".join(f"substr(c, {i}, 1)::INT * ({w})" for i, w in enumerate(weights, 1)) + ")"


def _luhn_sql(n: int) -> str:
    def one(i: int) -> str:
        x = f"substr(c, {i}, 1)::INT"
        return f"(CASE WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END)" if (n - i) % 2 else x

    return "(" + " + ".join(one(i) for i in range(1, n + 1)) + ") % 10 = 0"


def _eleven(weights: list[int], place: int, ten: str = "NULL") -> str:
    """11 - sum mod 11 is the digit at `place` (1-based)."""
    r = f"(11 - {_sum(weights)} % 11)"
    return f"coalesce(CASE {r} WHEN 11 THEN 0 WHEN 10 THEN {ten} ELSE {r} END = substr(c, {place}, 1)::INT, false)"


_FNR = _eleven([3, 7, 6, 1, 8, 9, 4, 5, 2], 10) + " AND " + _eleven([5, 4, 3, 2, 7, 6, 5, 4, 3, 2], 11)
_EE1, _EE2 = _sum([1, 2, 3, 4, 5, 6, 7, 8, 9, 1]), _sum([3, 4, 5, 6, 7, 8, 9, 1, 2, 3])
_ES = "'TRWAGMYFPDXBNJZSQVHLCKE'"

#: Formats without a check digit: (what is dropped in front, the form of the rest).  Their candidates are good, a character short, one long, or
#: have a letter for the last digit, by the key modulo 4.
FORMS = {
    "vat_nl": ("NL", "[0-9]{9}B[0-9]{2}"), "vat_de": ("DE", "[0-9]{9}"), "vat_fr": ("FR", "[0-9A-HJ-NP-Z]{2}[0-9]{9}"), "vat_lu": ("LU", "[0-9]{8}"), "vin": ("", "[0-9A-HJ-NPR-Z]{17}"),
    "bic": ("", "[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?"), "kvk": ("", "[0-9]{8}"),
}


def _varied(name: str, c: Column) -> Column:
    if name not in FORMS:
        return c
    k, n = F.col("o_orderkey") % 4, F.length(c)
    return F.when(k == 1, F.left(c, n - 1)).when(k == 2, F.concat(c, F.lit("7"))).when(k == 3, F.concat(F.left(c, n - 1), F.lit("O"))).otherwise(c)


def _varied_sql(name: str, c: str) -> str:
    if name not in FORMS:
        return c
    return f"(SELECT CASE o_orderkey % 4 WHEN 1 THEN left(z, length(z) - 1) WHEN 2 THEN z || '7' WHEN 3 THEN left(z, length(z) - 1) || 'O' ELSE z END FROM (SELECT {c} AS z))"


#: validator: (lead, number of further digits, tail in SQL, SQL over the candidate c)
VALIDATED: dict[str, tuple[str, int, str, str]] = {
    "bsn": ("", 9, "''", f"{_sum([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0 AND {_sum([9, 8, 7, 6, 5, 4, 3, 2, -1])} <> 0"),
    "belgian_nn": ("", 11, "''", "97 - substr(c, 1, 9)::BIGINT % 97 = substr(c, 10, 2)::INT OR 97 - ('2' || substr(c, 1, 9))::BIGINT % 97 = substr(c, 10, 2)::INT"),
    "luhn": ("4", 15, "''", _luhn_sql(16)),
    "belgian_vat": ("0", 9, "''", "97 - substr(c, 1, 8)::BIGINT % 97 = substr(c, 9, 2)::INT"),
    "vat_nl": ("NL", 9, "'B01'", "true"),
    "vat_de": ("DE", 9, "''", "true"),
    "vat_fr": ("FR", 11, "''", "false"),
    "vat_lu": ("LU", 8, "''", "true"),
    "french_nir": ("1", 14, "''", "97 - substr(c, 1, 13)::BIGINT % 97 = substr(c, 14, 2)::INT"),
    "vin": ("WVW", 14, "''", "true"),
    "bic": ("DEUTDE", 2, "''", "true"),
    "kvk": ("", 8, "''", "true"),
    "swedish_pnr": ("", 10, "''", f"substr(c, 3, 2)::INT BETWEEN 1 AND 12 AND substr(c, 5, 2)::INT BETWEEN 1 AND 31 AND {_luhn_sql(10)}"),
    "norwegian_fnr": ("", 11, "''", _FNR),
    "finnish_hetu": ("", 6, "'-1' || right('0' || (o_orderkey % 89)::VARCHAR, 2) || 'K'", "substr('0123456789ABCDEFHJKLMNPRSTUVWXY', ((substr(c, 1, 6) || substr(c, 8, 3))::BIGINT % 31)::INT + 1, 1) = substr(c, 11, 1)"),
    "icelandic_kt": ("", 10, "''", _eleven([3, 2, 7, 6, 5, 4, 3, 2], 9)),
    "danish_vat": ("", 8, "''", f"{_sum([2, 7, 6, 5, 4, 3, 2, 1])} % 11 = 0"),
    "finnish_business_id": ("", 8, "''", _eleven([7, 9, 10, 5, 8, 4, 2], 8)),
    "imei": ("35", 13, "''", _luhn_sql(15)),
    "danish_cpr": ("", 10, "''", "substr(c, 1, 2)::INT BETWEEN 1 AND 31 AND substr(c, 3, 2)::INT BETWEEN 1 AND 12"),
    "norwegian_org": ("9", 8, "''", _eleven([3, 2, 7, 6, 5, 4, 3, 2], 9)),
    "austrian_svnr": ("", 10, "''", f"{_sum([3, 7, 9, 0, 5, 8, 4, 2, 1, 6])} % 11 = substr(c, 4, 1)::INT"),
    "swiss_ahv": ("756", 10, "''", f"(10 - {_sum([1, 3] * 6)} % 10) % 10 = substr(c, 13, 1)::INT"),
    "spanish_dni": ("", 8, "'K'", f"substr({_ES}, (substr(c, 1, 8)::BIGINT % 23)::INT + 1, 1) = substr(c, 9, 1)"),
    "spanish_nie": ("X", 7, "'K'", f"substr({_ES}, (substr(c, 2, 7)::BIGINT % 23)::INT + 1, 1) = substr(c, 9, 1)"),
    "portuguese_nif": ("2", 8, "''", _eleven([9, 8, 7, 6, 5, 4, 3, 2], 9, "0")),
    "polish_pesel": ("", 11, "''", f"(10 - {_sum([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = substr(c, 11, 1)::INT"),
    "polish_nip": ("", 10, "''", f"{_sum([6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = substr(c, 10, 1)::INT"),
    "czech_birth_number": ("", 10, "''", "c::BIGINT % 11 = 0"),
    "romanian_cnp": ("1", 12, "''", f"CASE WHEN {_sum([2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 = 10 THEN 1 ELSE {_sum([2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9])} % 11 END = substr(c, 13, 1)::INT"),
    "hungarian_taj": ("", 9, "''", f"{_sum([3, 7] * 4)} % 10 = substr(c, 9, 1)::INT"),
    "bulgarian_egn": ("", 10, "''", f"{_sum([2, 4, 8, 5, 10, 9, 7, 3, 6])} % 11 % 10 = substr(c, 10, 1)::INT"),
    "slovenian_emso": ("", 13, "''", _eleven([7, 6, 5, 4, 3, 2] * 2, 13)),
    "irish_pps": ("", 7, "'K'", f"CASE WHEN {_sum([8, 7, 6, 5, 4, 3, 2])} % 23 = 0 THEN 'W' ELSE chr(64 + {_sum([8, 7, 6, 5, 4, 3, 2])} % 23) END = substr(c, 8, 1)"),
    "estonian_id": ("3", 10, "''", f"CASE WHEN {_EE1} % 11 <> 10 THEN {_EE1} % 11 WHEN {_EE2} % 11 <> 10 THEN {_EE2} % 11 ELSE 0 END = substr(c, 11, 1)::INT"),
    "uk_nhs": ("", 10, "''", _eleven([10, 9, 8, 7, 6, 5, 4, 3, 2], 10)),
    "greek_afm": ("", 9, "''", f"{_sum([256, 128, 64, 32, 16, 8, 4, 2])} % 11 % 10 = substr(c, 9, 1)::INT"),
    "greek_amka": ("", 11, "''", _luhn_sql(11)),
    "iban": ("NL", 2, "'ABNA' || right('0000000000' || (o_orderkey * 48271)::VARCHAR, 10)", "(right('0000000000' || (o_orderkey * 48271)::VARCHAR, 10))::HUGEINT IS NOT NULL AND (('10112310' || substr(c, 9, 10) || '2321' || substr(c, 3, 2))::HUGEINT % 97 = 1)"),
}


def _candidate(lead: str, n: int) -> Column:
    return F.concat(F.lit(lead), F.right(F.concat(F.lit("0" * n), (F.col("o_orderkey") * 6_700_417 * 97 + 31).cast("string")), F.lit(n)))


_TAILS: dict[str, Column | str] = {
    "''": "", "'B01'": "B01", "'K'": "K",
}


def _tail(name: str) -> Column:
    if name == "finnish_hetu":
        return F.concat(F.lit("-1"), F.right(F.concat(F.lit("0"), (F.col("o_orderkey") % 89).cast("string")), F.lit(2)), F.lit("K"))
    if name == "iban":
        return F.concat(F.lit("ABNA"), F.right(F.concat(F.lit("0" * 10), (F.col("o_orderkey") * 48271).cast("string")), F.lit(10)))
    return F.lit(_TAILS[VALIDATED[name][2]])


def _validator_query(name: str) -> Query:
    lead, n, _, _ = VALIDATED[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", _varied(name, F.concat(_candidate(lead, n), _tail(name))).alias("candidate"))
        return rows.select("o_orderkey", "candidate", validate(F.lit(name), F.col("candidate")).alias("valid"))  # by the dispatch

    return query


for _name, (_lead, _n, _end, _sql) in VALIDATED.items():
    _made = f"'{_lead}' || right('{'0' * _n}' || (o_orderkey * 649940449 + 31)::VARCHAR, {_n}) || {_end}"
    if _name in FORMS:
        _sql = f"regexp_full_match(regexp_replace(c, '^{FORMS[_name][0]}', ''), '{FORMS[_name][1]}')"
    _add(f"validate_{_name}", _validator_query(_name), f"SELECT o_orderkey, c AS candidate, ({_sql}) AS valid FROM (SELECT o_orderkey, {_varied_sql(_name, _made)} AS c FROM orders)")


def _other_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO 7064, Italian and entropy rules, whose SQL would be a loop: valid counts over built candidates."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", _candidate("1", 10).alias("eleven"), F.concat(F.lit("RSSMRA85T10A"), F.right(F.concat(F.lit("000"), F.col("o_orderkey").cast("string")), F.lit(3)), F.lit("S")).alias("cf"), F.sha1(F.col("o_orderkey").cast("string")).alias("hex"))
    pairs = [("german_tax_id", "eleven"), ("croatian_oib", "eleven"), ("italian_cf", "cf"), ("high_entropy", "hex")]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("validator"), VALIDATORS[v](F.col(c)).alias("valid")) for v, c in pairs])).alias("v")
    return rows.select(each).groupBy("v.validator").agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.col("v.valid").cast("long")).alias("valid"))


_DIGITS = "list_transform(range(1, 11), lambda i: substr(eleven, i, 1)::INTEGER)"
_ISO = f"(11 - list_reduce(list_prepend(10, {_DIGITS}), lambda p, d: CASE WHEN (p + d) % 10 = 0 THEN 20 ELSE (p + d) % 10 * 2 END % 11)) % 10 = substr(eleven, 11, 1)::INTEGER"
_ODD = "[1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]"
_PLACE = "strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(cf, i, 1))"
_CF = f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN ({_ODD})[{_PLACE}] WHEN {_PLACE} > 10 THEN {_PLACE} - 11 ELSE {_PLACE} - 1 END)) % 26 = ascii(substr(cf, 16, 1)) - 65"
_add("validate_others", _other_validators, f"""
WITH r AS (SELECT '1' || right('0000000000' || (o_orderkey * 649940449 + 31)::VARCHAR, 10) AS eleven, 'RSSMRA85T10A' || right('000' || o_orderkey::VARCHAR, 3) || 'S' AS cf, sha1(o_orderkey::VARCHAR) AS hex FROM orders),
v AS (
  SELECT 'german_tax_id' AS validator, {_ISO} AS valid FROM r UNION ALL SELECT 'croatian_oib', {_ISO} FROM r UNION ALL SELECT 'italian_cf', {_CF} FROM r
  UNION ALL SELECT 'high_entropy', list_aggregate(string_split(hex, ''), 'entropy') >= 3.0 - 1e-12 FROM r)
SELECT validator, count(*) AS candidates, sum(valid::BIGINT)::BIGINT AS valid FROM v GROUP BY validator
""")

# -- scans -----------------------------------------------------------------------------------------------------------------------

#: Letters beyond ASCII count as word characters in the rules; RE2's do not, so SQL sees them as underscores.
_FOLDED = r"regexp_replace(regexp_replace(text, '[À-ɏ]', '_', 'g'), '[^\x00-\x7F]', ' ', 'g')"


def _scan_query(place: int) -> Query:
    kind, regex, _, _ = SHARED[place]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = match_spans(F.col("text"), F.lit(f"(?Ud){regex}"))
        rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text"), spans.alias("spans"))
        return rows.select("doc_id", F.size("spans").cast("long").alias("n_matches"), F.array_join(F.transform("spans", lambda x: x["m"]), "|").alias("matches"))

    return query


for _place in (0, 1, 2, 4, 6, 8, 11, 13, 26):
    _kind, _regex = SHARED[_place][:2]
    _q = _regex.replace("'", "''")
    _add(
        f"scan_{_kind.lower()}_{_place + 1}", _scan_query(_place),
        f"SELECT doc_id, len(regexp_extract_all({_FOLDED}, '{_q}'))::BIGINT AS n_matches, array_to_string(regexp_extract_all({_FOLDED}, '{_q}'), '|') AS matches FROM documents",
    )


def _span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each e-mail's offsets cut the same text out of its document."""
    spans = F.explode(match_spans(F.col("text"), F.lit(f"(?Ud){SHARED[0][1]}"))).alias("x")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", spans)
    return rows.select("doc_id", F.col("x.m").alias("email"), (F.substring("text", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")) == F.col("x.m")).alias("exact"))


_add("span_offsets", _span_offsets, rf"SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '{SHARED[0][1]}')) AS email, true AS exact FROM documents")


def _catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog.of().frame(spark).groupBy("country").agg(F.count(F.lit(1)).alias("rules"), F.sum(F.col("validator").isNotNull().cast("long")).alias("validated"), F.sum(F.col("required").cast("long")).alias("context"))


def _countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in available_countries()], "country string")


#: (country, rules, with a validator, that need a context word), counted from the survey's tables of rules.
_COUNTED = (
    "AT 8 2 2, BE 12 3 5, BG 8 2 1, CH 10 3 2, CY 10 2 1, CZ 8 3 1, DE 15 4 7, DK 9 4 3, EE 8 3 1, EL 10 4 1, ES 10 3 1, FI 8 3 2, FR 12 3 6, HR 9 4 1, HU 10 4 2, IE 9 3 1, IS 7 2 3, "
    "IT 10 3 1, LT 9 3 0, LU 11 2 2, LV 9 2 1, MT 8 2 1, NL 15 5 2, NO 9 4 1, PL 9 4 0, PT 9 3 0, RO 7 2 1, SE 12 4 4, SHARED 39 7 5, SI 9 3 1, SK 7 3 1, UK 12 3 1"
)
_SPLIT = f"SELECT string_split(x, ' ') AS c FROM (SELECT unnest(string_split('{_COUNTED}', ', ')) AS x)"
_add("catalog_by_country", _catalog_rows, f"SELECT c[1] AS country, c[2]::BIGINT AS rules, c[3]::BIGINT AS validated, c[4]::BIGINT AS context FROM ({_SPLIT})")
_add("available_countries", _countries, f"SELECT c[1] AS country FROM ({_SPLIT}) WHERE c[1] <> 'SHARED'")

# -- context rules -----------------------------------------------------------------------------------------------------------------

#: rule: (type, sentences around the number {} and whether the rule discards it)
CONTEXTS: dict[str, tuple[str, list[tuple[str, bool]]]] = {
    "currency": ("PHONE", [("pay {} EUR now", True), ("EUR {} due", True), ("it is {},50 kr here", True), ("Total: {} in all", True), ("call {} today", False), ("eur {} small", False)]),
    "units": ("PHONE", [("about {} kg of it", True), ("for {} dagen", True), ("call {} kgs", False), ("ring {} please", False)]),
    "reference": ("PHONE", [("invoice number: {} sent", True), ("homepage: {} up", True), ("dossier {} open", True), ("number {} open", False)]),
    "legal": ("NATIONAL_ID", [("Article {} says", True), ("see § {} there", True), ("articles {} say", False)]),
    "arithmetic": ("PHONE", [("x = {} so", True), ("with {} + 1", True), ("- {} is a bullet", True), ("with {} , one", False)]),
    "phone_after_id_label": ("PHONE", [("BSN: {} there", True), ("Herr {} called", True), ("Mr {} called", False)]),
    "id_as_passport": ("NATIONAL_ID", [("passport number: {} ok", True), ("Reisepass {} ok", True), ("pass {} ok", False)]),
    "postal_inside_iban": ("POSTAL_CODE", [("NL91 {} 0417", True), ("x{}y", True), ("code {} here", False)]),
    "plate_in_compound": ("LICENSE_PLATE", [("Steuer-{} is", True), ("plate {} is", False)]),
}


def _match_row(sentence: Column, number: Column, kind: str) -> Column:
    at = F.instr(sentence, number) - 1
    end = at + F.length(number)
    return F.struct(
        F.lit(kind).alias("type"), F.lit("NL").alias("country"), number.alias("m"), at.alias("s"), end.alias("e"), F.substring(sentence, F.lit(1), at).alias("before"),
        F.substring(sentence, end + 1, F.lit(150)).alias("after"), F.lit(None).cast("array<string>").alias("needs"),
    )


def _context_query(name: str) -> Query:
    kind, cases = CONTEXTS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        number = F.concat(F.lit("27"), F.right(F.concat(F.lit("0000000"), F.col("o_orderkey").cast("string")), F.lit(7)))
        sentence = None
        for i, (text, _) in enumerate(cases):
            head, tail = text.split("{}")
            built = F.concat(F.lit(head), number, F.lit(tail))
            sentence = F.when(F.col("o_orderkey") % len(cases) == i, built) if sentence is None else sentence.when(F.col("o_orderkey") % len(cases) == i, built)
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", sentence.alias("sentence"), number.alias("number")).withColumn("x", _match_row(F.col("sentence"), F.col("number"), kind))
        return rows.select("o_orderkey", "sentence", getattr(suppressors, name)(F.col("x")).alias("suppressed"))

    return query


for _name, (_kind, _cases) in CONTEXTS.items():
    _number = "'27' || right('0000000' || o_orderkey::VARCHAR, 7)"
    _when = " ".join(f"WHEN {i} THEN '{t.split('{}')[0]}' || {_number} || '{t.split('{}')[1]}'" for i, (t, _) in enumerate(_cases))
    _true = ", ".join(str(i) for i, (_, b) in enumerate(_cases) if b)
    _add(f"context_{_name}", _context_query(_name), f"SELECT o_orderkey, CASE o_orderkey % {len(_cases)} {_when} END AS sentence, o_orderkey % {len(_cases)} IN ({_true}) AS suppressed FROM orders")


# -- resolution, replacement, labels ----------------------------------------------------------------------------------------------------

def _resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy resolution of spans built from line items; oracle in the tests."""
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(
            F.lit("X").alias("type"), (F.col("l_partkey") % 40).cast("int").alias("s"), (F.col("l_partkey") % 40 + 1 + F.col("l_suppkey") % 9).cast("int").alias("e"), F.lit("").alias("m"),
            F.lit("").alias("country"), (1 + F.col("l_linenumber") % 3).cast("int").alias("priority"), F.col("l_linenumber").cast("int").alias("rank"),
        ).alias("x"),
    )
    kept = rows.groupBy("l_orderkey").agg(F.collect_list("x").alias("xs")).select("l_orderkey", F.explode(resolved(F.col("xs"))).alias("x"))
    return kept.select("l_orderkey", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.priority").alias("priority"))


_add("resolve_overlaps", _resolved_spans, """
WITH RECURSIVE x AS (
  SELECT l_orderkey, (l_partkey % 40)::INTEGER AS s, (l_partkey % 40 + 1 + l_suppkey % 9)::INTEGER AS e, (1 + l_linenumber % 3)::INTEGER AS p,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY 1 + l_linenumber % 3 DESC, 1 + l_suppkey % 9 DESC, l_linenumber, l_partkey % 40) AS n FROM lineitem
), r AS (
  SELECT l_orderkey, n, [{'s': s, 'e': e, 'p': p}] AS kept FROM x WHERE n = 1
  UNION ALL SELECT x.l_orderkey, x.n, CASE WHEN len(list_filter(r.kept, lambda y: x.s < y.e AND y.s < x.e)) > 0 THEN r.kept ELSE list_append(r.kept, {'s': x.s, 'e': x.e, 'p': x.p}) END
  FROM r JOIN x ON x.l_orderkey = r.l_orderkey AND x.n = r.n + 1
), last AS (SELECT l_orderkey, unnest(max_by(kept, n)) AS k FROM r GROUP BY l_orderkey)
SELECT l_orderkey, k.s AS s, k.e AS e, k.p AS priority FROM last
""")


def _shared_redactor() -> Redactor:
    return Redactor(Catalog(countries=()))


def _redacted(table: str, key: list[str], text: str, redactor: Callable[[], Redactor] = _shared_redactor) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = redactor().redact(_spread(_table(spark, sf_dir, table).select(*key, text)), text)
        return found.select(*key, F.size("detections").cast("long").alias("n_detections"), "redacted_text")

    return query


_add("redact_documents_shared", _redacted("documents", ["doc_id"], "text"))
_add("redact_documents_nl", _redacted("documents", ["doc_id"], "text", lambda: Redactor.of(["NL"])))
_add("redact_conversations_shared", _redacted("conversations", ["conv_id", "turn"], "text"))
_add("redact_pages_shared", _redacted("pages", ["page_id"], "html"))
_add("redact_documents_four_countries", flagship)
_add("redact_documents_all", redact_all)


def _simple_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_seq, text, detections) with e-mails and IPv4 addresses only."""
    text = F.col("text")
    of = lambda place: F.transform(match_spans(text, F.lit(f"(?Ud){SHARED[place][1]}")), lambda x: F.struct(F.lit(SHARED[place][0]).alias("entity_type"), x["s"].alias("start"), x["e"].alias("end"), x["m"].alias("text")))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_seq"), "text", F.concat(of(0), of(4)).alias("detections"))


_LABELS = rf"""
WITH d AS (
  SELECT doc_id, 'EMAIL' AS type, unnest(regexp_extract_all(f, '{SHARED[0][1]}')) AS text, f FROM (SELECT doc_id, {_FOLDED} AS f FROM documents)
  UNION ALL SELECT doc_id, 'IP_ADDRESS', unnest(regexp_extract_all(f, '{SHARED[4][1]}')), f FROM (SELECT doc_id, {_FOLDED} AS f FROM documents)
), p AS (SELECT *, strpos(f, text) AS pos FROM d
), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, pos DESC) AS k FROM p
)
SELECT text, type || '_' || row_number() OVER (PARTITION BY type ORDER BY doc_id, pos DESC) AS label FROM r WHERE k = 1
"""
_add("labels", lambda spark, sf_dir: label_table(_simple_detections(spark, sf_dir)), _LABELS)
_add("labelled_text", lambda spark, sf_dir: redact_with_labels(_simple_detections(spark, sf_dir)).where(F.size("detections") > 0).select("doc_seq", F.length("labelled_text").cast("long").alias("chars")), f"""
WITH l AS ({_LABELS.replace('WITH d AS', 'WITH d AS', 1)}), m AS (
  SELECT doc_id, n, unnest(regexp_extract_all(f, '{SHARED[0][1]}')) AS text FROM (SELECT doc_id, length(text) AS n, {_FOLDED} AS f FROM documents)
  UNION ALL SELECT doc_id, n, unnest(regexp_extract_all(f, '{SHARED[4][1]}')) FROM (SELECT doc_id, length(text) AS n, {_FOLDED} AS f FROM documents))
SELECT doc_id AS doc_seq, (any_value(n) + sum(length(label) - length(text)))::BIGINT AS chars FROM m JOIN l USING (text) GROUP BY doc_id
""")


# -- structural dates ---------------------------------------------------------------------------------------------------------------------

def _built_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.operators.structural import json_dates

    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    key = F.when(F.col("o_orderkey") % 2 == 0, "birth_date").otherwise("order_date")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('{"id": "'), F.col("o_orderkey").cast("string"), F.lit('", "'), key, F.lit('": "'), day, F.lit('"}')).alias("text"))
    return rows.select("o_orderkey", json_dates(F.col("text")).alias("d")).select("o_orderkey", F.size("d").cast("long").alias("n_dates"), F.get("d", F.lit(0))["m"].alias("first_date"), F.get("d", F.lit(0))["s"].alias("start"))


_add("json_dates", _built_json, "SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_dates, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS first_date, CASE WHEN o_orderkey % 2 = 0 THEN (8 + length(o_orderkey::VARCHAR) + 4 + 10 + 4)::INTEGER END AS start FROM orders")


def _built_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.operators.structural import delimited_dates

    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("name;dob;city\n"), F.col("o_orderkey").cast("string"), F.lit(";"), day, F.lit(";x\nBB;"), day, F.lit(";y")).alias("text"))
    return rows.select("o_orderkey", F.transform(delimited_dates(F.col("text")), lambda x: x["s"]).alias("d")).select("o_orderkey", F.array_join("d", ",").alias("starts"))


_add("delimited_dates", _built_csv, "SELECT o_orderkey, (15 + length(o_orderkey::VARCHAR))::VARCHAR || ',' || (31 + length(o_orderkey::VARCHAR))::VARCHAR AS starts FROM orders")

# -- duplicates, rates, evaluation -----------------------------------------------------------------------------------------------------------

def _distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.sha2(F.col("text"), 256).alias("key"), "doc_id")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


_add("distinct_texts", _distinct_texts, "SELECT sha256(text) AS key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")


def _rates(column: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hit = (F.size("detections") > 0).cast("long")
        docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_seq"), column)
        found = _simple_detections(spark, sf_dir).select("doc_seq", hit.alias("hit")).join(docs, "doc_seq")
        return found.groupBy(column).agg(F.count(F.lit(1)).alias("documents"), F.sum("hit").alias("with_pii"), evaluate.ratio(F.sum("hit"), F.count(F.lit(1))).alias("rate"))

    return query


for _column in ("lang", "source"):
    _hit = f"(len(regexp_extract_all({_FOLDED}, '{SHARED[0][1]}')) + len(regexp_extract_all({_FOLDED}, '{SHARED[4][1]}')) > 0)::BIGINT"
    _add(f"pii_rate_by_{_column}", _rates(_column), f"SELECT {_column}, count(*) AS documents, sum({_hit})::BIGINT AS with_pii, sum({_hit})::DOUBLE / count(*) AS rate FROM documents GROUP BY {_column}")


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built truth: a third of the orders' segments are hits."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("country"), (F.col("c_custkey") % 3 == 0).alias("hit"))
    return evaluate.recall_table(rows)


_add("recall_grouping_sets", _recall, "SELECT category, country, count(*) AS total, sum(hit::BIGINT)::BIGINT AS hits, sum(hit::BIGINT)::DOUBLE / count(*) AS recall FROM (SELECT c_mktsegment AS category, 'C' || c_nationkey AS country, c_custkey % 3 = 0 AS hit FROM customer) GROUP BY GROUPING SETS ((category), (country), (category, country), ())")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.concat(F.lit("C"), (F.col("c_nationkey") % 3).cast("string")).alias("country"), (F.col("c_custkey") % 3 == 0).alias("hit"))
    return evaluate.recall_matrix(rows, ["C0", "C1", "C2"])


_add("recall_matrix", _matrix, "SELECT category, " + ", ".join(f"coalesce(sum(hit) FILTER (WHERE country = 'C{i}'), 0)::DOUBLE / count(*) FILTER (WHERE country = 'C{i}') AS C{i}" for i in range(3)) + " FROM (SELECT c_mktsegment AS category, 'C' || (c_nationkey % 3) AS country, (c_custkey % 3 = 0)::BIGINT AS hit FROM customer) GROUP BY category")


def _precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections judged against true spans, both from line items."""
    items = _table(spark, sf_dir, "lineitem")
    spans = items.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 40).alias("s"), (F.col("l_partkey") % 40 + 5).alias("e"), F.when(F.col("l_suppkey") % 2 == 0, "EMAIL").otherwise("PHONE").alias("entity_type")).distinct()
    truth = items.where("l_linenumber = 4").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 40).alias("ts"), (F.col("l_partkey") % 40 + 5).alias("te"), F.when(F.col("l_suppkey") % 2 == 0, "mail").otherwise("tel").alias("category"))
    bridge = spark.createDataFrame([("mail", "EMAIL"), ("tel", "PHONE")], "category string, entity_type string")
    judged = evaluate.judged_detections(truth, spans, bridge)
    return judged.groupBy("entity_type").agg(F.sum(F.col("tp").cast("long")).alias("tp"), F.sum((~F.col("tp")).cast("long")).alias("fp"))


_add(
    "precision_by_type", _precision,
    """WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 40 AS s, l_partkey % 40 + 5 AS e, CASE WHEN l_suppkey % 2 = 0 THEN 'EMAIL' ELSE 'PHONE' END AS entity_type FROM lineitem WHERE l_linenumber <= 3),
    t AS (SELECT l_orderkey AS doc_id, l_partkey % 40 AS ts, l_partkey % 40 + 5 AS te, CASE WHEN l_suppkey % 2 = 0 THEN 'EMAIL' ELSE 'PHONE' END AS entity_type FROM lineitem WHERE l_linenumber = 4),
    j AS (SELECT d.*, EXISTS (SELECT 1 FROM t WHERE t.doc_id = d.doc_id AND t.entity_type = d.entity_type AND d.s < t.te AND d.e > t.ts) AS tp FROM d)
    SELECT entity_type, sum(tp::BIGINT)::BIGINT AS tp, sum((NOT tp)::BIGINT)::BIGINT AS fp FROM j GROUP BY entity_type""",
)


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three examples for each key (a report's limit)."""
    from pyspark.sql import Window as W

    rows = _table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_orderpriority").orderBy("o_orderkey")))
    return rows.where("n <= 3").select("o_orderpriority", "o_orderkey", F.col("n").cast("long").alias("n"))


_add("examples_per_key", _examples, "SELECT o_orderpriority, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")

from veilspark.plans import built_queries  # noqa: E402

QUERIES |= built_queries.QUERIES
ORACLES |= built_queries.ORACLES
