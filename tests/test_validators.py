"""Valid and invalid numbers, and context rules, one by one."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import suppressors
from veilspark.functions.validators import VALIDATORS, validate

VECTORS = {
    "iban": (["NL91ABNA0417164300", "BE68539007547034", "DE89370400440532013000", "FR7630006000011234567890189", "NL91 ABNA 0417 1643 00"], ["NL00ABNA0417164300", "NL91ABNA041716430", "NL91"]),
    "bsn": (["111222333", "111.222.333"], ["123456789", "000000000", "12345678"]),
    "belgian_nn": (["85041212369", "85.04.12-123.69"], ["85041212399"]),
    "luhn": (["4532015112830366", "5425233430109903"], ["4532015112830367", "1234"]),
    "belgian_vat": (["BE0123456749", "BE 0123.456.749"], ["BE0123456700"]),
    "vat_nl": (["NL123456789B01"], ["NL12345678901"]),
    "vat_de": (["DE123456789"], ["DE12345678"]),
    "vat_fr": (["FR12345678901", "FRAB345678901"], ["FROI345678901"]),
    "german_tax_id": (["65929970489"], ["01234567890", "65929970488"]),
    "french_nir": (["1850475123456" + f"{97 - 1850475123456 % 97:02d}"], ["185047512345600"]),
    "vin": (["1" * 17], ["I" + "1" * 16, "1" * 15]),
    "bic": (["DEUTDEFF", "DEUTDEFFXXX"], ["DEUTDE", "D3UTDEFF"]),
    "kvk": (["12345678", "01234567"], ["1234567"]),
    "italian_cf": (["RSSMRA85T10A562S"], ["RSSMRA85T10A562T", "RSSMRA85T10A56"]),
    "spanish_dni": (["12345678Z"], ["12345678A"]),
    "spanish_nie": (["X1234567L"], ["X1234567A"]),
    "swiss_ahv": (["756.1234.5678.97"], ["756.1234.5678.98"]),
    "croatian_oib": (["12345678903"], ["12345678900"]),
    "finnish_hetu": (["131052-308T"], ["131052-308U"]),
    "finnish_business_id": (["2077474-0"], ["2077474-1", "20-77474-0"]),
    "norwegian_org": (["974760673"], ["974760674"]),
    "polish_pesel": (["44051401359"], ["44051401358"]),
    "polish_nip": (["123-456-32-18"], ["1234563219"]),
    "swedish_pnr": (["811228-9874", "19811228-9874"], ["811328-9874"]),
    "danish_cpr": (["010203-1234"], ["320203-1234"]),
    "czech_birth_number": (["123456789", "7103192745"], ["7103192746"]),
    "high_entropy": (["aB3$xY9!", "9f86d081884c7d659a2feaa0c55ad015"], ["password", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "short1"]),
}


def test_vectors(spark):
    rows = [(name, text, want) for name, (good, bad) in VECTORS.items() for want, texts in ((True, good), (False, bad)) for text in texts]
    got = spark.createDataFrame(rows, "name string, text string, want boolean").withColumn("got", validate(F.col("name"), F.col("text")))
    assert [(r["name"], r["text"]) for r in got.collect() if r["got"] != r["want"]] == []


def test_unknown_names_pass(spark):
    rows = spark.createDataFrame([(None, "x"), ("no_such_rule", "x")], "name string, text string")
    assert {r[0] for r in rows.select(validate(F.col("name"), F.col("text"))).collect()} == {True}
    assert len(VALIDATORS) == 43


CONTEXT = [
    ("sequential", "PHONE", "", "000000", "", True),
    ("currency", "PHONE", "", "271828183", " € here", False),  # no word boundary after the sign
    ("currency", "PHONE", "", "271828183", " EUR", True),
    ("year_as_postal", "POSTAL_CODE", "sinds ", "1999", "", True),
    ("year_as_postal", "POSTAL_CODE", "sinds Gent, ", "1999", "", False),
    ("phone_service_number", "PHONE", "", "0800 1234", "", True),
    ("phone_is_date", "PHONE", "", "01-02-1999", "", True),
    ("swedish_organisation", "NATIONAL_ID", "org.nr: ", "5560360793", "", True),
    ("postal_as_house_number", "POSTAL_CODE", "Austurstræti ", "186", " x", True),
    ("postal_as_house_number", "POSTAL_CODE", "Austurstræti ", "186", ", Reykjavik", False),
    ("plate_in_compound", "LICENSE_PLATE", "in ", "WS 12", "", True),
    ("plate_in_compound", "LICENSE_PLATE", "in ", "IP 10", ".5", True),
    ("plate_in_compound", "LICENSE_PLATE", "in ", "IP 10", " x", False),
    ("id_as_passport", "NATIONAL_ID", "Reisepass Nr. ", "C12345678", "", True),
]


@pytest.mark.parametrize("rule,kind,before,m,after,want", CONTEXT)
def test_context_rules(spark, rule, kind, before, m, after, want):
    row = spark.createDataFrame([(kind, "SE", m, len(before), len(before) + len(m), before, after, None)], "type string, country string, m string, s int, e int, before string, after string, needs array<string>")
    x = F.struct(*row.columns)
    assert row.select(getattr(suppressors, rule)(x).alias("v")).first()["v"] is want
    assert row.select(suppressors.suppressed(x).alias("v")).first()["v"] is want
