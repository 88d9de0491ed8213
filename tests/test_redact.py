"""End-to-end cases: countries, context, zones, ties, Unicode, structure, labels, options."""

import asyncio

import pytest
from pyspark.sql import functions as F

from veilspark import api
from veilspark.operators.labels import redact_with_labels
from veilspark.operators.redact import Redactor, features, matching, resolved, scan
from veilspark.plans import built_queries
from veilspark.sources.catalog import Catalog, UnknownCountry, available_countries
from veilspark.sources.records import from_texts

CASES = [
    # text, countries, types that are found, types that are not
    ("Mijn BSN is 111222333.", ["NL"], {"NATIONAL_ID"}, set()),
    ("Reference number: 123456789.", ["NL"], set(), {"NATIONAL_ID"}),
    ("BSN: 111.222.333", ["NL"], {"NATIONAL_ID"}, set()),
    ("IBAN: NL91 ABNA 0417 1643 00", ["NL"], {"IBAN"}, set()),
    ("IBAN: NL00ABNA0417164300", ["NL"], set(), {"IBAN"}),
    ("Zijn rijksregisternummer is 85.04.12-123.69.", ["NL", "BE"], {"NATIONAL_ID"}, set()),
    ("BTW: BE 0123.456.749", ["BE"], {"VAT"}, set()),
    ("Bel ons op 02/123.45.67.", ["BE"], {"PHONE"}, set()),
    ("Plaat 1ABC234.", ["BE"], {"LICENSE_PLATE"}, set()),
    ("De vergadering is op 12/04/1985.", ["BE"], set(), {"DOB"}),
    ("Geboren op 12/04/1985 te Antwerpen.", ["BE"], {"DOB"}, set()),
    ("Kaart: 4532 0151 1283 0366", ["BE"], {"CREDIT_CARD"}, set()),
    ("Het kost 0612345678 EUR.", ["NL"], set(), {"PHONE"}),
    ("Factuurnummer: 111222333.", ["NL"], set(), {"NATIONAL_ID"}),
    ("Nothing to see here.", ["NL"], set(), {"EMAIL"}),
    ("", ["NL"], set(), {"EMAIL"}),
    ("mail me@example.org or @handle_1", ["NL"], {"EMAIL", "SOCIAL_HANDLE"}, set()),
    ('{"geboortedatum": "01/02/1990"}', ["NL"], {"DOB"}, set()),
    ("name,born\nA,01/02/1990", ["NL"], set(), {"DOB"}),  # two columns are never recognised
    ("name|born|x\nA|01/02/1990|z", ["NL"], {"DOB"}, set()),
]


@pytest.mark.parametrize("dates", [True])
def test_cases(spark, dates):
    by_countries = {}
    for i, case in enumerate(CASES):
        by_countries.setdefault(tuple(case[1]), []).append((i, case[0]))
    for countries, rows in by_countries.items():
        found = Redactor.of(countries, detect_dates=dates).redact(spark.createDataFrame(rows, "i int, text string")).collect()
        for r in found:
            text, _, present, absent = CASES[r["i"]]
            types = {d["entity_type"] for d in r["detections"]}
            assert present <= types and not absent & types, (text, types)
            for d in r["detections"]:
                assert text[d["start"] : d["end"]] == d["text"]
                assert d["text"] not in r["redacted_text"]
            if not types:
                assert r["redacted_text"] == text


def test_dates_are_opt_in_but_displace(spark):
    rows = from_texts(spark, ["Geboren op 12/04/1985 te Antwerpen.", None])
    got = Redactor.of(["BE"]).redact(rows).orderBy("doc_seq").collect()
    assert got[0]["detections"] == [] and got[0]["redacted_text"].startswith("Geboren op 12/04/1985")
    assert got[1]["detections"] == [] and got[1]["redacted_text"] == ""


def test_failed_checksum_zone_suppresses_inner_match(spark):
    """A failed IBAN hides plate- and phone-shaped pieces inside it."""
    got = Redactor.of(["NL"]).redact(from_texts(spark, ["IBAN: NL00 ABNA 0612 3456 78"])).first()
    assert got["detections"] == []


def test_unicode_offsets(spark):
    text = "été \U0001f642 mail a@b.com now"
    got = Redactor.of(["NL"]).redact(from_texts(spark, [text])).first()
    (d,) = got["detections"]
    assert text[d["start"] : d["end"]] == "a@b.com" and got["redacted_text"] == text.replace("a@b.com", "[EMAIL]")


def test_custom_rules_and_catalog(spark):
    redactor = Redactor.of(["NL"]).with_custom("TICKET", r"\bT-\d{4}\b")
    got = redactor.redact(from_texts(spark, ["see T-1234 and T-99"])).first()
    assert got["redacted_text"] == "see [TICKET] and T-99" and got["detections"][0]["country"] is None
    with pytest.raises(UnknownCountry):
        Catalog.of(["ZZ"])
    assert len(available_countries()) == 31 and len(Catalog.of().rows()) == 338
    assert Catalog.of(["NL", "be"]).rows()[0]["country"] == "NL" and Catalog.of(["NL"]).rows()[-1]["country"] == "SHARED"


def test_greedy_resolution_against_loop(spark):
    import random

    rnd = random.Random(5)
    groups = []
    for g in range(60):
        rows = [("X", s := rnd.randrange(30), s + rnd.randrange(1, 9), "", "", rnd.randrange(1, 4), k) for k in range(rnd.randrange(1, 9))]
        groups.append((g, rows))
    kind = "g int, xs array<struct<type:string,s:int,e:int,m:string,country:string,priority:int,rank:int>>"
    got = {r["g"]: sorted((x["s"], x["e"], x["rank"]) for x in r["k"]) for r in spark.createDataFrame(groups, kind).select("g", resolved(F.col("xs")).alias("k")).collect()}
    for g, rows in groups:
        kept = []
        for x in sorted(rows, key=lambda x: (-x[5], x[1] - x[2], x[6])):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        assert got[g] == sorted((x[1], x[2], x[6]) for x in kept)


def test_labels(spark):
    texts = ["a@x.org then b@x.org", "b@x.org and c@x.org, c@x.org"]
    found = Redactor.of(["NL"]).redact(from_texts(spark, texts))
    got = [r["labelled_text"] for r in redact_with_labels(found).orderBy("doc_seq").collect()]
    # right to left within a document: b comes first
    assert got == ["EMAIL_2 then EMAIL_1", "EMAIL_1 and EMAIL_3, EMAIL_3"]


def test_single_batch_iter_async_and_distinct(spark):
    redactor = Redactor.of(["NL"])
    texts = ["a@x.org", "none", "a@x.org"]
    want = ["[EMAIL]", "none", "[EMAIL]"]
    assert [r["redacted_text"] for r in api.redact_batch(spark, texts, redactor)] == want
    assert api.redact_batch(spark, [], redactor) == []
    assert api.redact(spark, texts[0], redactor)["redacted_text"] == want[0]
    assert [r["redacted_text"] for r in api.redact_iter(spark, texts, redactor)] == want
    assert [r["redacted_text"] for r in asyncio.run(api.aredact_batch(spark, texts, redactor))] == want
    assert [r["redacted_text"] for r in redactor.redact_distinct(from_texts(spark, texts)).orderBy("doc_seq").collect()] == want
    assert [r["redacted_text"] for r in api.redact_batch(spark, texts, redactor, referential_integrity=True)] == ["EMAIL_1", "none", "EMAIL_1"]


def test_a_filter_does_not_scan_twice(spark):
    """Predicates on results stay above the one Project that makes them."""
    rows = Redactor.of(["NL"]).redact(from_texts(spark, ["x é"])).select("doc_seq", F.size("detections").alias("n"), "redacted_text")
    plain, filtered = (df._jdf.queryExecution().optimizedPlan().toString() for df in (rows, rows.where("n > 0")))
    for part in ("regexp_extract_all(_vs_t", "ArrowEvalPython", "rand(0)"):
        assert filtered.count(part) == plain.count(part) > 0, part
    assert "Filter" not in plain.split("rand(0)")[0] and "Filter" in filtered.split("rand(0)")[0]


def test_input_columns_are_never_replaced(spark):
    rows = spark.createDataFrame([(1, "a@x.org", "web", "mine")], "doc_id long, text string, source string, detections string")
    with pytest.raises(ValueError, match="source"):
        Redactor.of(["NL"]).redact(rows)
    got = Redactor.of(["NL"]).redact(rows, prefix="pii_").first()
    assert (got["source"], got["detections"], got["pii_redacted_text"], got["pii_source"]) == ("web", "mine", "[EMAIL]", "rules")


def test_extensions(spark):
    """A country, a validator and a context rule of one's own."""
    own = {"XX": [("BADGE", r"\bB\d{4}\b", "even", None), ("DESK", r"\bD\d{3}\b", None, ["desk"])]}
    redactor = Redactor.of(["XX"], more=own).with_validator("even", lambda m: F.right(m, F.lit(1)).cast("int") % 2 == 0).with_context_rule("BADGE", lambda x: x["before"].endswith("no "))
    texts = ["B1234 B1235 no B1236", "desk D123", "D123"]
    assert [r["redacted_text"] for r in api.redact_batch(spark, texts, redactor)] == ["[BADGE] B1235 no B1236", "desk [DESK]", "D123"]


def test_iterator_is_lazy(spark):
    taken = []

    def texts():
        for t in ("a@x.org", "b", "c"):
            taken.append(t)
            yield t

    results = api.redact_iter(spark, texts(), Redactor.of(["NL"]))
    assert next(results)["redacted_text"] == "[EMAIL]" and taken == ["a@x.org"]


def test_long_dense_text_and_contexts(spark):
    """Offsets and contexts across blocks of 150 code points, in ASCII and beyond."""
    for filler in ("word ", "wörd \U0001f642 "):
        text = "".join(f"{filler}u{i}@x.org IP 10.0.{i % 250}.7 " for i in range(300))
        got = Redactor(Catalog(countries=())).redact(from_texts(spark, [text])).first()
        assert len(got["detections"]) == 600 and all(text[d["start"] : d["end"]] == d["text"] for d in got["detections"])
        assert got["redacted_text"] == "".join(f"{filler}[EMAIL] IP [IP_ADDRESS] " for _ in range(300))


def test_distinct_stream(spark, tmp_path):
    from veilspark.streaming.stream import distinct_stream

    rows = from_texts(spark, ["a", "b", "a", None, ""])
    rows.write.parquet(str(tmp_path / "in"))
    out = distinct_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["text"] or "") for r in spark.table("once").collect()) == ["", "a", "b"]


def test_plan_is_row_local(spark):
    plan = Redactor(Catalog(countries=("NL",)), normalize=False).redact(from_texts(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_stream_equals_batch(spark, tmp_path):
    from veilspark.streaming.stream import label_batches, redact_stream

    rows = from_texts(spark, ["mail a@x.org", "nothing", "mail b@x.org and a@x.org"])
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    redactor = Redactor(Catalog(countries=("NL",)), normalize=False)
    out = redact_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), redactor)
    query = out.writeStream.format("memory").queryName("redacted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress is None or not query.lastProgress["stateOperators"]
    got = {(r["doc_seq"], r["redacted_text"]) for r in spark.table("redacted").collect()}
    assert got == {(r["doc_seq"], r["redacted_text"]) for r in redactor.redact(rows).collect()}
    update = label_batches(str(tmp_path / "labels"))
    for k in (0, 1, 1):
        update(redactor.redact(rows), k)
    table = {(r["text"], r["n"]) for r in spark.read.parquet(str(tmp_path / "labels")).collect()}
    assert table == {("a@x.org", 1), ("b@x.org", 2)}


def test_recall_and_precision(spark):
    from veilspark.operators import evaluate

    texts = ["mail a@x.org now", "call nobody", "mail b@x.org and c@x.org"]
    found = Redactor.of(["NL"]).redact(from_texts(spark, texts)).withColumnRenamed("doc_seq", "doc_id")
    truth = spark.createDataFrame([(0, "a@x.org", "mail", "NL"), (1, "nobody", "name", "NL"), (2, "b@x.org", "mail", "BE")], "doc_id long, identifier string, category string, country string")
    bridge = spark.createDataFrame([("mail", "EMAIL")], "category string, entity_type string")
    hits = {(r["doc_id"], r["hit"]) for r in evaluate.hits(truth, found, bridge).collect()}
    assert hits == {(0, True), (1, False), (2, True)}
    table = {(r["category"], r["country"]): (r["total"], r["hits"]) for r in evaluate.recall_table(evaluate.hits(truth, found, bridge)).collect()}
    assert table[("mail", None)] == (2, 2) and table[(None, "NL")] == (2, 1) and table[(None, None)] == (3, 2)
    one = spark.createDataFrame([(0.5, 0.25, ["NL", "BE", "NL"])], "p double, r double, c array<string>")
    got = one.select(evaluate.f1(F.col("p"), F.col("r")), evaluate.combination(F.col("c"))).first()
    assert got[0] == pytest.approx(1 / 3) and got[1] == "BE + NL"


def _orders_in_one_group(spark, folder):
    spark.range(420).toDF("o_orderkey").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def _equals_sql(spark, name, folder):
    import duckdb

    df = built_queries.QUERIES[name](spark, folder)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one row group, yet every core has texts to scan
    sql = built_queries.ORACLES[name].replace("FROM orders", f"FROM '{folder}/orders.parquet/*.parquet'")
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(duckdb.execute(f"SELECT {columns} FROM ({sql})").fetchall())


def test_account_numbers_are_dealt_out_and_keep_regexes(spark, tmp_path):
    _equals_sql(spark, "redact_ibans_all", _orders_in_one_group(spark, tmp_path))
    has = F.struct(F.lit(True).alias("ascii"), *(F.lit(0).alias(k) for k in ("digits", "run", "head")), F.lit(9).alias("capitals"))
    one = spark.sql("SELECT 'AB DEUTDEFF' AS text").select(matching(F.col("text"), Catalog(countries=("NL",)), has).alias("which")).first()[0]
    rows = Catalog(countries=("NL",)).rows()
    assert {rows[int(n)]["type"] for n in one.split(",") if n} == {"BIC"}


def test_phones_are_dealt_out(spark, tmp_path):
    _equals_sql(spark, "redact_phones_all", _orders_in_one_group(spark, tmp_path))


def test_rules_without_their_keywords_are_left_out(spark):
    catalog, text = Catalog(), F.col("text")
    needy = [r for r in catalog.rows() if r["needs"]]
    assert needy and all(r["words"] is None or all(any(w in k for k in r["needs"]) for w in r["words"]) for r in needy)
    df = from_texts(spark, ["bel +43 664 1234567 nu", "code postal: 6641 and 664", "x geb 12/04/1985 y"])
    has = df.withColumn("has", features(text)).withColumn("which", matching(text, catalog, F.col("has")))
    rows = has.select("text", F.transform(scan(text, catalog, F.col("has"), F.col("which")), lambda x: x["type"]).alias("types")).collect()
    types = {r["text"]: set(r["types"]) for r in rows}
    assert "POSTAL_CODE" not in types["bel +43 664 1234567 nu"] and "POSTAL_CODE" in types["code postal: 6641 and 664"]
    split = Redactor(catalog, detect_dates=True).redact(df.where(text.startswith("x geb"))).first()
    assert [d["entity_type"] for d in split["detections"]] == ["DOB"]  # the keyword is "geb", a space and nothing else


def test_long_texts_by_bounds(spark):
    text = "x " * 600 + "BSN 111222333 and NL91ABNA0417164300"
    assert {d["entity_type"] for d in Redactor.of(["NL"]).redact(from_texts(spark, [text])).first()["detections"]} == {"NATIONAL_ID", "IBAN"}
