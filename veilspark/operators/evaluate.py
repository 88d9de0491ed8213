"""Recall and precision of detections against labelled truth, as joins and grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRUTH = "array<struct<PII_identifier:string,PII_category:string,PII_country:string>>"


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def combination(countries: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(countries)), " + ")


def hits(truth: DataFrame, found: DataFrame, bridge: DataFrame) -> DataFrame:
    """Truth rows (doc_id, identifier, category, country) with `hit`: the identifier is gone from the redacted text, or a
    detection of an accepted type overlaps its first occurrence.  `bridge`: (category, entity_type), small."""
    spans = found.select("doc_id", F.explode("detections").alias("d")).select("doc_id", F.col("d.start").alias("s"), F.col("d.end").alias("e"), F.col("d.entity_type").alias("entity_type"))
    texts = truth.join(found.select("doc_id", "text", "redacted_text"), "doc_id")
    texts = texts.withColumn("ts", F.instr("text", F.col("identifier")) - 1).withColumn("te", F.col("ts") + F.length("identifier"))
    near = texts.join(F.broadcast(bridge), "category").join(spans, ["doc_id", "entity_type"]).where((F.col("s") < F.col("te")) & (F.col("e") > F.col("ts")))
    keys = ["doc_id", "identifier", "category", "country"]
    seen = near.select(*keys).distinct().withColumn("near", F.lit(True))
    return texts.join(seen, keys, "left").select(*keys, (~F.contains("redacted_text", F.col("identifier")) | F.coalesce("near", F.lit(False))).alias("hit"))


def judged_detections(truth_spans: DataFrame, spans: DataFrame, bridge: DataFrame) -> DataFrame:
    """Detections (doc_id, s, e, entity_type) with `tp`: they overlap a true span (doc_id, ts, te, category) of a compatible category."""
    accepted = truth_spans.join(F.broadcast(bridge), "category").select("doc_id", "entity_type", "ts", "te")
    good = spans.join(accepted, ["doc_id", "entity_type"]).where((F.col("s") < F.col("te")) & (F.col("e") > F.col("ts")))
    good = good.select("doc_id", "s", "e", "entity_type").distinct().withColumn("tp", F.lit(True))
    return spans.join(good, ["doc_id", "s", "e", "entity_type"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def recall_table(rows: DataFrame) -> DataFrame:
    """Totals, hits and recall by category, country, both, and overall, in one pass."""
    rows.createOrReplaceTempView("_vs_hits")
    return rows.sparkSession.sql(
        """SELECT category, country, count(*) AS total, sum(CAST(hit AS BIGINT)) AS hits, CASE WHEN count(*) = 0 THEN 0D ELSE CAST(sum(CAST(hit AS BIGINT)) AS DOUBLE) / count(*) END AS recall
           FROM _vs_hits GROUP BY GROUPING SETS ((category), (country), (category, country), ())"""
    )


def recall_matrix(rows: DataFrame, countries: list[str]) -> DataFrame:
    return rows.groupBy("category").pivot("country", countries).agg(ratio(F.sum(F.col("hit").cast("long")), F.count(F.lit(1))))


def known_countries(codes: Column, known: Sequence[str]) -> Column:
    """The codes that have rules; all that are known where none has."""
    every = F.array(*map(F.lit, known))
    both = F.array_intersect(codes, every)
    return F.when(F.size(both) > 0, both).otherwise(every)


def without_categories(truth: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return truth.where(~F.col("category").isin(*excluded))


def distinct_types(detections: Column) -> Column:
    return F.array_distinct(F.transform(detections, lambda d: d["entity_type"]))


def _sets(rows: DataFrame, sets: dict[str, list[str]], flag: str, names: tuple[str, str, str]) -> DataFrame:
    """One row for each set and key: how many rows have the flag, in all, and their ratio; one pass, combined before the shuffle."""
    keys = [F.struct(F.lit(name).alias("set"), (F.concat_ws(", ", *columns) if columns else F.lit("all")).alias("key")) for name, columns in sets.items()]
    each = rows.select(F.explode(F.array(*keys)).alias("k"), flag).where("k.key <> ''")
    some, total, share = names
    hit = F.sum(F.col(flag).cast("long"))
    return each.groupBy("k.set", "k.key").agg(F.count(F.lit(1)).alias(total), hit.alias(some), ratio(hit, F.count(F.lit(1))).alias(share))


def recall_sets(rows: DataFrame) -> DataFrame:
    """(set, key, total, hits, recall) of truth rows (doc_id, category, country, hit): by category, country, both, combination of countries (of
    documents with several), single or multiple countries (`spread`), and overall."""
    of = rows.groupBy("doc_id").agg(F.collect_set("country").alias("codes"))
    each = rows.join(of, "doc_id").withColumn("multi", F.size("codes") > 1)
    each = each.withColumn("combination", F.when(F.col("multi"), combination(F.col("codes"))).otherwise("")).withColumn("spread", F.when(F.col("multi"), "multi").otherwise("single"))
    sets = {"category": ["category"], "country": ["country"], "category, country": ["category", "country"], "combination": ["combination"], "spread": ["spread"], "all": []}
    return _sets(each, sets, "hit", ("hits", "total", "recall"))


def _by_country(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """Detections (doc_id, entity_type, tp), once for each country of their document's truth."""
    return judged.join(truth.select("doc_id", "country").distinct(), "doc_id")


def precision_sets(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """(set, key, tp, fp, precision) by type, country, and both."""
    by_type = _sets(judged, {"type": ["entity_type"]}, "tp", ("tp", "total", "precision"))
    rest = _sets(_by_country(judged, truth), {"country": ["country"], "type, country": ["entity_type", "country"]}, "tp", ("tp", "total", "precision"))
    return by_type.unionByName(rest).select("set", "key", "tp", (F.col("total") - F.col("tp")).alias("fp"), "precision")


def false_positive_matrix(judged: DataFrame, truth: DataFrame, countries: list[str]) -> DataFrame:
    """False positives by type (rows) and country (columns)."""
    wrong = _by_country(judged.where(~F.col("tp")), truth)
    return wrong.groupBy("entity_type").pivot("country", countries).agg(F.count(F.lit(1))).fillna(0, countries)


def by_total(rows: DataFrame, key: str) -> DataFrame:
    """(key, total, place): the largest totals first, ties by key.  A report: keys are categories or countries, few."""
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), key)).cast("long")).orderBy("place")


def cleaned(text: Column) -> Column:
    """`text` without the separators of numbers."""
    return F.regexp_replace(text, r"(?U)[\s.\-/]", "")


def text_hits(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, identifier, hit) of truth (doc_id, identifier): a detection's text (doc_id, text) holds it, or lies in it, separators aside."""
    own = truth.select("doc_id", "identifier").distinct()
    near = own.join(found.select("doc_id", "text"), "doc_id")
    a, b = cleaned(F.col("text")), cleaned(F.col("identifier"))
    near = near.where(F.contains(a, b) | F.contains(b, a)).select("doc_id", "identifier").distinct().withColumn("hit", F.lit(True))
    return own.join(near, ["doc_id", "identifier"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
