"""Referential labels: the same text gets the same TYPE_n in all documents.

Encounter order is document order, then right to left within a document.  A text's first type stays its type; n counts the
texts of a type in order of first encounter.  First encounters are a map-side combined minimum, and numbers are
local ranks in blocks of `BLOCK` consecutive document numbers plus the totals of earlier blocks, so that no window holds a whole type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.operators.redact import replaced

BLOCK = 10_000


def label_table(found: DataFrame) -> DataFrame:
    """(text, label) from (doc_seq, detections)."""
    each = found.select("doc_seq", F.explode("detections").alias("d")).select(F.col("d.text").alias("text"), F.struct("doc_seq", (-F.col("d.start")).alias("back"), F.col("d.entity_type").alias("type")).alias("at"))
    first = each.groupBy("text").agg(F.min("at").alias("at")).select("text", "at.*")
    first = first.withColumn("block", F.floor(F.col("doc_seq") / BLOCK))
    totals = first.groupBy("type", "block").agg(F.count(F.lit(1)).alias("k"))
    earlier = F.sum("k").over(W.partitionBy("type").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select("type", "block", F.coalesce(earlier, F.lit(0)).alias("base"))
    local = F.row_number().over(W.partitionBy("type", "block").orderBy("doc_seq", "back", "text"))
    ranked = first.withColumn("n", local).join(totals, ["type", "block"])
    return ranked.select("text", F.concat_ws("_", "type", (F.col("n") + F.col("base")).cast("string")).alias("label"))


def redact_with_labels(found: DataFrame, text: str = "text") -> DataFrame:
    """`found` (doc_seq, text, detections) with `labelled_text`: each detection replaced by its label, without brackets."""
    labels = label_table(found)
    each = found.select("doc_seq", F.explode("detections").alias("d")).select("doc_seq", F.col("d.text").alias("text"), "d")
    named = each.join(labels, "text").groupBy("doc_seq").agg(F.array_sort(F.collect_list(F.struct(F.col("d.start").alias("start"), F.col("d.end").alias("end"), "label"))).alias("_vs_l"))
    out = found.join(named, "doc_seq", "left")
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    done = replaced(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col("_vs_l"), empty), lambda d: d["label"])
    return out.withColumn("labelled_text", done).drop("_vs_l")
