"""Inputs other than a table that Spark reads already: literal texts, text files, labelled JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "source_text string, PII array<struct<PII_identifier:string,PII_category:string,PII_country:string>>"


def from_texts(spark: SparkSession, texts: Sequence[str | None]) -> DataFrame:
    """(doc_seq, text); doc_seq is the position."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_seq long, text string")


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("text"))


def labelled_records(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.schema(LABELLED).json(glob, multiLine=True)


def false_positives_to_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
