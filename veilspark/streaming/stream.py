"""Redaction of streams: the batch plan as it is (append mode, no state), and labels by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilspark.operators.labels import label_table
from veilspark.operators.redact import Redactor


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text files as they arrive."""
    return spark.readStream.text(path).select(F.trim("value").alias("text"))


def redact_stream(stream: DataFrame, redactor: Redactor, text: str = "text") -> DataFrame:
    return redactor.redact(stream, text)


def write_redacted(stream: DataFrame, redactor: Redactor, path: str, checkpoint: str, text: str = "text") -> DataStreamWriter:
    out = redact_stream(stream, redactor, text)
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def distinct_stream(stream: DataFrame, text: str = "text", time: str | None = None, within: str = "1 hour") -> DataFrame:
    """`stream` with each text once, by its hash, before it is redacted.  With an event time the state of a text goes `within` after it; else it stays."""
    keyed = stream.withColumn("_vs_key", F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    once = keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["_vs_key"]) if time else keyed.dropDuplicates(["_vs_key"])
    return once.drop("_vs_key")


def label_batches(table: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that keeps labels of texts, in one folder `batch=n` of the Parquet table at `table` for each batch.

    Numbers go on from the largest of each type; which text comes first depends on arrival, as batches do.  A batch sees the labels of earlier batches only, and its
    folder is overwritten as a whole: a batch that failed half-way, or that comes again after a restart, writes the same labels again. 
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            new = label_table(batch).select("text", F.regexp_extract("label", r"^(.*)_(\d+)$", 1).alias("type"), F.regexp_extract("label", r"_(\d+)$", 1).cast("long").alias("n"))
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                old = spark.read.schema(f"{LABELS}, batch long").option("basePath", table).parquet(table).where(F.col("batch") < number)
            else:
                old = spark.createDataFrame([], f"{LABELS}, batch long")
            last = old.groupBy("type").agg(F.max("n").alias("last"))  # a row for each type
            fresh = new.join(old.select("text"), "text", "left_anti")
            place = F.row_number().over(W.partitionBy("type").orderBy("n"))
            fresh = fresh.withColumn("n", place).join(F.broadcast(last), "type", "left").select("text", "type", (F.col("n") + F.coalesce("last", F.lit(0))).cast("long").alias("n"))
            fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        finally:
            batch.unpersist()

    return update


LABELS = "text string, type string, n long"
