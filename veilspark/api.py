"""Functions for single texts and lists, on top of `Redactor`."""

from __future__ import annotations

import asyncio
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

from pyspark.sql import Row, SparkSession

from veilspark.operators.labels import redact_with_labels
from veilspark.operators.redact import Redactor
from veilspark.sources.catalog import available_countries
from veilspark.sources.records import from_texts

__all__ = ["aredact_batch", "available_countries", "redact", "redact_batch", "redact_iter"]


def redact_batch(spark: SparkSession, texts: Sequence[str | None], redactor: Redactor | None = None, referential_integrity: bool = False) -> list[Row]:
    """Results in input order: redacted_text, detections, source, degraded."""
    rows = (redactor or Redactor()).redact(from_texts(spark, texts))
    if referential_integrity:
        rows = redact_with_labels(rows).drop("redacted_text").withColumnRenamed("labelled_text", "redacted_text")
    return rows.orderBy("doc_seq").select("redacted_text", "detections", "source", "degraded").collect()


def redact(spark: SparkSession, text: str | None, redactor: Redactor | None = None, referential_integrity: bool = False) -> Row:
    return redact_batch(spark, [text], redactor, referential_integrity)[0]


def redact_iter(spark: SparkSession, texts: Iterable[str | None], redactor: Redactor | None = None, batch: int = 1) -> Iterator[Row]:
    """A result for each text in turn.  No more than `batch` texts are taken ahead of the results, so `texts` may be endless; by default a text is
    taken when its result is asked for.  A larger `batch` saves a Spark job for each text."""
    rest = iter(texts)
    while some := list(islice(rest, batch)):
        yield from redact_batch(spark, some, redactor)


async def aredact_batch(spark: SparkSession, texts: Sequence[str | None], redactor: Redactor | None = None, max_concurrency: int = 4) -> list[Row]:
    """As `redact_batch`; the texts are scanned in `max_concurrency` partitions."""

    def run() -> list[Row]:
        rows = (redactor or Redactor()).redact(from_texts(spark, texts).repartition(max_concurrency))
        return rows.orderBy("doc_seq").select("redacted_text", "detections", "source", "degraded").collect()

    return await asyncio.get_running_loop().run_in_executor(None, run)
