"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased; it is held as 128 bits of
xxhash64 under two seeds.  `LineRuns` is a log-structured store: each batch of documents becomes a run, sorted
by hash and bucketed by it, of (hash, number of documents).  Batches are whole files or, of fewer files, shares of the rows by hash.  Before a batch adds its run it is merge-anti-joined with the
runs' keys that have reached the limit already, so that hot lines are stored once per level and not once per batch.
When a level holds `fanout` runs they are merged into one of the next level.  Runs are bucketed, so a join shuffles the new batch only.

Defined results: a null or empty text is one empty line; keys shorter than `min_length` code points are never
dropped; a repeated line counts once in its document; every row is a document, also where doc_ids repeat; an
empty table gives an empty table; further columns of the input are kept, but for those named as results (names with the prefix `_ld_` are taken).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import shared

#: The white space that a key loses at its ends.
STRIPPED = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """For lines of a text that has been lower-cased already."""
    return F.trim(line, F.lit(STRIPPED))


def key_lines(text: Column) -> Column:
    return F.transform(lines_of(shared.lower_ascii(text)), key_of)


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def document_keys(docs: DataFrame, text: str, min_length: int) -> DataFrame:
    """(h1, h2): one row for each document and distinct key."""
    keys = F.array_distinct(F.filter(key_lines(F.col(text)), lambda k: F.length(k) >= min_length))
    return docs.select(F.explode(keys).alias("k")).select(*hashes(F.col("k")))


class LineRuns:
    """Runs of (h1, h2, n), by level.  `n` is exact until it reaches `min_docs`; then the key is saturated."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3, buckets: int | None = None) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.base = shared.new_path(spark, "lineruns")

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"veilspark_run_{uuid.uuid4().hex}"
        run = run.repartition(self.buckets, "h1")  # one file for each bucket, not one for each task and bucket
        run.write.format("parquet").bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", f"{self.base}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: Sequence[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            shared.forget(self.spark, f"{self.base}/{name}")

    def _merged(self, names: Sequence[str]) -> DataFrame:
        """Rows of the same bucket meet without a shuffle for a single run; several are summed.

        A union of bucketed scans counts as bucketed, but where it reads column batches, Spark 4.1 puts its children's buckets one after the
        other instead of together, and a key then has a row for each run.  A filter has the union read rows, which does put them together.
        """
        if len(names) == 1:
            return self.spark.table(names[0])
        rows = self.spark.table(names[0]).where("n > 0")
        for name in names[1:]:
            rows = rows.unionByName(self.spark.table(name).where("n > 0"))
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """`keys`: (h1, h2), one row for each document and key."""
        own = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for name in self.runs():
            full = self.spark.table(name).where(F.col("n") >= self.min_docs).select("h1", "h2")
            own = own.join(full.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(self._merged(old), level + 1)
            self.levels[level] = []
            self._drop(old)
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys found in at least `min_docs` documents."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(self.runs()).where(F.col("n") >= self.min_docs).select("h1", "h2")

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = [[]]
        shared.forget(self.spark, self.base)


def batches_of(docs: DataFrame, n: int, text: str = "text") -> list[DataFrame]:
    """`docs` in `n` batches: whole files of a plain Parquet scan with so many files; else the rows are dealt by a hash of the text.

    What is not a plain scan has its texts written to the shared folder first, so that it is made once and not once for each batch.
    """
    plan = docs._jdf.queryExecution().analyzed()
    plain = not plan.children().size()
    files = sorted(docs.inputFiles()) if plain else []
    if len(files) >= n:
        step = -(-len(files) // n)
        return [docs.sparkSession.read.schema(docs.schema).parquet(*files[i : i + step]) for i in range(0, len(files), step)]
    rows = docs if files else shared.kept(docs.select(text), "texts")
    dealt = F.pmod(F.xxhash64(F.lit("batch"), F.col(text)), F.lit(n))
    return [rows.where(dealt == k) for k in range(n)]


def frequent_lines(batches: Sequence[DataFrame], text: str = "text", min_docs: int = 10, min_length: int = 1, fanout: int = 3) -> DataFrame:
    """(h1, h2) of the keys found in at least `min_docs` documents of all batches."""
    spark = batches[0].sparkSession
    store = LineRuns(spark, min_docs, fanout)
    for batch in batches:
        store.add(document_keys(batch, text, min_length))
    out = shared.kept(store.frequent(), "frequentlines")
    store.close()
    return out


MADE = ("kept_text", "n_lines", "n_dropped")


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", min_length: int = 1, names: Sequence[str] = MADE) -> DataFrame:
    """`docs` with `kept_text`, `n_lines`, `n_dropped` (or `names`, which replace columns of the input): every line whose key is in `frequent` goes.

    Only (row key, key) pairs meet the frequent keys, those of one line dealt over parts where they are too many to broadcast;
    the keys to drop are then gathered by document and joined to the texts.
    """
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("string", "bigint", "int")]  # copies of a text spread over tasks
    row = [F.xxhash64(F.lit("text"), F.col(text)).alias("_ld_t"), F.xxhash64(*plain).alias("_ld_r")]
    keys = F.array_distinct(F.filter(key_lines(F.col(text)), lambda k: F.length(k) >= min_length))
    hits = docs.select(*row, F.explode(keys).alias("_ld_k")).select("_ld_t", "_ld_r", "_ld_k", *hashes(F.col("_ld_k")))
    hits = shared.meet(hits, frequent, ["h1", "h2"], ["_ld_r"], "left_semi").groupBy("_ld_t", "_ld_r").agg(F.collect_set("_ld_k").alias("_ld_bad"))
    joined = docs.select("*", *row).join(hits, ["_ld_t", "_ld_r"], "left")
    lines = joined.withColumn("_ld_lines", lines_of(F.col(text)))
    bad = lambda line: F.array_contains("_ld_bad", key_of(shared.lower_ascii(line)))
    lines = lines.withColumn("_ld_kept", F.when(F.col("_ld_bad").isNull(), F.col("_ld_lines")).otherwise(F.filter("_ld_lines", lambda x: ~bad(x))))
    return lines.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in names],
        F.array_join("_ld_kept", "\n").alias(names[0]),
        F.size("_ld_lines").cast("long").alias(names[1]),
        (F.size("_ld_lines") - F.size("_ld_kept")).cast("long").alias(names[2]),
    )


def line_dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, min_length: int = 1, n_batches: int = 4, names: Sequence[str] = MADE) -> DataFrame:
    """Drop, in every document, the lines whose key is found in at least `min_docs` documents."""
    frequent = frequent_lines(batches_of(docs, n_batches, text), text, min_docs, min_length)
    return drop_lines(docs, frequent, text, min_length, names)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, u.line AS line, u.pos AS pos,
         translate(trim(u.line, e' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), e'\\n') AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE f.k IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, e'\\n' ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""
