"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_shipped: set[str] = set()
_lean: list[bool] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application; they need not have the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent.parent
    where = tempfile.mkdtemp(prefix="veilspark-py-")
    atexit.register(shutil.rmtree, where, True)
    sc.addPyFile(shutil.make_archive(f"{where}/{package.name}", "zip", package.parent, package.name))


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.  Where it is unset (tests), a folder of our own that goes at exit."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="veilspark-"))
        atexit.register(shutil.rmtree, _own[0], True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_own[0])
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/veilspark-{what}-{uuid.uuid4().hex[:12]}"
    if not path.partition(":")[1] or path.startswith("file:"):  # a single machine's folder is cleared at exit; stores have their own rules
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), True)
    return path


#: Shuffle files of a write go as soon as it has ended; its rows are in the shared folder then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there and any executor can be lost."""
    spark = df.sparkSession
    path = new_path(spark, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._veilspark_path = path
    return out


def done(*frames: DataFrame) -> None:
    """Delete tables that `kept` made and no later step reads, wherever the shared folder is."""
    for frame in frames:
        if path := frame.__dict__.pop("_veilspark_path", None):
            forget(frame.sparkSession, path)


def lean() -> None:
    """For Python workers, which Spark uses again and again: what a task frees goes back to the system, so that a worker's size is that of
    the task it runs and not of the largest one it ever ran."""
    if _lean:
        return
    _lean.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # a C library without these settings keeps its own
        libc = ctypes.CDLL(None)
        libc.mallopt(-8, 1)  # M_ARENA_MAX
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped each, and unmapped when freed
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits (two columns, never null) of a row's id and text, for tables in which ids repeat or are null."""
    of = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(*of).alias(first), F.xxhash64(F.lit("second"), *of).alias(second)]


def lower_ascii(col):
    """A-Z lower-cased, every other character as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ascii_only = F.length(col) == F.octet_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, upper, lower))


#: A table of so many narrow rows (about 100 bytes each in a hashed relation) may be broadcast.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None, most: int = 32 << 20) -> DataFrame:
    """`df` with a broadcast hint where a count proves that it has `rows` rows at most and, where rows are wide, that the sum of `size`
    is `most` at most; else the planner shuffles both sides."""
    n, total = df.select((F.lit(0) if size is None else size).alias("s")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("s")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= most else df


#: Bits of a bitmap for each key that it marks, and of all.
MARK_BITS, MARKS_MOST = 32, 1 << 28


def among(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """`rows` joined to `keys` (a kept table) on `on`, whose first column is a 64-bit hash, by `how`: inner, left_semi or left_anti.

    For wide rows, most of which have no key: where `keys` are too many to broadcast, a bitmap of their hashes is, and only rows whose bit
    is set are shuffled; about 3 % of the others are among these.
    """
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    bit = F.pmod(F.col(on[0]), F.lit(min(MARKS_MOST, MARK_BITS * n))) + 1
    marks = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_marks"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_marks", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(marks), "_bucket", "left")
    placed = placed.withColumn("_marked", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_marks")
    found = placed.where("_marked").drop("_marked").join(keys, on, how)
    return found.unionByName(placed.where("NOT _marked").drop("_marked")) if how == "left_anti" else found


#: Parts into which the rows of one key are dealt where the other side of a join is too large to broadcast.
SALTS = 32


def meet(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """`left` joined to `right` on `keys`, so that a key which many rows of `left` hold is no single task's work: `right` is broadcast where
    a count proves it small; else its rows are copied to `SALTS` parts, and those of `left` are dealt over the parts by a hash of the columns `by`."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), *by), F.lit(SALTS)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
