"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a row is a record's header, an empty line and its payload; the writer's line separator is the record's closing
CR LF CR LF, so the part files are plain WARC/1.0 files on any file system Spark can write to.  Of the records with equal payloads of at least
`min_revisit_bytes` bytes, that with the largest page_id is a `response`; the others are `revisit` records without a payload.

Reading: a task looks for the magic string (of any version) in a file's bytes and finds, for each occurrence whose header can be parsed, the candidate
(offset, offset of the successor).  Payloads may hold the magic, and even whole records.  Per file, pointer jumping over
the candidates (doubling, log2(n) vectorised rounds) marks those that a chain from offset 0 reaches; all others
are rejected, and the records come with their ids and payloads.  Archives of gzip members are read unpacked, offsets being those of the unpacked bytes.
A file is one task's work, which holds its bytes several times (in Spark and in Python): files that this module writes are bounded by `max_records` and by FILE_BYTES.

Defined results: null html is an empty payload; rows with the same page_id and payload are all responses, or all revisits, of it;
a null page_id is smaller than any other (a revisit refers to null only where all are null); CR and LF in a url become spaces; an archive that is cut off keeps its records before
the cut; a header line that starts with a blank continues the one before it, a line without a colon is ignored, of repeated fields the first counts;
bytes that no chain covers are told by `coverage`; empty tables give no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import shared

MAGIC, BLANK = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n"), re.compile(rb"\r\n\r\n")
GZIP = b"\x1f\x8b"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

CANDIDATE = (
    "file string, offset long, successor long, size long, page_id long, record_type string, refers_to long, url string, "
    "payload_bytes long, payload_digest string, intact boolean, record_id string, refers_to_id string, payload_start long"
)
RECORD = f"{CANDIDATE}, payload binary"
#: Payloads reach Spark in batches of about so many bytes.
BATCH_BYTES = 8_000_000
COVERAGE = "file string, size long, records long, covered long, candidates long"
#: Payload classes: up to SMALL bytes, then up to STEP times as much each; files of a class hold at most FILE_BYTES of payload (or one record).
SMALL, STEP, FILE_BYTES = 1 << 14, 8, 1 << 25
#: No payload is larger: Spark's limit for a value.
LARGEST = 1 << 31


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 20 bits (five hex digits) are four base-32 digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def planned(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    copies = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = shared.if_small(shared.kept(copies.where("_n > 1").drop("_n"), "copies"))
    # equal digests come with equal lengths, so the limit needs no second test
    rows = rows.join(copies, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first")


def record(row: DataFrame) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("record_type") == "revisit"
    header = F.concat(
        F.lit("WARC/1.0"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", page(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", page(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    return F.concat(header, F.lit(END), F.when(again, F.lit("")).otherwise(F.col("payload")))


def classes(pages: DataFrame) -> list[tuple[int, int]]:
    """The payload classes that have rows (the first, where there are none): more than so many bytes, and at most so many."""
    size, high = F.coalesce(F.octet_length("html"), F.lit(0)), [SMALL]
    while high[-1] < LARGEST:
        high.append(high[-1] * STEP)
    bounds = list(zip([-1, *high[:-1]], high, strict=True))
    found = pages.agg(*[F.max((size > low) & (size <= top)) for low, top in bounds]).first()
    return [b for b, some in zip(bounds, found, strict=True) if some] or bounds[:1]


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, max_records: int = 2000) -> None:
    """The archives of `pages` in the folder `path`.  Payloads are written by classes of size, so that files stay bounded in bytes."""
    rows, parts = planned(pages, min_revisit_bytes), classes(pages)
    for low, high in parts:
        own = rows.where(F.col("payload_bytes").between(low + 1, high)) if len(parts) > 1 else rows
        most = min(max_records, max(1, FILE_BYTES // high))
        own.select(record(own).alias("value")).write.mode("append").option("lineSep", END).option("compression", "none").option("maxRecordsPerFile", most).text(path)


def _header(block: bytes) -> dict[bytes, bytes]:
    out: dict[bytes, bytes] = {}
    for row in re.sub(rb"\r\n[ \t]+", b" ", block).split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _page(value: bytes | None) -> int | None:
    text = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(text) if text.lstrip(b"-").isdigit() else None


def candidates_of(file: str, data: memoryview) -> Iterator[tuple]:
    """A row of CANDIDATE for every occurrence of the magic with a header that can be parsed, wherever it is."""
    for magic in MAGIC.finditer(data):
        at, body = magic.span()
        stop = BLANK.search(data, body)
        head = _header(bytes(data[body : stop.start()])) if stop else {}
        if head.get(b"content-length", b"").isdigit() and b"warc-type" in head:
            start, size = stop.end(), int(head[b"content-length"])
            if data[start + size : start + size + 4] == b"\r\n\r\n":
                kind, payload = head[b"warc-type"].decode("utf-8", "replace"), data[start : start + size]
                said = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
                digest = said if kind == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                length = int(n) if kind == "revisit" and (n := head.get(b"x-payload-length", b"0")).isdigit() else size
                url = head.get(b"warc-target-uri", b"").decode("utf-8", "replace")
                own, other = head.get(b"warc-record-id"), head.get(b"warc-refers-to")
                ids = [None if x is None else x.decode("utf-8", "replace") for x in (own, other)]
                yield file, at, start + size + 4, len(data), _page(own), kind, _page(other), url, length, digest, digest == said, *ids, start


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates a chain from offset 0 reaches; `offset` ascends.  Pointers double, so long chains take few rounds."""
    n = len(offset)
    reached = np.zeros(n + 1, dtype=bool)
    if n and offset[0] == 0:
        reached[0] = True
    to = np.searchsorted(offset, successor)
    jump = np.append(np.where((to < n) & (offset[np.minimum(to, max(n - 1, 0))] == successor), to, n) if n else to, n)
    step = 1
    while step <= n:
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        step *= 2
    return reached[:n]


NAMES = [f.split()[0] for f in CANDIDATE.split(", ")]
KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in CANDIDATE.split(", ")]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(KINDS), KINDS, strict=True)]


def unpacked(held: memoryview) -> memoryview:
    """Gzip members, one after another, as the bytes they hold; of a damaged or cut one what comes before the damage.  Other data as it is, not copied."""
    if held[:2] != GZIP:
        return held
    out, data = [], bytes(held)
    while data.startswith(GZIP):
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return memoryview(b"".join(out))


def _archives(spark: SparkSession, path: str, glob: str, make: Callable[[str, memoryview], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from make(file.as_py(), unpacked(memoryview(data.as_buffer()).cast("B")))

    shared.ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(scan, schema)


def _chained(rows: list[tuple]) -> list[tuple]:
    chain = reachable(np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64))
    return [r for r, ok in zip(rows, chain, strict=True) if ok]


def read_candidates(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    def make(file: str, data: memoryview) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(_columns(list(candidates_of(file, data))), NAMES)

    return _archives(spark, path, glob, make, CANDIDATE)


def read_warc(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The records of all archives in `path` whose names match `glob`: columns of RECORD, reachable ones only.  A revisit's payload is
    empty; its payload_bytes and payload_digest are what its header says."""

    def make(file: str, data: memoryview) -> Iterator[pa.RecordBatch]:
        rows, held = _chained(list(candidates_of(file, data))), 0
        part: list[tuple] = []
        for k, row in enumerate(rows):
            part.append(row)
            held += row[2] - row[1]
            if held >= BATCH_BYTES or k == len(rows) - 1:
                payloads = pa.array([bytes(data[r[-1] : r[2] - 4]) for r in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*_columns(part), payloads], [*NAMES, "payload"])
                part, held = [], 0

    return _archives(spark, path, glob, make, RECORD)


def coverage(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """COVERAGE of each archive: `covered` of its `size` bytes are records of the chain; a chain that breaks covers less than the file.
    Files without a byte have no row, since Spark does not read them."""

    def make(file: str, data: memoryview) -> Iterator[pa.RecordBatch]:
        rows = list(candidates_of(file, data))
        chain = _chained(rows)
        found = [file, len(data), len(chain), chain[-1][2] if chain else 0, len(rows)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], [f.split()[0] for f in COVERAGE.split(", ")])

    return _archives(spark, path, glob, make, COVERAGE)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "warc")
    write_warc(shared.table(spark, sf_dir, "pages"), path)
    again = F.col("record_type") == "revisit"
    return read_warc(spark, path).select(
        "page_id", F.when(again, F.col("payload_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.col("payload_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"), "record_type", "refers_to",
    )


ORACLE = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS b FROM pages
), q AS (
  SELECT page_id, b, h, max(page_id) OVER (PARTITION BY h) AS first,
    list_transform(range(0, 8), lambda g: ('0x' || h[g * 5 + 1:g * 5 + 5])::BIGINT) AS v FROM p
)
SELECT page_id, b AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""
