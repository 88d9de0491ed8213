"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

Index: a vector is normalised, padded with zeros to `spread` times its dimensions and rotated by a seeded random
orthogonal matrix; the signs of the result, packed, are its code.  With x the code as a unit vector and o the
rotated vector, the correction scalar is <x, o>.

Search: for a query q, <x, q> / <x, o> estimates <o, q>, and with high probability is off by at most
`eps` * sqrt((1 - <x, o>^2) / <x, o>^2 / (D - 1)).  The rotated query is rounded to `LEVEL_BITS` bits a component, whose bit planes are packed as the
codes are, so that <x, q> is counts of common bits (and, popcount) on words of 64; what rounding leaves widens the bound.
In each block of the index the k-th largest lower bound is a floor;
vectors whose upper bound is below it are dropped, the others are reranked on the original vectors in double precision.  Every row is
indexed; queries and index meet in blocks of about `BLOCK_BYTES` of vectors on either side, so that a block pair is one task's work, and a
query's best k of each block are merged by a window.  Vectors travel in the precision they are given in.  An index row is shipped once for each
block of queries: bytes grow with rows times queries, divided by the rows of a block.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; only vectors with as many
dimensions meet; a query never finds its own row, but finds copies of it under other ids; rows with a repeated vec_id are
candidates each; ties go to the smaller vec_id; a query with fewer candidates gets them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import shared

SEED = 7
#: Bits of a component of a rotated query.
LEVEL_BITS = 4
#: Vectors of one side of a block pair, in doubles.
BLOCK_BYTES = 8 << 20
INDEX = "vec_id long, dim int, vector binary, code binary, correction double"
FOUND = "query_id long, vec_id long, score double"


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray, spread: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, corrections, rotated unit vectors) of the rows."""
    dim = vectors.shape[1]
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow of squares
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ turn[:dim]
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim * spread), turned


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed bytes as words of 64 bits, one column for each row of `bits`; zeros fill the last word."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(padded.view(np.uint64).T)


def estimates(turned: np.ndarray, words: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, float]:
    """(<x, q> of each code x with one rotated query, one deviation of what rounding the query leaves)."""
    size, top = len(turned), (1 << LEVEL_BITS) - 1
    least = turned.min()
    step = max((turned.max() - least) / top, np.finfo(float).tiny)
    level = np.clip(np.rint((turned - least) / step), 0, top).astype(np.uint8)
    planes = _words(np.packbits((level[None, :] >> np.arange(LEVEL_BITS, dtype=np.uint8)[:, None]) & 1, axis=1))
    common = np.zeros(words.shape[1], dtype=np.int32)
    for plane in range(LEVEL_BITS):
        common += np.bitwise_count(words & planes[:, plane, None]).sum(axis=0, dtype=np.int32) << plane
    inner = least * (2 * ones - size) + step * (2 * common - int(level.sum(dtype=np.int64)))
    left = turned - (least + step * level)
    return inner / np.sqrt(size), float(np.sqrt(left @ left / size))


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", spread: int = 4) -> DataFrame:
    """INDEX rows of the usable vectors, with a number each (`row`); `vector` holds floats where `embedding` does, else doubles.  To be written
    (`shared.kept`) before it is searched, so that the numbers stay."""
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    usable = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = usable.where(F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                v = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                turn = turns.setdefault(int(dim), rotation(int(dim) * spread))
                bits, correction, _ = codes(v.astype(np.float64), spread, turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at], pa.int64()), pa.array(np.full(len(at), dim), pa.int32()), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(correction)],
                    ["vec_id", "dim", "vector", "code", "correction"],
                )

    shared.ship(vectors.sparkSession)
    return usable.mapInArrow(build, INDEX).withColumn("row", F.monotonically_increasing_id())  # an id may be many rows; blocks go by row


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    """Rows in double precision, each times a power of two: cosines stay as they are, and squares stay finite."""
    raw = np.frombuffer(b"".join(column), dtype=np.float32 if len(column.iloc[0]) == 4 * dim else np.float64).reshape(-1, dim).astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def search_block(queries: pd.DataFrame, index: pd.DataFrame, k: int, spread: int, eps: float) -> pd.DataFrame:
    """The k best of one index block for each query of one query block; FOUND rows."""
    none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if queries.empty or index.empty:
        return none
    dim = int(index["dim"].iloc[0])
    size = dim * spread
    base, asked = _vectors(index["vector"], dim), _vectors(queries["vector"], dim)
    ids, correction = index["vec_id"].to_numpy(), index["correction"].to_numpy()
    words = _words(np.frombuffer(b"".join(index["code"]), dtype=np.uint8).reshape(len(index), -1))
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int32)
    spare = np.sqrt(np.maximum(0, 1 - correction**2) / max(1, size - 1))
    norms = np.sqrt((base * base).sum(axis=1))
    turn, out = rotation(size), []
    for own, q in zip(queries["vec_id"].to_numpy(), asked, strict=True):
        length = np.sqrt((q * q).sum())
        inner, rounding = estimates((q / length) @ turn[:dim], words, ones)
        estimate, slack = inner / correction, eps * (spare + rounding) / correction
        lower = np.where(ids == own, -np.inf, estimate - slack)
        floor = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
        other = np.flatnonzero((estimate + slack >= floor) & (ids != own))
        score = (base[other] * q).sum(axis=1) / (norms[other] * length)  # row by row: copies tie wherever they are
        best = np.lexsort((ids[other], -score))[:k]
        out.append((np.full(len(best), own), ids[other][best], score[best]))
    return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))


def nearest(index: DataFrame, queries: Column, k: int = 5, spread: int = 4, eps: float = 3.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of `index` for which `queries` holds."""
    n, n_asked, dim = index.agg(F.count(F.lit(1)), F.count_if(queries), F.max("dim")).first()
    blocks = lambda rows: max(1, -(-rows * 8 * (dim or 1) // block_bytes))
    n_index, n_asked = blocks(n), blocks(n_asked)
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(n)).cast("int")
    left = index.where(queries).select("vec_id", "dim", "vector", part(n_asked, "q").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("ib"))
    right = index.select("vec_id", "dim", "vector", "code", "correction", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("qb"), part(n_index, "i").alias("ib"))
    keys = ["dim", "qb", "ib"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: search_block(a, b, k, spread, eps), FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = shared.kept(build_index(shared.table(spark, sf_dir, "embeddings")), "annindex")
    return nearest(index, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.l * c.l) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
