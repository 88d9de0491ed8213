"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the 1- to 3-grams of the lower-cased text's code points (all but letters become a blank), hashed to `DIM` buckets;
1 + log(tf) times a smoothed idf, to unit length.  Document frequencies are counted over all training rows.
The classifier is fitted on a bounded sample: `PER_LANGUAGE` rows of each language, chosen by a hash of
the doc_id, with follow-the-regularised-leader (FTRL-proximal) steps and an elastic-net penalty.  A fifth of the
sample is held back for the temperature that divides the logits.

Training uses text and non-null lang of rows with crc32(doc_id as text) mod 4 other than 2.  A prediction uses the text only.

Defined results: null text, or text without a letter, is `und` with score 0; so is everything when no row can be learnt from; ties go to
the language first in order; a null doc_id is not learnt from and not held out; rows with repeated ids are predicted each;
an empty table gives an empty table; further columns pass through (`lang_pred` and `score` are replaced).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import shared

DIM = 1 << 15
ORDERS = 3
PER_LANGUAGE = 1200
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.5, 1.0, 1e-3, 1e-4
UNKNOWN = "und"

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000))
    return _letters[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets ascending, 1 + log of their counts), or None for a text without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    basic = points < 0x10000
    is_letter = letters()[np.where(basic, points, 0)] & basic
    if not basic.all():
        is_letter |= ~basic & np.fromiter((chr(p).isalpha() for p in points), dtype=bool, count=len(points))
    if not is_letter.any():
        return None
    c = np.where(is_letter, points, np.uint32(32))
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # one blank for a run of them
    grams, h = [], np.zeros(len(c), dtype=np.uint32)
    for n in range(ORDERS):
        h = h[: len(c) - n] * _MIX[0] + (c[n:] + np.uint32(n + 1)) * _MIX[1]
        grams.append(((h ^ (h >> np.uint32(15))) * _MIX[2]) >> np.uint32(32 - 15))
    counts = np.bincount(np.concatenate(grams), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


def weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = found[1] * idf[found[0]]
    return x / np.sqrt(x @ x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[str], langs: list[str], idf: np.ndarray) -> dict | None:
    """{langs, weights (language x DIM, float32), bias, temperature, idf} by FTRL-proximal over the rows in a seeded order."""
    rows = [(f, y) for t, y in zip(texts, langs, strict=True) if (f := features(t)) is not None]
    names = sorted({y for _, y in rows})
    if not names:
        return None
    order = np.random.default_rng(3).permutation(len(rows))
    data = [(rows[i][0][0], weighted(rows[i][0], idf), names.index(rows[i][1])) for i in order]
    held = data[: len(data) // 5]
    z, n = np.zeros((DIM + 1, len(names))), np.zeros((DIM + 1, len(names)))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in data[len(held) :]:
            at, x = np.append(at, DIM), np.append(x, 0.3)  # the last is the bias
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    w = weights(z, n)
    logits = [(x @ w[at] + 0.3 * w[DIM], y) for at, x, y in held or data]

    def loss(t: float) -> float:
        # as in Platt scaling, targets keep off 1, or separable rows would drive the temperature to nothing
        miss = 1 / (len(logits) + 2)
        total = 0.0
        for v, y in logits:
            log_p = np.log(np.maximum(softmax(v / np.exp(t)), 1e-300))
            total -= (1 - miss) * log_p[y] + (miss * (log_p.sum() - log_p[y]) / (len(names) - 1) if len(names) > 1 else 0)
        return total

    low, high = -3.0, 3.0  # golden-section search for the log of the temperature
    for _ in range(40):
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return {"langs": names, "weights": w[:DIM].astype(np.float32), "bias": 0.3 * w[DIM], "temperature": float(np.exp((low + high) / 2)), "idf": idf}


def predict(text: str | None, model: dict | None) -> tuple[str, float]:
    found = features(text) if model else None
    if found is None:
        return UNKNOWN, 0.0
    p = softmax((weighted(found, model["idf"]) @ model["weights"][found[0]] + model["bias"]) / model["temperature"])
    return model["langs"][int(p.argmax())], float(p.max())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """A model from documents (doc_id, text, lang).  Counts of all training rows; a sample of `per_language` rows each for the weights."""
    spark = docs.sparkSession
    shared.ship(spark)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        df, n = np.zeros(DIM + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = features(text)
                if found is not None:
                    df[found[0]] += 1
                    n += 1
        df[DIM] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows at most
    df = np.zeros(DIM + 1)
    for r in counted:
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(place < share[F.col("lang")]).select("text", "lang")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        model = fit([t for t, _ in pairs], [y for _, y in pairs], idf)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def identify(docs: DataFrame, model: dict | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with `lang_pred` and `score`."""
    shared.ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        for batch in batches:
            found = [predict(t, model) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            kept = [(f.name, batch.column(batch.schema.get_field_index(f.name))) for f in fields]
            more = [("lang_pred", pa.array([x for x, _ in found], pa.string())), ("score", pa.array([x for _, x in found], pa.float64()))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + more], [n for n, _ in kept + more])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: dict | None, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a probability of at least `least`; columns as they were."""
    return identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
