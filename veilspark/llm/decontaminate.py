"""Benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only).

An item is contained in a document when at least `threshold` of its distinct shingles (`WIDTH` words; all words of a shorter
item) occur in the document.  Words are runs of letters and digits, A-Z lower-cased.

Search: a shingle's 64-bit hash is its min-hash value.  Of an item with n shingles, a document that holds ceil(threshold * n)
of them must hold one of any n - ceil(threshold * n) + 1, so an item's sketch is that many of its smallest hashes (bottom-k
MinHash, k growing with the item).  Items are partitioned by shingle width and by powers of two of n; each partition has the greatest hash of its sketches
and the least size a document needs, and a document probes only with shingles below the bound of the partitions
it is large enough for.  No pair at or above the threshold can be missed, however long the document; that is why the sketch is a bottom-k sketch:
fixed-length MinHash signatures of a whole long document lose short items.

Verification: the exact containment, on the shingles' words, of each candidate pair.

Defined results: null or wordless texts and items match nothing; in `contained`, rows with the same id are the same document or item (the
largest containment counts; null ids are one id), while `decontaminate` judges each row by its own text; empty tables give no pairs; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import shared

WIDTH = 5
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(shared.lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _positions(words: Column, width: int) -> Column:
    last = F.size(words) - width
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` as a lambda's variable: where the optimiser copies an expression, as it does for inferred
    filters, its parts are still made once for each row and not once for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_shingles(words: Column, width: int) -> Column:
    return bound(words, lambda w: F.transform(_positions(w, width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))


def shingle_texts(words: Column, width: int) -> Column:
    return bound(words, lambda w: F.array_distinct(F.transform(_positions(w, width), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))))


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, width, n, hashes ascending, texts); one row for each id and text with words."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0).distinct()
    out = None
    for width in range(1, WIDTH + 1):
        of = rows.where(F.size("words") == width if width < WIDTH else F.size("words") >= WIDTH)
        of = of.select("item_id", F.lit(width).alias("width"), F.array_sort(F.array_distinct(hashed_shingles(F.col("words"), width))).alias("hashes"), shingle_texts(F.col("words"), width).alias("texts"))
        out = of if out is None else out.unionByName(of)
    return out.withColumn("n", F.size("hashes"))


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of each pair at or above the threshold."""
    need = F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    items = shared.kept(items_of(benchmark, item_id, item_text).withColumn("need", need).withColumn("part", F.floor(F.log2("n")).cast("int")), "items")
    sketch = items.select("item_id", "width", "part", "need", F.explode(F.slice("hashes", F.lit(1), F.col("n") - F.col("need") + 1)).alias("h"))
    bounds = sketch.groupBy("width", "part").agg(F.max("h").alias("h"), F.min("need").alias("need")).collect()  # at most widths x 31 rows

    probes = None
    for width in sorted({b["width"] for b in bounds}):
        of = sorted((b for b in bounds if b["width"] == width), key=lambda b: b["need"])
        most = F.lit(of[0]["h"])
        for low, b in zip(of, of[1:], strict=False):  # the bound of every partition up to the document's size
            high = max(x["h"] for x in of[: of.index(b) + 1])
            most = F.when(F.col("_n") >= b["need"], F.lit(high)).otherwise(most)
        words = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("_w"))
        hashes = words.select("doc_id", hashed_shingles(F.col("_w"), width).alias("_h"))
        sized = hashes.withColumn("_n", F.size("_h")).withColumn("_b", F.when(F.col("_n") >= of[0]["need"], most))  # too small: null, no probes
        rows = sized.select("doc_id", F.explode_outer(F.filter("_h", lambda h: h <= F.col("_b"))).alias("h")).withColumn("width", F.lit(width))
        probes = rows if probes is None else probes.unionByName(rows)
    if probes is None:
        return docs.sparkSession.createDataFrame([], docs.select(F.col(doc_id).alias("doc_id")).schema).join(
            items.select("item_id").limit(0), F.lit(False)
        ).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_item_shingles"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))

    keys = shared.kept(sketch.select("item_id", "width", "h").distinct(), "sketches")
    pairs = shared.kept(shared.meet(probes, keys, ["width", "h"], ["doc_id"]).select("doc_id", "item_id").distinct(), "candidates")

    # Verification: texts of candidate documents only; a document's shingles are made once for all its items.
    asked = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("_items"), F.max(F.col("item_id").isNull()).alias("_null"))
    asked = shared.if_small(shared.kept(asked, "asked"))
    texts = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).join(asked, F.col("_d").eqNullSafe(F.col("doc_id"))).withColumn("_w", words_of(F.col("_t")))
    each = texts.select("doc_id", "_w", F.explode(F.when(F.col("_null"), F.array_append("_items", F.lit(None))).otherwise(F.col("_items"))).alias("_i"))
    known = shared.if_small(items.select("item_id", "width", "n", "need", "texts"), rows=10_000, size=F.aggregate("texts", F.lit(0), lambda n, t: n + F.octet_length(t)))
    each = each.join(known, F.col("_i").eqNullSafe(F.col("item_id")))
    made = None
    for width in sorted({b["width"] for b in bounds}):
        made = F.when(F.col("width") == width, shingle_texts(F.col("_w"), width)) if made is None else made.when(F.col("width") == width, shingle_texts(F.col("_w"), width))
    each = each.withColumn("n_shared", F.size(F.array_intersect("texts", made)).cast("long")).where(F.col("n_shared") >= F.col("need"))
    each = each.withColumn("containment", F.col("n_shared") / F.col("n"))
    best = each.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", F.col("n").cast("long").alias("n"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_item_shingles"), F.col("b.n_shared").alias("n_shared"), F.col("b.containment").alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """`docs` without the rows whose own text contains a benchmark item; clean rows pass unchanged, also where they share the id of one that goes."""
    keyed = docs.select("*", F.struct(*shared.row_key("t1", "t2")).alias("_row"))
    found = contained(keyed, benchmark, threshold, doc_id="_row").select("doc_id.t1", "doc_id.t2").distinct().toDF("_t1", "_t2")
    found = shared.kept(found, "leaks")
    key = ["_t1", "_t2"]
    return docs.select("*", *shared.row_key(*key)).join(shared.if_small(found), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS g
  FROM (SELECT item_id, w, least(5, len(w)) AS width FROM item WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id
), d AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS g
  FROM doc, (SELECT DISTINCT width FROM s) ws WHERE len(w) >= width
)
SELECT doc_id, item_id, max(n)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / max(n) AS containment
FROM d JOIN s USING (width, g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.75 * max(n))
"""
