"""A training corpus from `documents`, in stages.  Each stage's result is written as Parquet and read again as the next one's input.

Stages keep clean documents: a document goes only if its language is unknown or unsure (below 0.5), if it is not the smallest id of
its near-duplicate component, or if it holds a benchmark item.  Line deduplication drops lines, not documents.  The last stage adds
`token_ids` and `n_tokens` to the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, jaccard_join, langid, line_dedup, sentencepiece_viterbi, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that at least 10 documents share; n_chars follows.  An emptied document stays, empty."""
    kept, n, dropped = "_ld_text", "_ld_n_lines", "_ld_n_dropped"
    out = line_dedup.line_dedup(docs, names=(kept, n, dropped))
    new = {"text": F.col(kept), "n_chars": F.length(kept).cast("long")}
    return out.select(*[F.when(F.col(dropped) > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_viterbi.encode(docs, sentencepiece_viterbi.Vocabulary())
    return encoded.withColumn("n_tokens", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", tokens),
]

#: Language model, components and BPE are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = shared.kept(out, f"stage{k}")
            shared.done(docs)  # else the texts of every stage before would lie beside the next one's shuffles
        docs = out
    return docs
