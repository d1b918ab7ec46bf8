"""Documents to token ids: toxic documents go, later copies of repeated line runs go, one document of each near-duplicate
group stays, sources are mixed to temperature weights, and what is left is encoded (and decoded again, as a check)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import encode_texts
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.mixing import replicate
from tidemark.llm.queries import rank_path
from tidemark.llm.toxicity import drop_toxic
from tidemark.session import materialize

#: Most times that a source's documents are repeated by the mix; the largest source is read once, so none is lost.
MAX_EPOCHS = 2.0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier learnt from the labels of four folds scores under 0.5; null and empty texts stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of line runs of 50 words; one that loses every line with a word goes. Null and
    empty texts stay as they are."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null last); texts without words stay."""
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources again as the temperature weights ask; a null source is one of its own."""
    return replicate(docs, max_epochs=MAX_EPOCHS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (where there), n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the
    text's bytes; null and empty texts have no ids."""
    import public_tokenizers

    both = encode_texts(docs, rank_path(), carry=[c for c in ("doc_id", "lang", "source") if c in docs.columns], decode=True, pattern=public_tokenizers.PATTERN)
    return both.select("row.*", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Learning, prefix trees and byte merges are beyond SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
