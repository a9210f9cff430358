"""Documents to training tokens in five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_dedup, quality, tokens, toxicity
from lodestone.llm.queries import BYTE_BPE, TOXIC_FROM, held_out
from lodestone.llm.shared import Scratch, small_batches, table

#: The stages train and score models, so SQL can't express them; tests/llm/test_pipeline.py follows them one by one.
ORACLE_SQL = None

#: Jaccard similarity, in percent, from which two documents are near-duplicates.
NEAR_PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    small_batches(spark)
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC_FROM."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    names = {c: f"__col{i}" for i, c in enumerate(docs.columns)}
    inside = docs.withColumnsRenamed(names)
    scored = toxicity.score(spark, inside, model, text_col=names["text"], score_col="__score", spans_col=None)
    return scored.where(F.col("__score") < TOXIC_FROM).select(*(F.col(names[c]).alias(c) for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from NEAR_PERCENT on."""
    small_batches(spark)
    return near_dedup.keep_one(spark, docs, percent=NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix takes it."""
    return mixing.mixed(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, and whether they decode to its text."""
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path(BYTE_BPE)
    whole = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    given = docs.select("doc_id", "source", "lang", "text", whole.alias("sha256"))
    both = tokens.encode_bytes(given, path, public_tokenizers.PATTERN, keep_text=False, decoded_col="decoded")
    exact = F.sha2("decoded", 256) == F.col("sha256")
    return both.select("doc_id", "source", "lang", "n_tokens", "ids", exact.alias("exact"))


STAGES = [("quality", good), ("toxicity", harmless), ("near_dedup", distinct), ("mixing", mixed), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents."""
    tmp, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tmp.cut(docs, name)
    return docs
