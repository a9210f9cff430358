"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fim, lexical, mixing, near_dedup, pages, quality, sql, tokens, toxicity, url_filter, vectors
from .shared import Scratch, table

#: Where the public vocabularies lie; none is copied into the repository.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
END_ID = 2


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "source", "lang"])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), percent=85)


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "token-orc").path("tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), END_ID)
    return tokens.token_digests(tokens.read_tokens(spark, path))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(spark, table(spark, sf_dir, "embeddings"))


#: Documents with this score or more are predicted to be toxic.
TOXIC_FROM = 0.3


def held_out() -> Column:
    """Documents that toxicity isn't learnt from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out()))
    scored = toxicity.score(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "spans")


#: The rules that the query applies: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = tokens.encode_bytes(docs, path, public_tokenizers.PATTERN, keep_text=False, decoded_col="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_html=False).select("page_id", "url", "text", "n_chars")


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    whole = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": sql.URL_FILTER, "op7_mixing": sql.MIXING, "op11_tiered_search": sql.TIERED_SEARCH, "op12_fill_in_middle": sql.FILL_IN_MIDDLE,
        "op13_exact_dedup": sql.EXACT_DEDUP,
    }
