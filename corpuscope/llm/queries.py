"""One query per operator, over its whole table, with the digest columns that tell whether its result is right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscope.llm import oracles
from corpuscope.llm.common import SPACES
from corpuscope.llm.embedding_dedup import embedding_duplicates
from corpuscope.llm.fuzzy_hash import fingerprint_documents
from corpuscope.llm.language_id import fit_language_model, identify_languages
from corpuscope.llm.line_dedup import dedup_lines
from corpuscope.llm.ngram_join import near_duplicates
from corpuscope.llm.packing import pack
from corpuscope.llm.phrases import collocations
from corpuscope.llm.pu_quality import fit_quality, score_documents
from corpuscope.llm.quality_rules import score_quality
from corpuscope.llm.sentencepiece_codec import token_digests
from corpuscope.llm.substring_dedup import remove_repeated_passages
from corpuscope.llm.toxicity import fit_toxicity, score_toxicity
from corpuscope.llm.tokenizer_files import tokenizer_file
from corpuscope.llm.vector_codes import compress_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), SPACES, " " * len(SPACES)), " "), "")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors and two turned and longer copies of each: a chain of two links per vector."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    after = e.select(F.pmod(F.col("vec_id") - 1, F.lit(e.count())).alias("vec_id"), F.col("embedding").alias("w"))
    turned = F.zip_with("embedding", "w", lambda x, y: (x.cast("double") + F.col("k") * F.lit(0.15) * y.cast("double")) * (F.col("k") + 1))
    copies = e.join(after, "vec_id").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    return embedding_duplicates(copies.select((F.col("vec_id") * 3 + F.col("k")).alias("vec_id"), "label", turned.alias("embedding")), least=0.98)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), size=1024).drop("ids")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_language_model(docs))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_substring_dedup, op4_embedding_dedup, op5_line_dedup, op6_packing, op7_language_id, op8_quality_classifier, op9_toxicity, op10_sentencepiece, op11_vector_codes, op12_phrases, op13_fingerprints)}
    return named | {"embedding_copies": embedding_copies, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Operators 6 to 10, 13 and the pipeline need tokenizers, fitted models or byte hashes, which SQL lacks: tests hold them against brute force."""
    return {
        "op1_quality_rules": oracles.quality_rules(),
        "op2_ngram_join": oracles.ngram_join(),
        "op3_substring_dedup": oracles.substring_dedup(),
        "op4_embedding_dedup": oracles.embedding_dedup(),
        "embedding_copies": oracles.embedding_dedup(rows=oracles.COPIES),
        "op5_line_dedup": oracles.line_dedup(),
        "op11_vector_codes": oracles.vector_codes(),
        "op12_phrases": oracles.phrases(),
    }
