"""The corpus pipeline: quality rules, line de-duplication, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of documents (doc_id, text, lang, source, n_chars), with n_chars brought up to date where a stage
rewrites texts. ``run`` writes every stage's result to the shared folder and reads it back as the next one's documents.

All stages take null texts as empty ones, whole texts of any length, repeated rows and empty tables (which give empty tables);
columns other than those of documents are left out. Rows with a null doc_id go through: quality judges them by their text,
the stages that compare documents leave them as they are, packing packs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import hint_small, written
from corpuscope.llm.line_dedup import dedup_lines
from corpuscope.llm.ngram_join import keep_one_per_group
from corpuscope.llm.packing import pack
from corpuscope.llm.quality_rules import score_quality
from corpuscope.llm.substring_dedup import remove_repeated_passages
from corpuscope.llm.tokenizer_files import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior quality is low go.

    Verdicts are written without texts; texts pass through untouched. A row is known by its doc_id and a hash of its text, so
    repeated rows share a verdict. Null and empty texts have no words, fail the base rules and go.
    """
    keyed = docs.select(*COLUMNS).withColumn("__row", F.xxhash64("text"))
    verdicts = score_quality(keyed, columns=["doc_id", "__row"])
    rejected = hint_small(written(verdicts.where("not kept").select(F.col("doc_id").alias("__doc"), F.col("__row").alias("__hash")).distinct(), "rejected"))
    return keyed.join(rejected, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__hash")), "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them. A null text becomes an empty one; no row goes."""
    return dedup_lines(docs.select(*COLUMNS), min_chars=10, min_docs=2).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays: the smallest doc_id.

    Texts without words are near nothing and stay; repeated rows of the document that stays all stay.
    """
    return keep_one_per_group(docs.select(*COLUMNS), shingle=5, percent=80).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them. No row goes, even if its text becomes empty."""
    return remove_repeated_passages(docs.select(*COLUMNS), window=50).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 ids; a null or empty text is one id."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), size=1024).drop("ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("substring_dedup", passages), ("packing", packing)]
#: SQL cannot express tokenisation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
