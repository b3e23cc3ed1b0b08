"""From raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept;
run() writes each result as Parquet and reads it again as the next one's docs.  All stages but
the last return the columns of documents and keep any others.  An empty table stays one, and columns of any
name may stand beside doc_id and text.  Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import bpe, decontaminate, linededup, neardup, quality
from skylattice.llm.shared import fold, written

#: Documents whose quality score is below this are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labels outside the held-out fold.

    Each row is judged by its own text, null and empty ones like any other; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    voter = quality.fit_voter(docs, labels)
    return quality.keep(docs, voter, least=LEAST_QUALITY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a document of which no word is left goes.

    Earlier is the smaller id, a null id before all others; rows alike in id and text come out alike.
    Null, empty and blank texts stay as they are.
    """
    clean = linededup.dedup_lines(docs, prefix="_dedup_")
    emptied = (F.col("_dedup_words_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    clean = clean.where(~emptied)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("_dedup_words_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at 0.8.

    Rows with a null id, and texts without a word, are linked with nothing and stay; rows that share an id
    stay or go together.
    """
    return neardup.keep_representatives(docs, neardup.near_duplicates(docs, words=5))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item; rows that share an id stay or go together, those with a null id stay."""
    return decontaminate.remove_leaking(docs, decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them; a null text has no tokens."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]

#: SQL can't express these stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
