"""The corpus pipeline: stages over ``documents``, each one of the training-data
operators of ``quarry.llm``.  Every stage's result is written as Parquet and
read again as the next one's input; every stage works on all that the one
before it kept.

A stage keeps the columns it is given (packing, the last, returns pieces).
Filtering stages drop rows and change none; rows without a doc_id cannot be
grouped or named, so only the quality classifier can drop them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, neardup, packing, quality, secrets
from quarry.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.  It learns from
    all labels of the documents at hand.  Null and empty texts are scored as
    texts without statistics; repeated rows are kept or dropped alike."""
    return quality.keep(docs, quality.train_on(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates.  Null, empty and
    blank texts are in no group; rows that share an id are one document and stay
    or go together."""
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.  Null and empty texts hold
    none; an empty benchmark drops nothing; rows that share an id go together."""
    return decontam.clean(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), every_item=True))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets; every document stays, and ``n_chars`` of a changed
    text is its new length.  Null and empty texts stay as they are."""
    masked = secrets.redact(docs.withColumn("_before", F.length("text")))
    changed = F.length("text") != F.col("_before")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 ids.  A null or empty
    text is its end id alone; long texts are cut; repeated rows are packed each."""
    import public_tokenizers as pt
    return packing.pack(docs, tokenizer=str(pt.path("byte_bpe_50k.json")),
                        ranks=str(pt.path("byte_bpe_50k.tiktoken")), pattern=pt.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("packing", sequence_packing),
]

# Scores, sketches and token ids are beyond SQL: tests/llm holds every stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{i + 1}")
    return docs
