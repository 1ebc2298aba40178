"""The corpus pipeline: five stages from raw documents to packed sequences, each over all that the one before kept.

Every stage takes rows of null or repeated ids, repeated rows, null and empty texts and empty tables, and other columns
than the ones it reads; what it does with them is said below. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, language, packing, simhash, substrings
from siftwell.llm.shared import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told (no text, no letters); ``lang`` becomes the predicted one.

    Each row is judged by its text alone, whatever its id. Where no row has a label, nothing is learned and all go.
    """
    judged = language.predict(docs, language.fit(docs))
    kept = judged.filter(F.col("lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints: that of least id; one of no id only where all have none.

    Unlike texts of one id, or of none, are groups of their own and all stay; of repeated rows one does. Texts of no
    words are one group.
    """
    return simhash.survivors(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document of a smaller id has; documents of which nothing is left go.

    A null id is greater than any; rows of one id, or of none, take nothing from each other. A text without words
    stays as it is, a null one too.
    """
    cleaned = substrings.remove_repeats(docs).filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    kept = cleaned.withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs.

    Each row is judged by its text, whatever its id; a null text and an empty benchmark drop nothing.
    """
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.filter("n_hit = 0").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens, one row per piece with its ids.

    Each row is a document of its own, whatever its id; a null text is empty and has the end id alone. An empty table
    gives no piece.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SimHash, the kernel classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; an empty table gives no piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
