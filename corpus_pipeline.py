"""From raw documents to packed sequences, in five stages.

Each stage takes what the one before it kept, as Parquet, and gives it on:
language identification, line deduplication, near-duplicate removal,
decontamination and packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursewright.functions.storage import stored
from coursewright.llm.decontam import drop_contaminated
from coursewright.llm.langid import drop_unknown_language
from coursewright.llm.line_dedup import drop_repeated_lines
from coursewright.llm.packing import pack_documents
from coursewright.llm.simhash import keep_one_of_each

STAGES = [
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Models, fingerprints and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the pieces of the packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
