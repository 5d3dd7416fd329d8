"""The corpus pipeline: documents are filtered by rules, freed of shared lines, deduplicated, masked and packed.

Each stage takes all that its predecessor kept, as written to Parquet and read again; all but the last return the columns
of documents. ORACLE_SQL is None: near-duplicate components and best-fit packing are iterative, so tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symtrace.llm import _util, linededup, minhash, packing, pii, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the default policy of the rule ledger."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that an earlier document has too; a row that this leaves without a word goes."""
    return linededup.drop_lines(docs, keep_emptied=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, k=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mask_personal_data", mask_personal_data),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    docs = _util.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = _util.materialise(docs, name)
            _util.drop_files(before)  # only what a stage wrote; the tables stay
    return docs
