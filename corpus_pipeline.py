"""Corpus pipeline: language ID, line dedup, near-dedup, repeated passages, packing.

Each stage works on the whole output of the one before, read back from Parquet;
all but the last return the columns of ``documents``, with ``n_chars`` of the
new text. Rows with null ids or texts: see the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import language_id, line_dedup, near_dup, packing, repeats
from trellis.llm.common import read, write_read


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ``documents`` from ``extra`` and a new text."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(c, F.col(f"extra.`{c}`")).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; texts without a letter go."""
    return language_id.accepted(docs, language_id.learn(docs.where(language_id.training_rows())))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of lines; one that loses all of them goes."""
    rows = line_dedup.remove_lines(docs)
    return _with_text(rows.where((F.col("cut") == 0) | F.col("text").rlike(r"\S")), docs.columns, "text")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    dropped = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of long strings; one that loses all its text goes."""
    rows = repeats.remove_repeats(docs, as_text=True)
    return _with_text(rows.where((F.size("starts") == 0) | F.col("kept").rlike(r"\S")), docs.columns, "kept")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dup", dedup_documents),
    ("suffix_array_dedup", dedup_passages),
    ("best_fit_packing", pack),
]

#: Models, MinHash components and tokenisation are beyond SQL; the tests compare
#: the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each writes Parquet that the next rereads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_read(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
