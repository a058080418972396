"""The corpus pipeline: documents to packed training sequences.

Each stage takes what its predecessor kept, whole, and all but the last return the columns of documents. `run` writes
each stage's rows to the shared folder (a reliable checkpoint) before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm.bestfit import pack
from docloom.llm.common import cut, table
from docloom.llm.decontam import decontaminate
from docloom.llm.line_dedup import dedup_documents
from docloom.llm.parity_join import one_of_each
from docloom.llm.quality_lines import clean_documents
from docloom.llm.queries import SEQUENCE_TOKENS, tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their lines above the limit."""
    return _measured(clean_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals; documents with no line left go."""
    return _measured(dedup_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with up to a tenth of its characters edited."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence."""
    return pack(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL has neither byte-pair merging nor edit distance to a substring; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
