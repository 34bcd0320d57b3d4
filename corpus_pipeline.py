"""Corpus pipeline: toxicity, near copies, duplicate passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet in the shared folder and read again for the next stage.  Tables that
a stage wrote for itself, and those of its predecessor, are deleted once its result is written.

Edge cases: a null or empty text passes all filters and is one piece of one token; a null doc_id is
never dropped as a copy or a leak and keeps its words; repeated rows of one id stay or go together;
of copies the least id stays; texts of any length pass whole; other columns than COLUMNS are dropped,
so no name can clash; empty tables pass through: without labels nothing is toxic, without
benchmark nothing leaks, and no documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, jaccard_join, packing, substring_dedup, toxicity
from tessella.llm.common import drop_since, mark, materialize, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A model decides in the first stage, so SQL cannot express the pipeline.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model rejects.  It is fitted on labels of ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs.select(*COLUMNS), model).filter(~F.col("rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the least id."""
    groups = jaccard_join.link_components(docs)
    copies = materialize(groups.filter("component_id < doc_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)  # the planner knows how many copies there are


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id holds are cut out of ``text``."""
    return substring_dedup.dedup_substrings(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, point = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_since(spark, point, docs)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
