"""A corpus pipeline of five training-data operators: each stage works on all that the one before kept.

Order: quality classifier, n-gram Jaccard join, personal data, mixing, packing. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.llm import jaccard, mixing, packing, pii, quality
from reprolens.llm.common import Stage, documents


WORDS, PERCENT = 5, 80  # of a shingle; similarity in hundredths


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below the cut. Learns from the labelled rows of this stage's own input."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; documents without an id are in no group.

    Documents are alike from a similarity of 0.8 of their five-word shingles on.
    """
    found = jaccard.components(spark, docs, WORDS, PERCENT)
    gone = found.filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each span that is found."""
    return pii.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them, whatever columns they have beside.

    Rows alike in id, source and size are alike for the mix: they are numbered on both sides and paired
    by number, so that each row gets its own copies.
    """
    return mixing.take(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: SQL can't express the classifier, the field or the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written and read again."""
    stage, docs, before = Stage(spark, "pipeline"), documents(spark, sf_dir), None
    for name, function in STAGES[:-1]:
        docs = stage.write(function(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
        stage.free()
    return STAGES[-1][1](spark, docs, sf_dir)
