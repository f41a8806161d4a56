"""The corpus pipeline: a chain of the corpus operators over the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import fmindex, gam, mixing, repair, simhash
from quantloom.llm.columns import free_name
from quantloom.llm.vocabularies import tokenizer_file
from quantloom.shared import drop_table, new_path, stage_table, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.3 or more; empty and null texts are scored like any other."""
    model = gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_labelled=20_000)
    name = free_name(docs, "quality_score")
    return gam.score_documents(docs, model, name).where(F.col(name) >= 0.3).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints or of a five-word Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs, words=3, seed=42, distance=3, blocks=6, similarity=0.8, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that windows of the benchmark hit."""
    return fmindex.without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weights 3, 1, 2: a row for each time that a document is handed out."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, passes=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back by document."""
    path = new_path(spark, "pipeline-tokens")
    repair.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return repair.read_documents(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: SQL can express neither the fitted model, nor fingerprints, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage made is dropped when the next one has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark) as made:
            docs, path = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
            made.remove(path)
        if last:
            drop_table(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
