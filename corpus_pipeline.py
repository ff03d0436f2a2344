"""Training-data preparation: documents to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of documents. Null ids and texts, repeated rows, empty tables and
further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, jaccard, language, lines, packing
from pulsegrid.session import freeze

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus' own labels teach; those without a letter and in no known language go."""
    return language.of_known_language(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted; a document of which only blank lines remain goes.

    ``n_chars`` follows the text.
    """
    cut = lines.without_repeated_runs(docs, removed="__removed")
    kept = cut.where((F.col("__removed") == 0) | F.col("text").rlike(r"[^\s]"))
    size = F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a Jaccard similarity of 0.8 on five words."""
    return jaccard.one_of_each(docs, n=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    return decontaminate.without_benchmark_text(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents, packed into sequences of 4096."""
    return packing.pack_documents(docs, tokenizer=TOKENIZER, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", pack),
]

# Language models, MinHash banding and packing are beyond SQL; tests/llm holds
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
