"""A training-data pipeline over `documents`: five of the operators of lattica.llm, one after another.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and is written as Parquet and read
again before the next. All but the last return the columns of docs.

Defined cases: null texts, and texts without a letter, go with the first stage. An empty table passes through every stage
and gives no rows. Rows that repeat a doc_id are judged each by its own text; rows that repeat each other are one to the
n-gram Jaccard join, which keeps the smallest doc_id of a group (nulls last; of ties in doc_id the smaller hash of the
text). Null ids are never held out and take part in every stage. A null source is a source of its own, last in order.
Without labels every document scores 0.5 and stays. Extra columns, whatever their names, pass through all stages but the
last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm import language_id, mixing, ngram_jaccard, packing, quality
from lattica.llm.common import held_out, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found (`und`: null texts and texts without a letter)."""
    model = language_id.fit(docs, ~held_out(F.col("doc_id"), 4, 2))
    found = language_id.identify(docs, model, [*docs.columns])
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    return quality.score(docs, model, [*docs.columns]).where("predicted = 1").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group linked by a similarity of 0.8 on 5-word shingles."""
    return ngram_jaccard.keep_first(docs, w=5, num=4, den=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to weights 5, 2, 1, repeating; a document taken twice comes as two rows."""
    return mixing.take_copies(docs, weights=(5, 2, 1), share=1.5, repeats=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048."""
    return packing.pack(docs, 2048)


STAGES = [("language ID", language), ("quality classifier", good), ("n-gram Jaccard join", distinct), ("mixing sources", mixed), ("best-fit packing", packed)]

#: The classifiers and the tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
