"""A pipeline from raw documents to packed sequences; part of the subpackage llm.

Defined cases hold for all stages: a null text counts as an empty one; very long texts are read
whole; rows with a null or a repeated doc_id are documents like others, as the operators state;
further columns, whatever their names, stay but for the last stage; a stage over an empty table gives
an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmap.llm.common import owned
from quillmap.llm.exact_dedup import drop_copies
from quillmap.llm.mixing import take_mix
from quillmap.llm.ngram_join import keep_first
from quillmap.llm.packing import pack
from quillmap.llm.quality_classifier import keep_good
from quillmap.operators.iteration import remove, shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It is trained on the rows of docs that labels of the same data name and that aren't held out, and on
    unlabelled ones. Empty texts and rows without doc_id are scored like others, repeated rows alike; with
    too few labels to train on every document goes, as its score of 0.5 is below the threshold.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the row with the smallest doc_id stays.

    All empty and null texts are equal; a row without doc_id stays only if all of its group are without;
    of repeated rows one stays.
    """
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Texts without words and rows without doc_id link with nothing and stay; rows repeated under one doc_id
    stay or go together.
    """
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a document stands as often as the mix takes it, twice at most.

    A null source is a source of its own; empty texts are taken once, or not at all if their source has no
    target; ties are settled by a hash of doc_id and text, so reruns agree.
    """
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, their token ids and digests of these, with their places in sequences.

    An empty text gives the one id that ends each document; copies that the mix made are packed like
    further documents.
    """
    return pack(docs, digests=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: No stage but exact_dedup can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written as Parquet to the shared folder and read again.

    What a stage read and kept is removed once its result is written. The last stage keeps the token ids,
    which the result reads; they go when the process ends.
    """
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with owned():
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, f"{at}/{before}")
        before = name
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, f"{at}/{before}")
    return out
