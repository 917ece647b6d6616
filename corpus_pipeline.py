"""A corpus from raw documents to packed sequences, in five stages of the training-data operators.

Every stage but the last returns the columns of documents; each is written and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import mixing, packing, probminhash, quality, toxicity
from lodestrata.llm.op2 import THRESHOLD
from lodestrata.llm.session import release, remove, shared_folder, table

#: Target shares of tokens by language. English keeps its own, the others are repeated to follow.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
#: Labelled rows of a language that its classifier is fitted on at most.
PER_LANGUAGE = 300
#: No SQL has the toxicity model, near-duplicate classes, fitted rates or tokens.
ORACLE_SQL = None


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs. Rows alike are judged alike."""
    row = fresh(docs, "_row")
    marked = docs.withColumn(row, F.xxhash64("doc_id", "lang", "text"))
    judged = quality.judge(marked, table(spark, sf_dir, "labels"), keep=[row])
    kept = judged.where("kept").select(row).distinct()
    return marked.join(kept, row, "left_semi").select(docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on labelled ones among them."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.without_toxic(docs, model, THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class; of repeated rows one. Rows without an id are known by
    their text and stay only where no document with an id is like them."""
    known = fresh(docs, "_known")
    found = probminhash.near_duplicates(docs)
    firsts = found.where("known_as = class_id").select(F.col("known_as").alias(known)).distinct()
    named = docs.withColumn(known, probminhash.known_by(F.col("doc_id"), F.col("text")))
    return named.join(firsts, known, "left_semi").dropDuplicates([known]).select(docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the rate of its languages says; rows without an id once.

    The labelled table is the labelled documents with their languages; a document's own column
    is not looked at, so one in two languages counts for both by its posterior.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.join(labels, "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, labelled, LANGUAGES, anchor="en", per_domain=PER_LANGUAGE)
    times, one = fresh(docs, "_times"), fresh(docs, "_one")
    copies = mixed.groupBy("doc_id").agg(F.max("copies").alias(times))
    rows = docs.join(copies, "doc_id", "left").withColumn(times, F.coalesce(times, F.lit(1)))
    return rows.where(F.col(times) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens: one row a piece, with its ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_dedup),
    ("mixing", mix_to_weights),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what stands between them is written to the shared folder, and
    deleted there once the next stage is written. What the last stage reads stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
