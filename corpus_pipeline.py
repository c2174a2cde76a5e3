"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows
as Parquet to the shared folder, reads them again for the next, and removes what no later
stage reads. All stages but the last return the columns of documents, extra ones too,
whatever they are called.

Defined results: a null text counts as an empty one in every stage (a null id is a document
like any other); empty texts have a score, are copies of each other, are near copies of
nothing else than what links with fingerprint zero, weigh nothing in the mix and are packed
as their closing id; texts of any length are read whole; of equal texts the largest id stays
(ties of repeated rows: one of them), of linked fingerprints the smallest; an empty table
gives an empty table at every stage; without labels nothing is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from newsgraph.llm import common, exact_dedup, mixing, near_dedup, packing, quality
from newsgraph.session import remove


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; all stay if no labelled ones of both kinds are given. Repeated rows are judged alike."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the document with the largest id stays, one row of it; a null id is below all others."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked SimHash fingerprints the document with the smallest id stays, one row of it; a null id comes last. Texts without words are linked."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that raking gives their source, language and topic; nulls of these are a value of their own.

    Rows of one id are drawn alike. The least label of the vector with a document's id is its topic."""
    return mixing.sample(docs, mixing.embedding_topics(common.table(spark, sf_dir, "embeddings")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents (longer ones than a sequence are cut, none is left out) and their places in sequences; repeated rows are packed once each."""
    return packing.pack(packing.pieces(docs, packing.vocabulary(), keep_ids=False))


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: A classifier, fingerprints and a tokenizer are no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = common.table(spark, sf_dir, "documents"), f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
