"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents. doc_id is the
documents' key; rows that repeat one are told apart by numbers of their own within a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lobspark.llm import exact_dedup, mixing, near_dedup, packing, shared, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents and drops those that score 0.3 or more."""
    return toxicity.reject(docs, shared.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their word shingles, the one with the smallest id stays."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources and languages approach flattened shares, with 0.7 of all tokens."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't train the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = shared.written()
        done = shared.write_out(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        shared.drop_since(mark, done)  # the stage's own tables; what it returned is in done
        shared.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
