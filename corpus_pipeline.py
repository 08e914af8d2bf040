"""Corpus preparation in five stages, each written as Parquet and read again by whoever runs them.

1. toxicity: documents that the learned lexicon scores as toxic go;
2. near-duplicates: one document of each group stays whose five-word shingles are similar by 0.8 or more;
3. decontamination: documents that hold a window of the benchmark go;
4. personal data: spans are replaced by their kind;
5. packing: what is left becomes pieces of token sequences.

All but the last return the columns of ``documents``. Each stage reads only its predecessor's documents, and the tables
``labels`` and ``benchmark`` beside them; what a stage has written is deleted once the next one is. Null, empty and repeated rows,
empty tables, very long texts and columns of any name are handled as the operators state.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import common, decontaminate, packing, pii, simhash, toxicity


def afresh(stage):
    """The stage, begun with the heap given back that executors took for the one before."""

    @functools.wraps(stage)
    def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.relieve(spark)
        return stage(spark, docs, sf_dir)

    return inner


@afresh
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, common.documents(spark, sf_dir, "labels")))


@afresh
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


@afresh
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.documents(spark, sf_dir, "benchmark"))


@afresh
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


@afresh
def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_documents),
]

#: The stages are learned, iterative and tokenizer-bound, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole of ``documents``, each written to the shared folder and read again."""
    docs, before = common.documents(spark, sf_dir), None
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)  # read by the stage that has just been written
        before = docs
    return docs
