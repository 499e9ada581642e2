"""A corpus pipeline: five operators in a row over the documents of one data directory.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns the columns of ``documents``, but for the last, which returns pieces.

Defined cases, of all stages: an empty table gives no rows; columns besides
``doc_id``, ``text`` and ``source`` are kept whatever their names; a null text is an
empty one, stays and is packed as its end id alone; a null ``doc_id`` stays null.
Each stage says what it does with repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import jaccard, mixing, packing, surrogates, toxicity
from skein.llm.common import cut, table

#: SQL cannot express the trained model, the keyed surrogates or the tokeniser.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.3; repeated rows alike. Without labels that tell anything, all."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links: the smallest id, nulls last, of equal ids by a hash of the text. Of repeated rows one stays; texts without words all stay."""
    return jaccard.one_of_each(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; repeated rows alike."""
    return surrogates.anonymise(docs, surrogates.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources twice where the weights ask for it; a null source is one of its own; repeated rows each."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens at most; repeated rows each, ties by id, start and checksum."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("pii", replace_pii), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
