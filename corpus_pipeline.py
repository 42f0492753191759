"""From raw documents to packed sequences: quality rules, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; a stage's table is written and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import exact_dedup, packing, pii, quality, similar
from mapweave.llm.common import documents, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SEQUENCE = 1024


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's and source's robust centre."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with 5-word similarity 0.8 or more, the document with the smallest doc_id.

    Candidates are the components of op4's fingerprints (links at 4 of 64 bits) and, as these reach few such pairs, the
    bands of min-wise hashes; all are verified.
    """
    return similar.drop_similar(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.mask(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most SEQUENCE ids; with the ids themselves."""
    return packing.pack_documents(docs, TOKENIZER, END_ID, SEQUENCE, with_ids=True)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("simhash near-dedup", near), ("pii", private), ("best-fit packing", pack)]

#: Robust estimates, ball hashing and packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
