"""The training-corpus pipeline: documents in, token ids of the kept documents out.

All stages take tables whose columns may be null, empty tables, repeated rows and extra columns of
any name. Null and empty texts are kept by the deduplicating stages (copies of each other, so one of
them) and by decontamination; whether quality keeps them is for its model to say. Rows without doc_id
are never dropped as copies. All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, decontaminate, quality, simhash, substring
from attesta.llm.columns import free_name
from attesta.session import cut, table


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier junk than well-formed go; without labels all stay."""
    out = tuple(free_name(n, docs.columns) for n in ("expected_grade", "tail_probability", "keep"))
    scored = quality.score_quality(docs, quality.graded(table(spark, sf_dir, "labels")), out=out)
    return scored.where(out[2]).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Candidates by SimHash of five-word shingles within nine bits of one of three fingerprints, verified at a Jaccard
    similarity of 0.8.
    """
    return simhash.drop_copies(docs, shingle=5, max_bits=9, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out of the later ones."""
    return substring.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stands in benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document; a null text has none."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.bpe_encode(docs.select("doc_id", "text"), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", drop_junk),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: SQL cannot express the fitted, hashed and encoded stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, one after the other, cut between stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
