"""The queries opN_<name> and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import ann, bpe, decontaminate, filter_audit, fim, html_text, language_model, quality, sharding, simhash, substring, token_files, toxicity
from attesta.session import table

#: Bytes of text in a shard of op8.
SHARD_BYTES = 4 << 20


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. Null, empty and wordless texts score 0; labels held out are never learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document; empty texts are scored by their figures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.graded(table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "expected_grade", "tail_probability", "keep")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have the fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null, empty and broken pages give what text they have, or none."""
    pages = html_text.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the ids and of the decoded text of every document; null is empty."""
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; null and empty texts have no words, items without id no name."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to files and read back; null is empty, the end id always stands."""
    return token_files.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document; null texts have no bytes, repeated rows are sharded each."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that stand in an earlier document; null texts have none."""
    found = substring.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "first_id", "first_start", "first_end")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth id; vectors that are null, zero or not finite take no part."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, query_every=100)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by the network and by counts; null texts hold an end only."""
    return language_model.lm_scores(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of five filters in all 120 orders, by source; null texts are empty, null sources ''."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document and digests of its output and of the text read back; null is empty."""
    return fim.fim_digest(table(spark, sf_dir, "documents"))


def queries():
    found = (op1_toxicity, op2_quality, op3_simhash, op4_html, op5_bpe, op6_decontaminate, op7_token_files, op8_sharding, op9_substring, op10_ann, op11_lm_scores, op12_filter_audit, op13_fim)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op8_sharding": sharding.shard_sql(SHARD_BYTES), "op12_filter_audit": filter_audit.audit_sql(), "op13_fim": fim.fim_sql()}
