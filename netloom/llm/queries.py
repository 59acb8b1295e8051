"""The queries of this subpackage, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, html, importance, langid, lines, near_dup, substrings, tiling, token_files, toxicity, whitening, wordpiece
from .common import read, shared_folder
from .packing import pack


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as power-of-two pieces, with a checksum of each piece's ids."""
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that start in a smaller document."""
    kept = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of greedy word pieces of every document, over a public vocabulary."""
    import public_tokenizers

    begin, follow = wordpiece.sentencepiece_vocabulary(public_tokenizers.path(wordpiece.VOCABULARY))
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), begin, follow)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold most of a benchmark item, in whatever order."""
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that nearly repeat an earlier one."""
    kept = lines.drop_fuzzy_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the verdict on every document."""
    judged = forest.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    found = toxicity.score(docs, toxicity.learn(docs.where(~toxicity.held_out()), labels))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and the rank of those drawn."""
    found = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.documents.select("doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the leading components of the distinct ones, with unit variance."""
    vectors = read(spark, sf_dir, "embeddings")
    model = whitening.fit_whitening(vectors)
    return whitening.long_form(whitening.whiten(vectors, model), model)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written to files of packed blocks and read back."""
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write_ids(read(spark, sf_dir, "documents"), folder)
    return token_files.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_token_counts, op4_html_extraction, op5_language_id, op6_benchmark_decontamination, op7_line_dedup, op8_quality_rules, op9_toxicity, op10_minhash_near_dedup, op11_importance_resampling, op12_embedding_whitening, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substrings.SQL, "op10_minhash_near_dedup": near_dup.SQL, "op11_importance_resampling": importance.SQL}
