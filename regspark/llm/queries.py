"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm import bpe, decontamination, language_id, line_dedup, lm_scoring, minhash, quality_classifier, quality_rules, spelling, suffix_dedup, top_k, toxicity, whitening
from regspark.llm.common import in_fold, table


#: op11: a run whose crc32 with the document's id this divides loses a code point.
MISSPELL_EVERY = 199
#: op13: rows whose id this divides are queries.
QUERY_EVERY = 50


def tokenizer_file(name: str) -> str:
    """The path of a public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), in_fold(F.col("doc_id"), 7, 2)
    learned = docs.where(~held_out)
    counts = lm_scoring.count_words(learned)
    return lm_scoring.score(docs, lm_scoring.train(learned, counts), counts).withColumn("held_out", held_out)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.score(docs, quality_classifier.train(docs, labels)).select("doc_id", "score", "keep")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 4, 2)
    model = language_id.train(docs.where(~held_out), tokenizer_file("piece_bpe_32k.model"))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, benchmark).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_found", "n_windows", "consistent")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizer_file("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed_col="n_removed").select("doc_id", "n_removed", "text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), in_fold(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.count_words(table(spark, sf_dir, "documents"), misspell_every=MISSPELL_EVERY)
    return spelling.spelling_groups(counts)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.search(vectors.where(f"vec_id % {QUERY_EVERY} = 0"), vectors).select("query_id", "rank", "vec_id", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_quality_rules": op2_quality_rules,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_bpe": op6_bpe,
        "op7_minhash": op7_minhash,
        "op8_line_dedup": op8_line_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_spelling": op11_spelling,
        "op12_whitening": op12_whitening,
        "op13_top_k": op13_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.ORACLE_SQL,
        "op5_decontamination": decontamination.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_spelling": spelling.oracle_sql(MISSPELL_EVERY),
        "op13_top_k": top_k.oracle_sql(QUERY_EVERY),
    }
