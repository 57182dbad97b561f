"""The registered queries of this folder, each an operator on its whole table, and the SQL that checks some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fold_of
from millrace.llm.decontamination import benchmark_leaks
from millrace.llm.html_text import extract_main_text
from millrace.llm.language import fit_language_model, learning_rows, predict_language
from millrace.llm.licence_scan import scan_licences
from millrace.llm.mixing import mix_sources
from millrace.llm.near_duplicates import near_duplicates
from millrace.llm.neighbours import nearest_neighbours
from millrace.llm.oracles import ORACLES
from millrace.llm.repeated_passages import repeated_passages
from millrace.llm.personal_data import KINDS as PERSONAL_KINDS
from millrace.llm.personal_data import find_personal_data
from millrace.llm.repair import conversation_report, damage_conversations, repair_conversations
from millrace.llm.secret_scan import KINDS as SECRET_KINDS
from millrace.llm.secret_scan import scan_secrets
from millrace.llm.spans import joined
from millrace.llm.spelling import spelling_variants, word_counts
from millrace.llm.toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), [5, 2, 1], share=1.5, most_repeats=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.sha2(joined("base", SECRET_KINDS).cast("binary"), 256)
    spans = joined("found", SECRET_KINDS).alias("spans")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), spans)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_table(spark, sf_dir, "documents"), window=50)
    removed = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["first"]).cast("long")
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"))
    model = fit_language_model(docs.filter(learning_rows(fold)), key_cols=["doc_id"])
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"))
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").filter(learning_rows(fold)))
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_report(repair_conversations(damage_conversations(conversations)), conversations)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(_table(spark, sf_dir, "documents"), least_length=7, least_count=2, typo_every=31)
    return spelling_variants(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.sha2(joined("base", PERSONAL_KINDS).cast("binary"), 256)
    spans = joined("found", PERSONAL_KINDS).alias("spans")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base.alias("base_sha256"), spans)


def llm_queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
