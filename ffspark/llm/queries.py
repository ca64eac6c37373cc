"""The registered queries of the llm operators, each over its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ffspark.llm import collocations, exact_dedup, html_extract, license_scan, mixing, ngram_join, packing, pii, quality_knn, quality_rules, secret_scan, spelling, warc

#: Vocabulary file of the packing query; see /opt/tokenizers/README.md.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"), every_page=True)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.two_pushes(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), words=4, num=85, den=100).drop("ref")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6) + F.lit(0.0))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_html_extraction, op2_secret_scans, op3_warc, op4_ngram_jaccard_join, op5_quality_classifier, op6_exact_dedup, op7_packing, op8_quality_rules, op9_mixing, op10_pii, op11_phrase_collocations, op12_spelling_variants, op13_license_scans)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scans": secret_scan.oracle_sql(),
        "op3_warc": warc.ORACLE_SQL,
        "op4_ngram_jaccard_join": ngram_join.oracle_sql(words=4, num=85, den=100),
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op9_mixing": mixing.oracle_sql(),
        "op10_pii": pii.oracle_sql(),
        "op11_phrase_collocations": collocations.oracle_sql(),
        "op12_spelling_variants": spelling.oracle_sql(),
        "op13_license_scans": license_scan.oracle_sql(),
    }
