"""The queries of this subpackage, ``(spark, sf_dir) -> DataFrame``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (
    op1_minhash_dedup,
    op2_token_counts,
    op3_license_scan,
    op4_decontaminate,
    op5_arc_to_warc,
    op6_html_text,
    op7_url_filters,
    op8_byte_bpe,
    op9_quality_rules,
    op10_pii,
    op11_language_id,
    op12_source_divergence,
    op13_periodic_runs,
)
from quarry.llm.common import small_batches
from quarry.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark, sf_dir):
    return op1_minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_tokens(spark, sf_dir):
    return op2_token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op3_licenses(spark, sf_dir):
    return op3_license_scan.licenses(_table(spark, sf_dir, "documents"))


def op4_leaks(spark, sf_dir):
    return op4_decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc(spark, sf_dir):
    return op5_arc_to_warc.round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_text(spark, sf_dir):
    return op6_html_text.extract(_table(spark, sf_dir, "pages"))


def op7_urls(spark, sf_dir):
    return op7_url_filters.filter_urls(_table(spark, sf_dir, "pages"))


def op8_bpe(spark, sf_dir):
    return op8_byte_bpe.digests(_table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return op9_quality_rules.rules(_table(spark, sf_dir, "documents"))


def op10_personal(spark, sf_dir):
    return op10_pii.personal_data(_table(spark, sf_dir, "documents"))


def op11_language(spark, sf_dir):
    return op11_language_id.languages(_table(spark, sf_dir, "documents"))


def op12_divergence(spark, sf_dir):
    return op12_source_divergence.divergences(_table(spark, sf_dir, "documents"))


def op13_runs(spark, sf_dir):
    return op13_periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_tokens, op3_licenses, op4_leaks, op5_warc, op6_text, op7_urls, op8_bpe, op9_quality, op10_personal, op11_language, op12_divergence, op13_runs)
}

ORACLE: dict[str, str] = {
    "op3_licenses": op3_license_scan.ORACLE,
    "op5_warc": op5_arc_to_warc.ORACLE,
    "op7_urls": op7_url_filters.ORACLE,
    "op9_quality": op9_quality_rules.ORACLE,
    "op12_divergence": op12_source_divergence.ORACLE,
}
