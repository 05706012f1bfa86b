"""The operators' queries over whole tables, with production parameters, and their SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, html_template, isobmff, mixing, packing, pii, quality_rules, simhash, token_counts, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_text", "p_meta", "score")], "kept")


def op5_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages")).drop("template_tokens")


def op6_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sample(table(spark, sf_dir, "documents"), extra=True)
    return drawn.select("doc_id", "source", "lang", "topic", F.round("p", 6).alias("p"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = isobmff.feature(isobmff.media_columns(isobmff.encode(table(spark, sf_dir, "documents"))))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframes")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_segments, op2_token_counts, op3_pii_bootstrap, op4_cotraining, op5_html_template, op6_config_lp_packing, op7_ipf_mixing, op8_media_columns, op9_simhash, op10_quality_rules)
}
SQL: dict[str, str] = {"op1_warc_segments": warc.SQL, "op5_html_template": html_template.SQL, "op7_ipf_mixing": mixing.SQL, "op9_simhash": simhash.SQL, "op10_quality_rules": quality_rules.SQL}
