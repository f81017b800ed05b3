"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from .bpe import encoding_digests
from .clustered_search import search_documents, search_sql
from .kneser_ney import classify
from .language_mixture import predict_languages
from .license_scan import license_report
from .line_crf import fit_from_labels, line_quality
from .line_dedup import line_digests
from .packing import pack
from .periodic_runs import run_digests
from .simhash import fingerprint_components
from .site_style import page_texts
from .transport_stream import media_digests
from .window_packing import pack_windows


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_components(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return line_quality(docs.select("doc_id", "text"), field).drop("text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op12_clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_windows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_site_style": op1_site_style,
        "op2_language_mixture": op2_language_mixture,
        "op3_kneser_ney": op3_kneser_ney,
        "op4_simhash": op4_simhash,
        "op5_line_dedup": op5_line_dedup,
        "op6_transport_stream": op6_transport_stream,
        "op7_line_crf": op7_line_crf,
        "op8_license_scan": op8_license_scan,
        "op9_packing": op9_packing,
        "op10_bpe": op10_bpe,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_clustered_search": op12_clustered_search,
        "op13_window_packing": op13_window_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_clustered_search": search_sql()}
