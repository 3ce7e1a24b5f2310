"""Queries of the dealt operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from . import audit, decontaminate, layout, licenses, merkle, minhash, packing, quality, runs, simhash, substring, urls, warc
from .common import table


def queries():
    return {
        "op1_simhash_near_dedup": lambda spark, d: simhash.near_duplicate_classes(table(spark, d, "documents")),
        "op2_quality_classifier": lambda spark, d: quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_best_fit_packing": lambda spark, d: packing.packed_sequences(table(spark, d, "documents")),
        "op4_merkle_fingerprints": lambda spark, d: merkle.edit_fingerprints(table(spark, d, "documents")),
        "op5_warc_archives": lambda spark, d: warc.archive_round_trip(table(spark, d, "pages")),
        "op6_html_layout": lambda spark, d: layout.extract_text(table(spark, d, "pages")),
        "op7_substring_dedup": lambda spark, d: substring.passage_report(table(spark, d, "documents")),
        "op8_benchmark_decontamination": lambda spark, d: decontaminate.leak_report(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op9_license_scan": lambda spark, d: licenses.scan_licenses(table(spark, d, "documents")),
        "op10_url_filter": lambda spark, d: urls.judge_urls(table(spark, d, "pages")),
        "op11_periodic_runs": lambda spark, d: runs.run_report(table(spark, d, "documents")),
        "op12_filter_audit": lambda spark, d: audit.interaction_report(table(spark, d, "documents"), table(spark, d, "labels")),
        "op13_minhash_near_dedup": lambda spark, d: minhash.near_duplicate_report(table(spark, d, "documents")),
    }


def oracle_sql():
    return {"op5_warc_archives": warc.oracle(), "op7_substring_dedup": substring.oracle(), "op9_license_scan": licenses.oracle(), "op10_url_filter": urls.oracle(), "op12_filter_audit": audit.oracle()}
