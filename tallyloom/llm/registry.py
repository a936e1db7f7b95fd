"""Queries of the pipeline operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, centroids, decontaminate, html_extract, language_id, merkle, neighbours, ngram_jaccard, pii, secrets, sentencepieces, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_language_id": language_id.op2_language_id,
    "op3_secrets": secrets.op3_secrets,
    "op4_html": html_extract.op4_html,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_sentencepiece": sentencepieces.op7_sentencepiece,
    "op8_pii": pii.op8_pii,
    "op9_bm25": bm25.op9_bm25,
    "op10_ngram_jaccard": ngram_jaccard.op10_ngram_jaccard,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_nearest_neighbours": neighbours.op13_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_filter.SQL,
    "op3_secrets": secrets.SQL,
    "op5_warc": warc.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op9_bm25": bm25.SQL,
    "op10_ngram_jaccard": ngram_jaccard.SQL,
    "op11_centroid_clustering": centroids.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
