"""Corpus pipeline: five stages from raw documents to token counts.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read as the next
one's ``docs``.  All but the last return the columns of ``documents``, and more columns of the input pass through whatever
their names.  An empty table passes every stage; very long texts are read whole, in batches bounded in bytes.

Odd rows: a null or empty text has no language and goes in the first stage; given to a later stage it stays, with no links,
no hits, no secrets and the end id alone.  Rows that repeat an id are judged each by its own text; of rows equal in id and text the
second stage keeps one.  A row with a null id is kept by all stages that its text passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, language_id, ngram_jaccard, secrets, sentencepieces
from tallyloom.llm.shared import hidden, stage, table

#: A text is rejected if its language is undetermined or its score is under this; with four languages
#: a network that knows nothing scores 0.25.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told."""
    lang, score = hidden(docs, "lang", "score")
    found = language_id.identify(docs, language_id.train(docs), lang=lang, score=score)
    return found.where((found[lang] != language_id.UNDETERMINED) & (found[score] >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents that with the smallest id."""
    return ngram_jaccard.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with secrets replaced in their texts (and ``n_chars`` counted anew)."""
    return secrets.redact(docs)


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return sentencepieces.tokenize(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("sentencepiece", count_tokens),
]

#: The network and the tokenizer have no form in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
