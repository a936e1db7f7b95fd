"""The corpus pipeline: stages, their columns, edge cases; and that the package stands without the llm folders."""

import os
import shutil
import subprocess
import sys

import pytest

from test_words import brute_components, brute_contamination

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secrets", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        after = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns or i == 4
        if name == "ngram_jaccard":
            assert after == {int(i) for i, _, c in brute_components(list(before.items())) if i == c}
        elif name == "decontamination":
            assert after == {int(r[0]) for r in brute_contamination(list(before.items()), benchmark) if not r[4]}
        elif name == "language_id":
            assert len(after) >= 0.99 * len(before)
        else:
            assert after == set(before)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_equals_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows_and_empty_table(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "the words of a text", None, None, 19), (3, "the words of a text", None, None, 19), (None, "more words in it", "en", "s", 16), (4, "password=abcdefgh12 in words", "en", "s", 28)]
    for docs, most in ((documents(spark, rows), 4), (documents(spark, []), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= most


@pytest.mark.parametrize("gone", [("tallyloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_llm_folders(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[os.path.basename(g) for g in gone]))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
