"""Texts that differ under one id, in the Jaccard join."""

import pytest

from tallyloom.llm import ngram_jaccard


@pytest.mark.parametrize("light", [64, 1], ids=["light tiles", "size-banded tiles"])
@pytest.mark.parametrize("turn", [1, -1])
def test_each_text_of_an_id_is_matched(spark, light, turn):
    text = lambda word, change="": " ".join([f"{word}{i}" for i in range(100)] + [change])
    rows = [(5, text("a")), (5, text("b")), (5, text("c")), (7, text("a", "x")), (9, text("b", "x")), (9, text("d")), (3, text("c", "x")), (8, text("d", "x")), (6, text("e"))][::turn]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), light=light).collect()
    found = sorted((r["doc_id"], r["component_id"]) for r in got)
    assert found == [(3, 3), (5, 3), (5, 5), (5, 5), (6, 6), (7, 5), (8, 8), (9, 5), (9, 8)]
