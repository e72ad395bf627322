"""Scores from counts: n-grams of crowded middles, and the disk that the exchange leaves."""

from __future__ import annotations

import random

import pytest

from corpus_fixtures import texts  # noqa: F401
from tallyspark.llm import lm_score
from test_search_links_alignment import backoff_scores


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_crowded_words_pairs_and_trigrams(texts, order):
    rng = random.Random(order)
    words = ["the"] * 12 + ["of"] * 6 + [f"w{i}" for i in range(25)]
    values = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(120)] + ["the of the same row"] * 40
    values += [None, "", "the", "the of", "of the the", "zz only", "the " * 200, "the of " * 90]
    rows = {r.doc_id: r for r in lm_score.scores(texts(values), order=order, crowd=40, passes=2).collect()}
    for i, (n, cuts, score) in enumerate(backoff_scores(values, order)):
        assert (rows[i].n_words, rows[i].n_backoff) == (n, cuts)
        assert rows[i].lm_score is None if score is None else abs(rows[i].lm_score - score) < 1e-9


def test_portions_leave_no_exchange_behind(spark, texts):
    rng = random.Random(6)
    values = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(300)) for _ in range(300)]

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    before = shuffled()
    assert lm_score.scores(texts(values), crowd=5_000).agg({"n_words": "sum"}).first()[0] == sum(len(v.split()) for v in values)
    assert sum(size for name, size in shuffled().items() if name not in before) < 2 * 300 * 300  # 2 bytes a word


def test_equal_high_bits_are_told_apart():
    import numpy as np

    keys = np.array([5, 4, 5, 1 << 40, (1 << 40) + 1, 4, 5, 1 << 40] * 3, np.uint64)
    counts, _ = lm_score._tally(keys)
    assert counts.tolist() == [int((keys == k).sum()) for k in keys]
    assert lm_score._tally(keys, np.full(len(keys), 2))[0].tolist() == (2 * counts).tolist()
    assert [len(x) for x in lm_score._tally(keys[:0])] == [0, 0]
