"""Fixture shared by the tests of the training-data operators."""

import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """A documents table of given texts, with columns that operators must leave aside."""
    def build(values, ids=None):
        rows = [(i if ids is None else ids[i], t, None, "s", 0, b"x", "y") for i, t in enumerate(values)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bag binary, spans string")

    return build
