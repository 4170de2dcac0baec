import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small texts with every awkward case: nulls, empties, repeats, ties, clashing extra columns, a long text."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, 1, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, rid int, normal string")

    return make


@pytest.fixture(scope="session")
def awkward():
    return [None, "", "   \n\t ", "The cat", "the CAT", "THE CAT\n", "É é ß", "a b c d e f g h i j k l", "x " * 30000, "wörd" * 5000]
