import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_helpers import prose  # noqa: E402

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, hashes string, v string, key string, node string, e string, lines string, gone string, task string, rank string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, ties and repeated rows, columns whose names the operators use inside."""
    long_text = prose(99, 30_000)
    rows = [(1, prose(1, 200)), (2, prose(1, 200)), (3, None), (4, ""), (5, "  \n\t "), (6, long_text), (7, prose(7, 50)), (7, prose(7, 50)), (7, "other text of the same id"), (None, prose(8, 60)), (None, None), (9, "é ß Σ 字 <|endoftext|> x"), (10, "12 34 !!")]
    extra = ("x",) * 9
    return spark.createDataFrame([(i, t, "en", "s", 0, *extra) for i, t in rows], ODD)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
