from __future__ import annotations

import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard string, _toxicity int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    long_text = " ".join(f"word{i % 977} thing{i % 13}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, None, None, None, None),
        (2, "", "en", "src0", 0, 0.5, True, "x", 1),
        (3, " \n\t ", "en", None, 3, 0.5, True, "x", 1),
        (None, "a text without an id", "en", "src0", 20, None, None, None, None),
        (4, long_text, "en", "src0", len(long_text), 1.0, False, "y", 2),
        (5, "The same words stand here twice in this little text of ours", "en", "src1", 60, 1.0, False, "y", 2),
        (5, "The same words stand here twice in this little text of ours", "en", "src1", 60, 1.0, False, "y", 2),
        (6, "THE SAME words stand here twice in this little text of ours", "de", "src1", 60, 1.0, False, "y", 2),
        (7, "a<|endoftext|>b \u0000 é ñ 漢字 \U0001f600 don't", "xx", "src99", 20, 1.0, False, "y", 2),
        (8, "one two", "en", "src1", 7, 1.0, False, "y", 2),
        (9, "12345 67890 !!!", "en", "src1", 15, 1.0, False, "y", 2),
    ]
    return spark.createDataFrame(rows, WIDE).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], WIDE)
