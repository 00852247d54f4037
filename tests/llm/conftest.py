import pytest

SF = "/root/testdata/sf0.001"

#: Documents with what a table may hold: nulls in any column, empty, blank and long texts, repeated rows.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    long_text = " ".join(f"w{i % 977} x{i % 61}" for i in range(60_000))
    prose = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "en", None, 5),
        (4, prose, "en", "b", len(prose)),
        (5, prose, "de", "b", len(prose)),
        (5, prose, "de", "b", len(prose)),
        (None, prose, None, None, None),
        (None, "password = 'abcdefghijkl12'", "en", "a", 27),
        (6, long_text, "en", "c", len(long_text)),
        (7, "émoji 🙂 und Straße ZÜRICH \x0b\x0c end nbsp", "de", "c", 30),
        (8, "a|b|c", "xx", "c", 5),
        (9, "12345 67890", "en", "", 11),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("_k", "_t", "hash", "size", "score", "h", "p", "n", "kept", "node", "times", "bucket", "trusted", "once", "_row", "n_lines", "n_removed", "_kept", "_rest", "rest", "text_", "component_id", "n_shingles", "lang_pred", "bits", "matches", "owner", "marks", "mark", "f1", "unit", "target", "whole", "below", "row")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
