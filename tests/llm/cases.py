"""Edge-case documents shared by the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, uid_ long"


def docs(spark, extra=()):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = "the quick brown fox jumps over the lazy dog " * 5000
    rows = [(0, "Hello wide World, this is a small text of some words", "en", "a", 52, 0.5, "x", 1),
            (1, "hello WIDE world, this is a small text of some words", "en", "a", 52, None, "x", 1),
            (2, None, None, None, None, None, None, None), (3, "", "en", "b", 0, 1.0, "", 2), (4, "  \n\t ", "de", "b", 5, 1.0, "", 2),
            (5, long, "en", "b", len(long), 1.0, "", 2), (6, long, "en", "b", len(long), 1.0, "", 3),
            (None, "ein Text ohne Kennung und mit Wörtern", "de", "c", 40, 1.0, "", 4),
            (7, "!!! ... 123 😀 ---", "de", "c", 17, 1.0, "", 4), (8, "mot après mot après mot après mot", "fr", "é", 33, 1.0, "", 4),
            (9, "same row", "en", "a", 8, 1.0, "", 4), (9, "same row", "en", "a", 8, 1.0, "", 4), *extra]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
