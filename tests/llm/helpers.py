"""Small tables with what can go wrong in them."""

from pyspark.sql import functions as F

TEXTS = [None, "", " \n\t ", "word", "Ça va", "!!! 123", "a b", "a b", "x " * 30_000, "ü" * 5000, "\x00\x0b", "the cat sat on the mat and then it went away again"]


def odd_documents(spark):
    """Documents with nulls in any column, repeated rows, and columns that clash with results."""
    rows = [(i, t, [None, "en", "de"][i % 3], None if i % 2 else "s", 1, 5.0, "x", 7) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s", 1, 5.0, "x", 7), (3, "word", "en", "s", 1, 5.0, "x", 7), (3, "word", "en", "s", 1, 5.0, "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, rep string, n long")


def empty(df):
    return df.where(F.lit(False))


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
