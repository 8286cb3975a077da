import pytest

LONG = "x" * 50 + " " + "word " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, copies, repeated rows, and columns that clash with the operators' own."""
    rows = [
        (1, "The cat of the house and the dog is in it for that. " * 12, "a", "en", 500),
        (2, "The cat of the house and the dog is in it for that. " * 12, "a", "en", 500),
        (2, "The cat of the house and the dog is in it for that. " * 12, "a", "en", 500),
        (3, None, None, None, None),
        (4, "", "b", "fr", 0),
        (5, " \t\n\x0b\x0c\r ", "b", "fr", 7),
        (None, "Une phrase qui n'a pas d'identifiant mais des mots.", "b", None, 50),
        (6, LONG, None, "en", len(LONG)),
        (7, "é" * 700 + "\n" + "ab" * 600, "c", "de", 1901),
        (8, "one line that is shared by three documents here\nown 8", "c", "en", 10),
        (9, "one line that is shared by three documents here\nown 9", "c", "en", 10),
        (10, "  ONE line that is shared by three documents here \nown 10", "c", "en", 10),
        (11, "Licensed under the Apache License, Version 2.0.", "c", "en", 47),
    ]
    wide = [(*r, b"k", "t", 1, [1], "x", "y") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, lang string, n_chars long, rk binary, tokens string, dk int, found array<int>, queue string, __rk string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest table of documents, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
