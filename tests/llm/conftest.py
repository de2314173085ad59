"""Awkward inputs that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words string, node string, "
        "bucket int, text2 string, `row` int, block int, label int, kept string")


def rows_of(texts):
    return [(i, text, lang, "s", None, 0.5, "x", "y", 1, "z", 2, 3, 4, "k") for i, text, lang in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    long = " ".join(f"word{i % 977} the of" for i in range(20_000))
    prose = "the quick brown fox jumps over the lazy dog and runs away from the big old bear in the dark wood at night"
    texts = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, long, "en"), (5, prose, "en"), (5, prose, "en"), (6, prose.upper(), None),
        (7, prose + " again", "en"), (8, "un deux", "fr"), (9, "Été \U0001f600 naïve\u0085x y", "fr"), (None, prose, "en"), (None, None, None),
        (10, "12 34 !!", "de"), (11, "same line\nsame line\nsame line\nother", "de"), (12, "a", "en"), (13, "A", "en"), (14, prose[:40], "en"),
        (15, "b " * 3000, "de"), (16, "<|endoftext|> it's\x1c x", "en"),
    ]
    return spark.createDataFrame(rows_of(texts), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
