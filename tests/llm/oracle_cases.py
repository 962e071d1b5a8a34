"""Awkward rows that every operator on documents is tried with."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, text_sha256 string"

LONG = " ".join(f"word{i % 977} and{i}" for i in range(20_000))


def awkward():
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names of result columns."""
    texts = [
        (5, "the same text here"),
        (1, "the same text here"),
        (9, "the same text here"),
        (9, "the same text here"),
        (None, "the same text here"),
        (2, ""),
        (3, None),
        (4, "   \n\t "),
        (6, LONG),
        (7, LONG + " more"),
        (8, "Ünï côdé — 中文 😀 é ﬁ   İ ß ǅ"),
        (10, "one <|endoftext|> two <s> </s> <|startoftext|> <unk> three"),
        (11, "x"),
        (12, "a b c d"),
        (13, "a b c d e"),
        (13, "another text of one id"),
        (None, None),
    ]
    return [(i, t, None if i == 1 else "en", None, len(t) if t else None, "s", None) for i, t in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
