"""Odd tables that every operator must take, and plain versions of shared steps."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, `c0` int"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
COPY = " ".join(f"copy{i}" for i in range(60))

ODD_ROWS = [
    (1, "one two three four five six seven", "en", "a", 1, "s", 1),
    (1, "one two three four five six seven", "en", "a", 1, "s", 1),
    (2, "one  two\tthree four\nfive six seven", None, "a", 2, None, None),
    (3, None, "en", None, None, None, None),
    (4, "", None, None, 0, "x", 2),
    (5, " \n\t ", "de", "b", 3, "y", 3),
    (6, COPY, "de", "b", 4, None, 4),
    (7, COPY + " tail", "de", None, 5, None, 5),
    (8, "x" * 300_000 + " end", "fr", "c", 6, None, 6),
    (9, LONG, "fr", "c", 7, None, 7),
    (None, "a text without a key", "en", "a", 8, None, 8),
    (10, "é ü ñ <|endoftext|> 12 ## $5", "es", "d", 9, None, 9),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD_ROWS, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")
