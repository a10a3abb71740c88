"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept boolean, host string, src string, counts int"
LONG = "lorem ipsum dolor " * 6000 + "x" * 120_000 + " 1" * 9000 + "7" * 30_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", len(LONG)),
    (4, " \t\n\x0b\x0c\r ", "fr", "b", 7),
    (5, "one two three", "en", "a", 13),
    (5, "one two three", "en", "a", 13),
    (None, "one two three", None, "b", 13),
    (6, "é" * 300 + " größer 😀 naïve", "de", "", 316),
]


def edge_docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "r", True, "h", "s", 1) for r in rows], DOCS)
