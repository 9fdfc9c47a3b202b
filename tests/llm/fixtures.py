"""Odd tables that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t\n ", "en", "a", 5),
    (4, "one", "en", None, 3),
    (5, LONG, "en", "a", len(LONG)),
    (6, "Ünï çödé " * 30, "fr", "b", 270),
    (6, "Ünï çödé " * 30, "fr", "b", 270),
    (None, "a row without an id " * 10, "en", "b", 200),
    (8, "x" * 5000, "en", "c", 5000),
    (9, "line one is here\nline two is here\n" * 20, "en", "c", 660),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
