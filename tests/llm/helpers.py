"""Small tables with every awkward case."""

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, "   \t\n ", "de", "b"),
    (6, "eins", "de", "b"),
    (7, "zwei Wörter", "de", None),
    (8, "Déjà vu ½ ÇA — “ok” <|endoftext|> don't 日本語 🙂", "fr", "c"),
    (None, "a row without an id", "en", "a"),
    (9, "wort " * 5000, "de", "c"),
    (9, "wort " * 5000, "de", "c"),
    (10, "!!! 123 ???", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=TEXTS, extra=True):
    """With columns whose names clash with what operators add."""
    df = spark.createDataFrame(rows, SCHEMA)
    if not extra:
        return df
    from pyspark.sql import functions as F

    names = ("n_tokens", "score", "predicted", "fingerprint", "mix_size", "rank", "lang_pred", "fp", "component_id", "key", "stack")
    return df.withColumns({n: F.lit(1) for n in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
