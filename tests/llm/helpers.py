"""Small tables with awkward rows."""

LONG = " ".join(f"word{i % 977} of the" for i in range(20_000))
ROWS = [
    (1, "a plain text with some words in it and a few more of them", "en", "s1", 1),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, "   \n\t ", "en", "s1", 6),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "x", "en", "s2", 1),
    (7, "日本語 é ÀÉ 🎉 ünï", "xx", "s3", 3),
    (8, "a plain text with some words in it and a few more of them", "en", "s1", 1),
    (8, "a plain text with some words in it and a few more of them", "en", "s1", 1),
    (None, "no id", "en", None, 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """The same with columns named like the operators' own."""
    from pyspark.sql import functions as F

    extra = ["k", "th", "found", "score", "h", "n", "w", "gone", "quality_score", "spans", "b", "r", "class_id"]
    return awkward(spark).withColumns({c: F.lit(f"own {c}") for c in extra})


def rows_of(df, *order):
    """Rows as tuples, sorted without minding nulls."""
    df = df.select(*order) if order else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
