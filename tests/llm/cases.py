"""Awkward documents that every operator has to take."""

AWKWARD = [
    (1, "The quick  brown fox's 12 tricks,\n\n jumped.\t Twice!\n", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "   \n\t ", "en", "a", 3),
    (5, "naïve café été 　  x  y\x85z ΣΑΣ", "fr", "b", 1),
    (6, "a<|endoftext|> b <|startoftext|>c<|endoftext|>", "en", "b", 2),
    (7, "word " * 3000, "en", "c", 15000),
    (8, "don't can't we're 'steak' I'LL\r\nnext\x00 nul\x1f", "en", "c", 7),
    (9, "x" * 5000 + " " + "y" * 70000, "de", "c", 7),
    (10, "The quick  brown fox's 12 tricks,\n\n jumped.\t Twice!\n", "en", "a", 5),
    (10, "The quick  brown fox's 12 tricks,\n\n jumped.\t Twice!\n", "en", "a", 5),
    (None, "no id here at all", "en", "a", 5),
    (11, "日本語のテキスト 한국어 🙂🙂 emoji‍", "ja", "d", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def with_clashes(df):
    """The same rows with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("word", "key", "slice", "entries", "n_tokens", "start", "length", "ids", "score", "kept", "component_id", "labels", "spans", "item_id")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
