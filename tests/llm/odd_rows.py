"""Awkward documents that every text operator has to take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


def rows():
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from the old farm by the river bank today"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from the old farm by the river bank today"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "é😀 ça va\x00 bien \x85 a\xa0b"),
        (7, LONG),
        (None, "a row without an id"),
        (8, "same row twice"),
        (8, "same row twice"),
        (9, "x" * 50_000),
        (10, "</s>[INST] \\ [/INST]"),
    ]
    return [(i, t, "en", None, None if t is None else len(t)) for i, t in texts]


def documents(spark):
    """With extra columns whose names the operators use themselves."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    clash = ("score", "kept", "words", "key", "node", "block", "tail", "term", "terms", "n", "bands", "fingerprint", "length", "shard", "train", "label", "label_id", "good", "failed", "fp", "frames")
    return docs.select("*", *[F.lit("x").alias(c) for c in clash])


def nothing(spark):
    return documents(spark).limit(0)
