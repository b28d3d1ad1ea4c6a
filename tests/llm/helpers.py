"""Small documents tables with nulls, empties, ties, long texts and clashing columns."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """rows: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def odd_rows():
    long_text = " ".join(f"w{i % 977} x{i % 31}" for i in range(20_000))
    return [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (4, "one"), (5, long_text), (6, long_text), (None, "null id text"), (7, "Ünïcode ß 日本語 text"), (8, "<|endoftext|> a<|endoftext|>")]


CLASH = ["ids", "decoded", "fp", "key", "block", "n_words", "spans", "items", "h", "depth", "shard", "component_id", "score", "n", "a", "b", "u", "v"]


def clashing(df):
    """df with extra columns that have the names operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])
