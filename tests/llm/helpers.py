"""Rows that every operator must bear, and frames of documents with clashing further columns."""

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "The quick brown fox, élan vital. " * 3000
ODD = [None, "", " ", "\n\n", "a", "a  b   c ", "x\0y z", " lead", "trail \n", "tab\tand\x0bvt", "naïve café — ß\n\n\nend", "<|endoftext|> in text", LONG, LONG, "same text here", "same text here"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], SCHEMA)


def clashing(df):
    """Further columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    for c in ("rank", "size", "shard", "bucket", "piece", "start", "length", "task", "key", "h", "sid", "n", "kind", "words", "item_id", "failures", "spans", "count", "path", "part"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df
