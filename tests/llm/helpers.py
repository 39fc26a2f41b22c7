"""Small tables with awkward rows, and plain versions of what the operators compute."""

from pyspark.sql import functions as F

CLASHING = ["n", "id", "e", "h", "k", "count", "sig", "raw", "comp", "shard", "size", "cell", "found", "key", "_key", "value", "hit"]


def documents(spark, rows, clash=True):
    """rows: (doc_id, text[, lang[, source]]). With columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)) if clash else df


def table(spark, sf_dir, name, n=None):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if n is None else df.limit(n)


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five"), (6, "One two THREE four five"), (7, "été Été ünï çà 日本語 テキスト"), (8, "a" * 50_000), (9, "word " * 20_000),
    (None, "a row without an id"), (None, None), (10, "same text twice, same id"), (10, "same text twice, same id"), (11, "…!?. ; \x0b\x0c\x1f"), (12, "tab\tvt\x0bff\x0ccr\r\nnl"),
]
