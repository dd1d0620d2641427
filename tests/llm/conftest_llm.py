"""Helpers of these tests."""


def documents(spark, rows):
    """documents with a clashing extra column."""
    full = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("key", "spans", "start", "size", "node", "n_words", "kept", "g")})
