"""Small tables and comparisons shared by the tests."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """``(doc_id, text[, source])`` rows as a documents table; ``extra`` adds columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        for name in ("n", "h", "hash", "size", "target", "run", "queue", "first", "copies", "block", "key", "line", "word", "score_", "label", "bucket", "at", "df", "n_words"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
