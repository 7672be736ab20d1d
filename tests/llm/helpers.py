"""Small tables with what real ones have: nulls, blanks, long texts, ties, repeated rows and columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, rule string"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for doc_id, text, *rest in rows:
        lang = rest[0] if rest else "en"
        source = rest[1] if len(rest) > 1 else "src1"
        full.append((doc_id, text, lang, source, None if text is None else len(text), 99, 0.5, "x"))
    return spark.createDataFrame(full, SCHEMA)


def words(seed: int, n: int, vocabulary: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(1000, None), (1001, ""), (1002, "   \n\t"), (1003, "one"), (1004, "One"), (1005, "\u00e9t\u00e9 \U0001f600 \u2581x"), (None, "a b c d e f"), (1006, words(5, 5000)), (1006, words(5, 5000))]
