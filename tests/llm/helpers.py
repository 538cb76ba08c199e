"""Frames that every operator has to bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int = 120) -> str:
    """Words that do not repeat between seeds."""
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 99991}" for k in range(n))


def docs(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]]); extra adds columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for k, name in enumerate(("rank", "id", "key", "text_", "row_", "words", "block", "slot_", "score", "file_")):
            df = df.withColumn(name, df.doc_id * 0 + k)
    return df


#: Null and empty texts, blanks, marks alone, one word, a very long text, repeated rows, a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ---"), (5, "word"), (6, prose(6, 30000)), (7, prose(7)), (7, prose(7)), (8, prose(7)), (None, prose(9)), (10, prose(10), None, None)]
