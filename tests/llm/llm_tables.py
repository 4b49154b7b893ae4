"""Small tables of documents."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, score double, blob string, label int"


def make(spark, rows):
    """Documents from (doc_id, text, lang), with columns whose names clash with internal ones."""
    full = [(d, t, lang, "s", None if t is None else len(t), 1, 0.5, "x", None) for d, t, lang in rows]
    return spark.createDataFrame(full, DOCS)
