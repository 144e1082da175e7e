"""Small inputs of the tests in this folder."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, score int, part string"


def documents(spark, texts, langs=None):
    """Documents with columns whose names clash with what operators use inside; ``texts``: (id, text) pairs."""
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "s", None if t is None else len(t), "x", 1, "p") for (i, t), g in zip(texts, langs)]
    return spark.createDataFrame(rows, DOCS)


def plain(df, *columns):
    """Rows as sorted tuples of the named columns."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=str)
