"""Small documents tables for the tests of this folder."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table from (doc_id, text[, lang[, source]]) rows."""
    full = [(*r, *("en", "s0")[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOC)
