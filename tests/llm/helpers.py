"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "one"),
    (7, "The Quick brown fox jumps over the lazy dog"),
    (7, "The Quick brown fox jumps over the lazy dog"),
    (None, "no id"),
    (9, "long " * 30_000),
    (10, "x" * 50_000),
    (11, "naïve café \U0001f600 'll don't  two  spaces\n\n end "),
]


def odd_documents(spark, rows=ODD_TEXTS):
    """Extra columns carry names that operators might use themselves."""
    table = [(i, t, "kept", 1, "hash") for i, t in rows]
    return spark.createDataFrame(table, "doc_id long, text string, kept string, n long, bucket string")


def texts(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
