"""A small documents table with the awkward cases: nulls, empty and very long texts, repeats, clashing extra columns."""

SF = "/root/testdata/sf0.001"

HARD = [
    (None, "a text without an id, mail me.x@y.example.com.", "s", 1),
    (900001, None, None, 2),
    (900002, "", "s", None),
    (900003, " \n\t ", "s", 3),
    (900004, "same row twice here", "s", 4),
    (900004, "same row twice here", "s", 4),
    (900005, "word " * 30000, "s", 5),
    (900006, "1" * 20000 + " " + "a" * 20000 + "@", "s", 6),
    (900007, "İ ſ <|endoftext|> 日本 x́ \x85 y　z  \n q", "s", 7),
]


def hard_docs(spark, with_table=True):
    """The awkward rows (and the small documents table), with an extra column whose name operators use inside."""
    docs = spark.createDataFrame(HARD, "doc_id long, text string, source string, g int")
    if with_table:
        docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source"), allowMissingColumns=True)
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
