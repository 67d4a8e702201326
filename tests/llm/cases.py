"""A small awkward table: null and empty texts, repeated rows and ids, null ids, a very long text, and columns with names that operators use themselves."""

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "the quick  brown\tfox jumps over the lazy dog and runs away", "en", "a"),
    (2, "the quick  brown\tfox jumps over the lazy dog and runs away", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \n\t", "fr", None),
    (None, "le chat est sur la table et il dort bien dans la maison", "fr", None),
    (6, "le chat est sur la table et il dort bien dans la maison", "fr", "c"),
    (7, LONG, "en", "c"),
    (8, "12345 67890 !!", "de", "c"),
    (9, "ünïcödé çà et là, naïve façade coöperate", "fr", "a"),
    (7, "another text with the same id as the long one", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, row_id string, digest int, kept string, times int, rejected string, score string, copy int"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", "w", 3) for r in rows], SCHEMA)
