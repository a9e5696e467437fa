"""Small document tables with the awkward cases every operator has to take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, kept int, n int"


def documents(spark, texts, start=0):
    """One row per text; the extra columns bear names that operators use inside."""
    rows = [(start + i, t, "en", "src0", len(t) if t is not None else None, "r", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
AWKWARD = [None, "", "   \n\t ", "one", "a b c d e f g h", "a b c d e f g h", LONG, "ÀÉ ß 漢字 😀 \x00 end", "\n\n\n"]
