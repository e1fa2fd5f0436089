"""Documents that every operator has to take."""

LONG = "lorem ipsum dolor sit amet consectetur " * 3000

ODD = [
    (1, "One two three four five six seven eight nine ten eleven twelve.", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \n\t ", "en"),
    (5, "12345 !!! ---", "en"),
    (6, LONG, "en"),
    (7, "One two three four five six seven eight nine ten eleven twelve.", "en"),
    (7, "One two three four five six seven eight nine ten eleven twelve.", "en"),
    (None, "A text without an id, but with words enough to count as one.", "en"),
    (8, "naïve café – 日本語 🙂 \x00 end\r\nline <|endoftext|> tail", None),
    (9, "x", "fr"),
    (-3, "a" * 5000, "en"),
]

#: Columns whose names clash with what the operators make or use inside.
EXTRA = ("n_tokens", "class_id", "shard", "batch", "node", "words", "matches", "fail_bits")


def frame(spark, rows):
    """Documents (id, text[, lang]) with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, *["x"] * len(EXTRA)) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in EXTRA))
