"""Small document tables with the cases that every operator must survive."""

HARD_TEXTS = [
    None,
    "",
    " ",
    "\n",
    "a",
    "one two\tthree  four\r\nfive",
    "one two three four five",
    "one two three four five",
    "\x00 nul \x1c sign",
    "日本語 のテキスト 😀 é́",
    "▁ marks ▁▁ inside",
    "word " * 6000,
    "x" * 9000,
    "trailing space ",
    "\n\n two\n \nlines \n",
    "a\u3000b\xa0c\u2028d\x85e",
    "don't we'll 12345 $$$ <|endoftext|> <s>",
    "CAPS!! CAPS!! CAPS.\nline two.\nline three.",
]


def hard_docs(spark):
    """Every hard text, twice for one id, a null id, nulls elsewhere, and columns whose names clash."""
    rows = [(k, t, "en" if k % 2 else None, "src", k) for k, t in enumerate(HARD_TEXTS)]
    rows += [(3, HARD_TEXTS[3], None, None, None), (None, "null id", None, None, None), (None, "one two three four five", None, None, 1)]
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, body string, H double")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
