"""Rows that every operator must take."""

#: Nulls, empty and long texts, ties, repeated rows, and extra columns that clash with names used inside.
ODD_ROWS = [
    (1, None, "x", 1), (2, "", None, 2), (3, " \n\t ", "x", None), (4, "short words here", "x", 4), (4, "short words here", "x", 4), (None, "no id but some text with several words in it", "x", 5),
    (5, "a" * 5000, "x", 6), (6, "word " * 4000, "x", 7), (7, "line one two three four\n" * 50, "x", 8), (8, "line one two three four\n" * 50, "x", 8), (9, "é\x00ü 日本語 <|endoftext|> end", "x", 9),
]
