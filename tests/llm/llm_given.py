"""The small tables, and texts out of the ordinary."""

SMALL = "/root/testdata/sf0.001"

ODD_TEXTS = [
    (1, "the same words here, again and again, until there are more than thirteen of them in a row"),
    (2, "the same words here, again and again, until there are more than thirteen of them in a row"),
    (3, "Before. the same words here, again and again, until there are more than thirteen of them in a row, and after"),
    (4, ""),
    (5, None),
    (6, "  \t\n "),
    (7, "x"),
    (8, "1234 5678 !!! ???"),
    (9, "word " * 3000),
    (10, "é" * 2000 + " 日本語 🙂 \x1c\x85 tail"),
    (11, "two\nlines\n\nand a gap"),
    (11, "another row of that id"),
    (2, "the same words here, again and again, until there are more than thirteen of them in a row"),
    (None, "a row without an id"),
    (None, None),
]
