"""Rows that try the operators' defined results."""

SF001 = "/root/testdata/sf0.001"

#: Null, empty, blank, tied, repeated and long rows, and a column whose name operators use inside.
ROWS = [
    (1, None, "en", "a", 1), (2, "", "en", "a", 2), (3, "   \n\t ", None, None, 3),
    (4, "One two three four five six seven eight.", "en", "b", 4), (5, "One two three four five six seven eight.", "en", "b", 5),
    (6, "one two three four five six seven Eight.", "en", None, 6), (7, "Äpfel und Öl für die Straße", "de", "c", 7),
    (8, "word " * 3000, "en", "c", 8), (8, "word " * 3000, "en", "c", 8), (9, "1234 5678 !!!", None, "a", 9),
    (10, "Under the MIT  License, and the mitt license; CC-BY and gnu general publik license.", "en", "a", 10),
    (11, "x" * 9000, "en", "a", 11), (12, "x" * 9000 + "y", "en", "a", 12),
]
