"""Hand-made documents for the edge cases."""

# one row each: plain, null text, empty, blanks, null everything, repeated twice, odd letters, long word
EDGE_ROWS = [
    (1, "The cat sat on the mat, and the dog sat on the log.\nSecond line here.", "en", "a", 60),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "de", "b", 4),
    (None, None, None, None, None),
    (5, "Same text twice over, word for word the same.", "en", "a", 40),
    (5, "Same text twice over, word for word the same.", "en", "a", 40),
    (6, "Grüße \U0001F600 Ωmega ſ K İ \x00 end", "de", "b", 20),
    (7, "w" * 5000 + " " + "ab " * 3000, "en", "b", 14000),
    (None, "a text without id", "en", "a", 17),
]
