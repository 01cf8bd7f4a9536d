"""Small tables for the corpus operators, with every awkward case."""

import random

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean pines quill river stone thorn umber vales woods yield zebra".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "y", "en"]) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "de", None), (5, long, "en", "a"),
        (6, prose(3, 40), "en", "b"), (6, prose(3, 40), "en", "b"), (6, prose(4, 40), "de", "b"), (None, prose(5, 40), "de", None),
        (None, prose(5, 40), "de", None), (7, "Éa", "fr", "ü"), (8, "x", "fr", "a"), (9, "12 34 !!", "fr", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "doc_id AS size", "text AS score", "lang AS fp", "doc_id AS p", "doc_id AS r", "lang AS root", "lang AS grade")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
