"""Small tables with the awkward cases: nulls, blanks, ties, repeated rows, clashing column names, a long text."""

LONG = " ".join(f"word{i % 977} part{i % 13}" for i in range(60_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, id string, row string, "
          "pos int, line string, hash long, size int, shard int, words string, spans string, fp string, bucket int, "
          "`a.b` string, __base string, __lang string, body string, base string, gone string, verdict string")
BASE = ("The quick brown fox jumps over the lazy dog while seven wizards box quietly near the frozen lake and "
        "nobody in the village seems to notice the strange lights that dance above the water every single night "
        "because the baker sings loudly and the children sleep under heavy blankets until the morning sun returns.")


def rows(texts):
    """Rows of (doc_id, text, ...) with every further column filled by something that clashes."""
    return [(i, t, "en" if i is None or i % 2 else None, None if i == 3 else f"src{(i or 0) % 3}", len(t or ""),
             "k", "x", "r", 1, "l", 2, 3, 4, "w", "s", "f", 5, "d", "b", "g", "y", "e", "n", "v") for i, t in texts]


TEXTS = [(1, BASE), (2, BASE), (2, BASE), (None, BASE + " One more line."), (3, None), (4, ""), (5, " \n\t "), (6, "one"),
         (7, "Two words"), (8, "ÉÀ ß 中文 İ Σας ǅ \U0001f600 <|endoftext|> x"), (9, LONG), (10, "a a a a a a"),
         (11, "same line here now\nsame line here now\n\nother"), (12, BASE.replace("seven", "eight"))]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
