"""Small hand-made tables with the awkward cases, and plain-Python readings of texts."""

import random
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(seed, n):
    r = random.Random(seed)
    syllables = "ka lo mi ren tas vo shi du per nal ge tor".split()
    out = []
    for i in range(n):
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
        out.append(w.capitalize() + "." if i % 11 == 10 else w + "," if i % 7 == 6 else w)
    return " ".join(out)


#: doc_id, text, lang, source: nulls in every column, empty and blank texts,
#: repeated rows, rows that share an id, ties, a very long text, non-ASCII.
ROWS = [
    (0, prose(0, 300), "en", "a"), (1, prose(1, 300), "en", "a"), (2, prose(0, 300), "en", "b"),
    (3, None, "en", "a"), (4, "", "en", "a"), (5, " \t\n ", None, None), (None, prose(5, 60), "de", None),
    (None, None, None, None), (6, "one", "en", "a"), (7, "one two", "en", "a"), (7, "one two", "en", "a"),
    (8, prose(8, 90), "en", "a"), (8, prose(9, 90), "en", "a"), (9, "Ünïcode ñandú 日本 " * 40, "es", "c"),
    (10, prose(10, 40_000), "en", "a"), (11, "same " * 500, "en", "b"), (12, prose(12, 100) + "\n" + prose(0, 200), "en", "a"),
    (13, "\n".join([prose(13, 12)] * 30), "en", "a"), (14, "a### b$$$ c%%% " * 60, "en", "a"),
    (15, prose(15, 120) + " € \x0b\x0c\r tail", "fr", "a"), (16, "x" * 5000, "en", "a"),
]
#: Columns whose names the operators use inside.
EXTRA = ["n_words", "score", "fp", "tokens", "codes", "tag", "rate", "slot", "g", "h", "t", "_id", "component_id", "n", "spans"]


def documents(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
