"""Small tables with the awkward cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "thing", "ning", "étoile", "ção", "x1", "don't", "it's", "A", "--", "!!", "0", "42", "über", "日本"]


def awkward(seed=0, n=60):
    """Null, empty, blank and very long texts, ties, repeated rows, null ids and columns."""
    rnd = random.Random(seed)
    rows = [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 120))), rnd.choice(["en", "fr", None]), f"src{rnd.randrange(3)}", 0) for k in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, " \n\t ", "en", "src0", 4), (n + 3, "one", "en", "src0", 3), (n + 4, "word " * 30000, "en", "src0", 150000), (n + 5, "z" * 50000, "en", None, 50000)]
    rows += [(n + 6, rows[0][1], "en", "src1", 0), rows[1], rows[1], (None, rows[2][1], "en", "src1", 0), (None, None, None, None, None), (n + 7, "<|endoftext|> a  b c   'S", "en", "src1", 0)]
    return rows


def frame(spark, rows, clash=("score", "gid", "n_tokens", "input_0", "predicted")):
    """The rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for c in clash:
        df = df.withColumn(c, F.lit("kept"))
    return df.repartition(3)
