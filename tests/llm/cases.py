"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def prose(r: random.Random, n: int) -> str:
    words = ["the", "of", "and", "river", "stone", "light", "moves", "under", "old", "green", "hill", "walks", "seven", "quiet", "birds", "carry", "songs", "home"]
    return " ".join(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.4 else "") for _ in range(n)) + "."


def documents(spark, clashing: bool = True):
    r = random.Random(1)
    one, two = prose(r, 120), prose(r, 80)
    texts = [one, one, two, one.replace("river", "RIVER", 1), None, "", "  \n ", "word", "three short words", LONG, "é́ ß İ 😀 </s> <|endoftext|>", prose(r, 300), two + "\n" + two]
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate(zip(texts, ["a", "b", None, "a", "b", "c", None, "a", "a", "a", "é", "c", "b"], strict=True))]
    rows.append(rows[11])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        from pyspark.sql import functions as F

        for c in ("row", "kept", "counts", "made", "at", "size", "digest", "id", "seed", "host", "best", "slice", "key"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def empty(spark):
    return documents(spark, False).limit(0)
