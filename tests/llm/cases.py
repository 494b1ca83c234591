"""Rows that every operator must take: nulls, empty and very long texts, repeated rows, columns with clashing names."""

import random

from pyspark.sql import functions as F

CLASHING = ["run", "row", "best", "n", "name", "token", "owner", "size", "label", "score", "kept", "digest", "start", "length", "id", "part", "text_hash", "held_out", "head"]


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def documents(seed=7, n=120):
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    passages = [words(rng, 60) for _ in range(3)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            own = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words(rng, 3))
        else:
            own = words(rng, rng.randint(1, 90))
            if kind > 0.7:
                own += rng.choice(passages)
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    rows += [(1000, texts[0]), (1001, texts[0].upper()), (1002, None), (1003, ""), (1004, " \t\n "), (1005, "one two three"), (1006, "one two three")]
    return rows + [(1007, " ".join(words(rng, 30_000))), (1008, "naïve çà 日本語 \U0001f600 text")]


def frame(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def empty(spark):
    return frame(spark, [])
