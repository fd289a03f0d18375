"""Awkward texts that every operator has to survive, and reading helpers."""

import random

from pyspark.sql import Row
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(vocabulary):x}e" for _ in range(n)]
    return "".join(w + (".\n" if rng.random() < 0.06 else " ") for w in words).rstrip(" ")


def awkward() -> list[str | None]:
    """Nulls, empty and very long texts, repeats, near copies, odd characters."""
    base = prose(160, 1)
    words = base.split(" ")
    near = " ".join([*words[:80], "changed", *words[81:]])
    shared = prose(70, 2)
    return [
        None, "", " \t\n\x0b\x0c\r ", "a", "É", base, base, near, base + " tail", "x" * 3000, "ab " * 900,
        prose(6000, 3), prose(30, 4) + " " + shared + " " + prose(40, 5), shared, prose(9, 6) + shared,
        "Ünï çödé 日本語   nb sp " * 12, "\n\n\n", "one two three four", "One TWO three FOUR",
        base.upper(), "퟿ \U0001f600 " * 30, None, "aaaa bbbb " * 40, "\x00 zero \x00 byte " * 8,
    ]


def documents(spark, texts, ids=None, partitions=3):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(partitions)


def clashing(df, *names):
    """The same rows with extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})


def by_id(df, key="doc_id") -> dict[int, Row]:
    return {r[key]: r for r in df.collect()}
