"""Tables for the tests of the operators."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(["ba", "ko", "li", "mu", "re", "to", "sa", "ni", "é", "de"], k=rng.randint(1, 4))) for _ in range(n)]


def sample(n: int = 120, seed: int = 1) -> list[tuple]:
    """Documents with exact copies, near copies, shared passages, blanks, nulls and ties."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.3:
            w = (rng.choice(rows)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind < 0.45:
            text = " ".join(words(rng, 40) + passage + words(rng, 20))
        elif kind < 0.5:
            text = rng.choice(["", "  \n", None, "one", "two words", "\x0b\t three  words here"])
        else:
            text = " ".join(words(rng, rng.choice([5, 30, 80, 150])))
            if rng.random() < 0.3:
                text = text.replace(" ", "\n", 3)
        rows.append((i, text, rng.choice(["aa", "bb", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), len(text or "")))
    return rows


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 700}" for k in range(30000))
    return [
        (None, None, None, None, None), (1, None, "aa", "s0", None), (2, "", "aa", "s0", 0), (3, " \t\n", None, None, 3), (4, long, "bb", "s1", len(long)), (5, long, "bb", "s1", len(long)),
        (6, "same words in a text", "aa", "s0", 5), (6, "same words in a text", "aa", "s0", 5), (6, "same words in a text", "aa", "s0", 5), (None, "same words  in a text", None, "s2", 1), (7, "ΑΒΓ ДЕЖ 語文 é x", "aa", "s0", 3),
    ]


#: Columns that the operators use themselves under these names.
CLASHES = ["_rid", "_file", "_row", "digest", "kept", "size", "key", "fp", "k", "id", "n", "rep", "_s", "_f", "_host", "copies", "target", "chunk", "pack", "cluster", "_spots", "_id", "len", "label", "_cell", "shard", "slot"]


def clashing(df):
    """df with columns of all these names."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


def write(spark, path, rows, columns=COLUMNS, extra=False):
    """A folder with documents.parquet."""
    df = spark.createDataFrame(rows, columns)
    (clashing(df) if extra else df).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)
