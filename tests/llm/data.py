"""Small document tables with awkward rows."""

import random

from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(rng: random.Random, base: str, edits: int) -> str:
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def awkward(rng: random.Random) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with copies, near copies, nulls, empties and repeated rows."""
    texts = [text(rng, rng.randrange(8, 120)) for _ in range(40)]
    base = text(rng, 100)
    texts += [near(rng, base, k % 4) for k in range(25)] + [texts[3]] * 4 + [texts[5].upper().replace(" ", "\n\t")]
    texts += [None, "", " \n ", "one", "one two three four", "one two three four", "é ñ ü 漢字 ok yes", text(rng, 6000)]
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], rows[-1], (None, texts[3], None, None, 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that operators use inside or add."""
    return df.withColumns({"n": F.lit(1), "key": F.lit("k"), "part": F.lit(2), "token": F.lit(3), "size": F.lit(4), "shard": F.lit(5), "copies": F.lit(6), "score": F.lit(7), "n_lines": F.lit(8), "n_shingles": F.lit(9), "set_key": F.lit(10), "_row": F.lit(11), "_text": F.lit("t"), "_part": F.lit(12)})
