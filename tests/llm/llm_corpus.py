"""Small corpora for the tests: invented prose with copies, edited copies and shared passages, and odd rows."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("key", T.StringType()),  # names that operators use too
])
SYLLABLES = "re th on é ti ou an ß er ing ñ en".split()


def prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(words))


def texts(seed=5, n=40):
    rng = random.Random(seed)
    made = [prose(rng, rng.choice([1, 3, 30, 80, 200])) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 4):
        base = made[rng.randrange(n)].split(" ")
        kind = i % 16
        if kind == 0:
            made[i] = " ".join(base)
        elif kind == 4:
            base[len(base) // 2] = "edited"
            made[i] = " ".join(base)
        else:
            made[i] = prose(rng, 20) + " " + passage + " " + prose(rng, 10)
    return made


ODD = ["", None, " ", "a", "É  double  spaces \t and tabs ", "<|im_end|> <|endoftext|> \\ <\\|x|>", "same same same same same " * 40, "long " + "word" * 20_000, "\0 zero \x1c sign"]


def rows(seed=5, n=40):
    """Ids with gaps in mixed order, odd texts, null sources, and one row that is there three times."""
    found = [(7 * i + 3, t) for i, t in enumerate([*texts(seed, n), *ODD])]
    random.Random(seed).shuffle(found)
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 4}", len(t) if t is not None else None, "x", None, "k") for i, t in found]
    return out


def frame(spark, some):
    return spark.createDataFrame(some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
