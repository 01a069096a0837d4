import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeats within a text, nulls, empties, white space and one long text."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "Ωmega", "the", "of", "a", "Straße", "日本", "x1", "q", "ten", "eleven", "twelve"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60), text(45)]
    out: list[str | None] = []
    for i in range(40):
        out.append("\n".join(text(rng.randint(3, 40)) for _ in range(rng.randint(1, 4))))
    out += [out[3], out[3], out[3], out[4] + " tail words here", out[5].replace("alpha", "beta", 1)]
    out += [text(30) + " " + shared[0] + " " + text(20), shared[0] + "\n" + text(25), text(9) + "\t" + shared[1] + " " + text(4), shared[1], shared[1] + " " + shared[1]]
    long = [text(12) for _ in range(150)]
    out.append(" ".join(long + long[20:60]))
    near = text(200).split()
    for i in range(6):
        copy = list(near)
        copy[10 + 30 * i] = "changed"
        out.append(" ".join(copy))
    out += [None, "", " ", "\n\n", "one", "one two", "one two three", "one two three", "a" * 900, "ab " * 400, "\x00\x00" * 150, " lead", "trail "]
    return out
