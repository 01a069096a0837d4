import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from gatelake.llm import divergence
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "text")])
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        tf = defaultdict(Counter)
        for _, source, ws in own:
            tf[source].update(w for w in ws if w in kept)
        every = sum(tf.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(c) for s, c in tf.items()}, share(every)
        for s in p:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in p if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if tf[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(items)[:most], 1)}
    return out


def audited(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS doc_id", "1 AS n", "2 AS total", "3 AS chunk", "4 AS value").repartition(3)
    got = [tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def some(seed, n=250, sources=9):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "Éa", "日本", "zz", "Q", "É", "ﬀ", "𐀀") for b in "abcdefghij"] + [chr(0xE000), chr(0x10000)]
    rows = []
    for _ in range(n):
        source = rng.randrange(sources) if rng.random() < 0.6 else 0
        words = rng.choices(vocabulary[source:], k=rng.randint(0, 60))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([f"s{source}", f"S{source}"]), rng.choice([" ", "1", "_", "\n"]).join(words)))
    return [*rows, rows[0], rows[0], ("xx", "a", None), ("xx", "b", "once only"), ("yy", None, ""), (None, None, None), ("en", "silent", "12 34")]


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"chunk": 7, "block": 2}), (3, {"least": 1, "top": 3, "chunk": 1}), (4, {"block": 4, "least": 30})])
def test_equals_brute_force(spark, seed, how):
    rows = some(seed)
    assert audited(spark, rows, **how) == brute(rows, **{k: v for k, v in how.items() if k in ("least", "top")})


def test_empty_and_long(spark):
    assert audited(spark, []) == set()
    rows = [("en", "a", "word " * 1_000_000 + "x" * 500_000), ("en", "b", "word other"), ("en", "b", "word"), ("en", "b", "other Other"), ("en", "c", "other")]
    assert audited(spark, rows) == brute(rows)


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 5, 10**15, 9 * 10**15], np.int64)
    total = np.array([10**16, 7, 10**16 + 3, 9 * 10**15 + 1], np.int64)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)]
