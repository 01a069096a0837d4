import random

import numpy as np
import pytest
from gatelake.llm import components, ngram_join
from gatelake.llm.hashing import U

from .conftest import documents


def sets_of(texts, k=4):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(sets, num=85, den=100):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def many(rng, families, copies):
    words = [f"v{i}" for i in range(40)]
    out = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, copies)):
            c = list(base)
            for _ in range(rng.randint(0, 4)):
                r = rng.random()
                at = rng.randrange(len(c) + 1)
                if r < 0.5 and c:
                    c[min(at, len(c) - 1)] = rng.choice(words)
                elif r < 0.75:
                    c.insert(at, rng.choice(words))
                elif len(c) > 1:
                    c.pop(min(at, len(c) - 1))
            out.append(" ".join(c))
    return out


@pytest.mark.parametrize("block", [3000, 5])
def test_components(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = corpus + many(random.Random(4), 40, 12)
    got = ngram_join.join_components(documents(spark, texts)).toPandas().set_index("doc_id")
    sets = sets_of(texts)
    assert [got.n_shingles[i] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got.component_id[i] for i in range(len(texts))] == brute(sets)


def test_signatures_of_linked_sets_meet():
    rng, sign = np.random.default_rng(1), ngram_join.Signatures()
    for n in [6, 7, 8, 12, 15, 16, 17, 31, 33, 63, 64, 70, 127, 129, 300]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(U))
            drop, add = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 6 + 2))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, add, dtype=np.int64).view(U)]))
            if ngram_join.links(len(a), len(b), len(np.intersect1d(a, b))) and len(a) != len(np.intersect1d(a, b)):
                assert len(np.intersect1d(sign(a), sign(b))), (len(a), len(b))


def test_divide_skip_finds_all_links():
    rng = random.Random(7)
    texts = many(rng, 30, 15)
    sets = [np.array(sorted(hash(x) & ((1 << 63) - 1) for x in s), dtype=U) for s in sets_of(texts)]
    sets = [np.unique(s) for s in sets if len(s)]
    edges = ngram_join.divide_skip(sets, np.arange(len(sets)))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert ngram_join.links(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(sets))] == brute([set(s.tolist()) for s in sets])


def test_contraction(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, x) for x in range(201, 230)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_and_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = ngram_join.join_components(documents(spark, [text, text, "else where is that", None, ""], [5, 5, 5, 5, 6]).selectExpr("*", "1 AS cls", "2 AS n")).toPandas()
    assert sorted(got.n_shingles) == [0, 0, 1, 27, 27] and sorted(got.component_id) == [5, 5, 5, 5, 6]
    assert ngram_join.join_components(documents(spark, [])).count() == 0


def test_rows_without_an_id(spark):
    """They link like others; a component's id is the smallest one that a row has, and null if none has any."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = [*a[:50], "changed", *a[51:]]
    texts = [" ".join(x) for x in (a, near, b, b, [*b, "tail"])]
    got = ngram_join.join_components(documents(spark, texts, [None, 7, None, None, None])).toPandas()
    assert sorted(zip(got.n_shingles, got.component_id.fillna(-1), strict=True)) == [(57, -1), (57, -1), (57, 7), (57, 7), (58, -1)]


def test_large_groups_in_blocks(spark, monkeypatch):
    """One group of near copies over several stars and blocks."""
    monkeypatch.setattr(ngram_join, "STAR", 7)
    monkeypatch.setattr(ngram_join, "BLOCK", 9)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        c = list(base)
        for _ in range(rng.randint(0, 3)):
            c[rng.randrange(120)] = f"x{rng.randrange(200)}"
        texts.append(" ".join(c))
    got = ngram_join.join_components(documents(spark, texts)).toPandas().set_index("doc_id")
    assert [got.component_id[i] for i in range(90)] == brute(sets_of(texts))
