import math
import random
from collections import Counter

import numpy as np
import pytest
from gatelake.llm import search

from .conftest import documents


def brute(texts, queries, k):
    bags = [Counter((t or "").encode().lower().split()) for t in texts]
    n, mean = len(texts), sum(sum(b.values()) for b in bags) / len(texts)
    df = Counter(w for b in bags for w in b)
    out = {}
    for q in queries:
        scores = []
        for i, b in enumerate(bags):
            size = sum(b.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in bags[q] if w in b)
            if any(w in b for w in bags[q]):
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("terms", [1_000_000, 60])
def test_top_k(spark, corpus, terms, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", terms)
    rng = random.Random(1)
    texts = corpus + [" ".join(rng.choice(["the", "of", "w1", "w2", "rare"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    asked = list(range(0, len(texts), 3))
    docs = documents(spark, texts)
    got = search.top_k(docs, docs.where(docs.doc_id.isin(asked)).withColumnRenamed("doc_id", "query_id"), k=7).toPandas().sort_values(["query_id", "rank"])
    for q, want in brute(texts, asked, 7).items():
        own = got[got.query_id == q]
        assert list(own["rank"]) == list(range(1, len(want) + 1))
        assert [i for i in own.doc_id] == [i for i, _ in want], q
        assert own.score.tolist() == pytest.approx([s for _, s in want], abs=2e-6)


def shards(bags, size, mean):
    out = []
    for at in range(0, len(bags), size):
        part = bags[at : at + size]
        lengths = np.array([int(c.sum()) for _, c in part])
        out.append(search.Shard(np.arange(at, at + len(part)), np.ones(len(part), bool), lengths, *search.inverted(part), mean))
    return out


@pytest.mark.parametrize(("size", "block", "frequent", "cells", "step"), [(640, 64, 16, 1 << 20, 8), (37, 4, 16, 4000, 2), (100, 8, 2, 0, 1), (100, 8, 10**6, 1 << 20, 3)])
def test_shards_equal_brute_force(size, block, frequent, cells, step, monkeypatch):
    """Whatever of the lists is frequent or rare, and whatever floor a query begins with."""
    for k, v in {"BLOCK": block, "FREQUENT": frequent, "CELLS": cells, "STEP": step}.items():
        monkeypatch.setattr(search, k, v)
    rng = np.random.default_rng(size)
    bags = [np.unique((rng.pareto(0.8, rng.integers(0, 60)) * 20).astype(np.uint64) % 500, return_counts=True) for _ in range(640)]
    bags[600] = bags[7]
    mean = sum(int(c.sum()) for _, c in bags) / len(bags)
    df = Counter(int(x) for t, _ in bags for x in t)
    queries = [(t, np.array([math.log(1 + (640 - df[int(x)] + 0.5) / (df[int(x)] + 0.5)) for x in t])) for t, _ in bags[::9]]
    want = []
    for t, idf in queries:
        weight = dict(zip(t.tolist(), idf.tolist(), strict=True))
        scores = []
        for i, (own, counts) in enumerate(bags):
            if set(own.tolist()) & set(weight):
                scores.append((-round(sum(weight.get(x, 0) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * counts.sum() / mean)) for x, c in zip(own.tolist(), counts.tolist(), strict=True)), 6), i))
        want.append(sorted(scores)[:10])
    have = [[] for _ in queries]
    floors = np.zeros(len(queries))
    for shard in shards(bags, size, mean):
        for q, (ids, scores) in enumerate(shard.search(queries, 10, floors)):
            have[q] = sorted([*have[q], *((-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))])[:10]
            if len(have[q]) == 10:
                floors[q] = -have[q][-1][0]
    for mine, other in zip(have, want, strict=True):
        assert [i for _, i in mine] == [i for _, i in other]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in other], abs=2e-6)


def test_blocks_and_documents_are_skipped():
    """Two documents have the rare terms that the query asks for; all others only a frequent one."""
    rng = np.random.default_rng(0)
    bags = []
    for i in range(6400):
        t = np.unique(np.concatenate([rng.integers(100, 50_000, 20), [1, 2] if i in (5, 69) else [3]])).astype(np.uint64)
        bags.append((t, np.ones(len(t), np.uint32)))
    (shard,) = shards(bags, 6400, 20.0)
    ((ids, _),) = shard.search([(np.array([1, 2, 3], np.uint64), np.array([5.0, 5.0, 0.01]))], 2, np.zeros(1))
    assert list(ids) == [5, 69]
    assert shard.tested == 100 and shard.skipped >= 90
    (shard,) = shards(bags, 6400, 20.0)
    ((ids, _),) = shard.search([(np.array([1, 2, 3], np.uint64), np.array([5.0, 5.0, 0.01]))], 2, np.array([9.0]))
    assert list(ids) == [5, 69] and shard.skipped == 98 and shard.passed == 126
    assert shard.search([(np.array([1, 2, 3], np.uint64), np.array([5.0, 5.0, 0.01]))], 2, np.array([99.0]))[0][0].size == 0 and shard.skipped == 198


def test_documents_alike_share_shards():
    """Two languages in turn: a query of one skips nearly all of the other's documents, and finds what it finds among documents as they come."""
    rng = np.random.default_rng(3)
    bags = []
    for i in range(1200):
        words = (rng.pareto(1.0, rng.integers(20, 60)) * 10).astype(np.uint64) % 300
        bags.append(np.unique(words + np.uint64(1000 * (i % 2)), return_counts=True))
    groups = search.alike(bags)
    assert sorted(np.concatenate(groups).tolist()) == list(range(1200))
    assert all(len(set((g % 2).tolist())) == 1 for g in groups)
    queries = [(bags[i][0], np.ones(len(bags[i][0]))) for i in (0, 1, 500, 801)]
    found, skipped = [], []
    for parts in ([np.arange(i, i + 200) for i in range(0, 1200, 200)], groups):
        have = [[] for _ in queries]
        n = skip = 0
        for part in parts:
            own = [bags[i] for i in part]
            shard = search.Shard(part, np.ones(len(part), bool), np.array([int(c.sum()) for _, c in own]), *search.inverted(own), 40.0)
            for h, (ids, scores) in zip(have, shard.search(search.batched(queries)[0], 10, np.zeros(4)), strict=True):
                h += zip((-scores).tolist(), ids.tolist(), strict=True)
            n, skip = n + shard.tested, skip + shard.skipped
        found.append([sorted(h)[:10] for h in have])
        skipped.append(skip / n)
    assert found[0] == found[1] and skipped[1] >= 0.45 and skipped[0] < 0.1


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(search, "BATCH_TERMS", 10)
    queries = [(np.arange(n, dtype=np.uint64), np.ones(n)) for n in (4, 6, 1, 30, 2, 2)]
    assert [(b.n, len(b.idf)) for b in search.batched(queries)] == [(2, 10), (1, 1), (1, 30), (2, 4)]


def test_odd_tables(spark):
    docs = documents(spark, ["a b", None, "", "a"], [3, 3, None, 3]).selectExpr("*", "1 AS shard", "2 AS terms")
    asked = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in search.top_k(docs, asked).orderBy("rank").collect()] == [(1, 3), (1, 3)]
    assert search.top_k(documents(spark, []), asked).count() == 0
    assert search.top_k(docs, asked.limit(0)).count() == 0
