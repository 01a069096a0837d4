import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from gatelake.llm import line_dedup

from .conftest import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, most, letters="abé日"):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at, r = rng.randrange(len(out) + 1), rng.random()
        if r < 0.34:
            out.insert(at, rng.choice(letters))
        elif out and r < 0.67:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance_and_segments(k):
    rng = random.Random(k)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("ab", k=rng.randint(k + 1, 14)))
        if len(b := edited(rng, a, k + 2, "ab")) > k:
            pairs.append((a, b))
    wide = max(len(x) for p in pairs for x in p)
    a, b = (np.array([[ord(c) for c in p[i].ljust(wide)] for p in pairs], np.uint32) for i in (0, 1))
    got = line_dedup.within(a, np.array([len(p[0]) for p in pairs]), b, np.array([len(p[1]) for p in pairs]), k)
    want = [distance(*p) <= k for p in pairs]
    assert got.tolist() == want
    for (x, y), near in zip(pairs, want, strict=True):
        small, large = sorted((x, y), key=len)
        if near:
            parts = [small[s : s + n] for s, n in line_dedup.segments(len(small), k)]
            assert any(large[s : s + n] == parts[i] for i, s, n in line_dedup.probes(len(large), len(small), k))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_keys_are_those_of_segments_and_probes(k):
    lines = ["".join(random.Random(n).choices("abc", k=n)) for n in range(k + 1, 30)]
    line, key, _ = line_dedup._keys(lines, k)
    for i, x in enumerate(lines):
        n = len(x)
        assert ((line == i) & (key & 1 == 1)).sum() == k + 1
        assert ((line == i) & (key & 2 == 2)).sum() == sum(len(line_dedup.probes(n, of, k)) for of in range(max(n - k, k + 1), n + 1))
        starts, sizes = zip(*(line_dedup._segment(np.array([n]), j, k) for j in range(k + 1)), strict=True)
        assert [(int(a[0]), int(b[0])) for a, b in zip(starts, sizes, strict=True)] == line_dedup.segments(n, k)


def brute(texts, k, least):
    first = {}
    for i, t in enumerate(texts):
        for j, line in enumerate((t or "").split("\n")):
            if line and not line.isspace():
                first.setdefault(line, (i, j))
    lines = [x for x in first if len(x) >= least]
    near = {x for x in lines for y in lines if first[y] < first[x] and abs(len(x) - len(y)) <= k and distance(x, y) <= k}
    out = []
    for i, t in enumerate(texts):
        lines = t.split("\n") if t else []
        kept = [x for j, x in enumerate(lines) if not x or x.isspace() or (first[x] == (i, j) and x not in near)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("tries", "block", "wide"), [(3, 2000, 1024), (1, 3, 2)])
def test_documents(spark, tries, block, wide, monkeypatch):
    monkeypatch.setattr(line_dedup, "TRIES", tries)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    rng = random.Random(11)
    bases = ["".join(rng.choices("abcdé fgh", k=rng.randint(6, 60))) for _ in range(25)]
    texts = ["\n".join(edited(rng, rng.choice(bases), 4) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    texts += [None, "", "\n", " \n\t", "same short", "same short", "x" * 5000, "x" * 4999 + "y", "x" * 4990]
    got = line_dedup.dedup_lines(documents(spark, texts), least_chars=12).toPandas().set_index("doc_id")
    for i, (n, gone, kept) in enumerate(brute(texts, 2, 12)):
        r = got.loc[i]
        assert (r.n_lines, r.n_removed, r.kept, r.kept_sha256) == (n, gone, kept, hashlib.sha256(kept.encode()).hexdigest()), i


def test_odd_tables(spark):
    docs = documents(spark, ["a line that is long enough"] * 3 + [None], [2, 2, 1, None]).selectExpr("*", "1 AS line", "2 AS no", "3 AS did")
    got = line_dedup.dedup_lines(docs).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got.n_removed, strict=True)) == [(-1, 0), (1, 0), (2, 1), (2, 1)]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_long_lines_stop_early():
    """Lines of 200,000 characters: far apart ones are left at once, near ones are compared where they differ."""
    rng = np.random.default_rng(3)
    a = rng.integers(97, 123, 200_000).astype(np.uint32)
    b = rng.integers(97, 123, 200_000).astype(np.uint32)
    c = np.concatenate([a[:50_000], a[50_001:]])
    c[50_020] = 65
    d = c.copy()
    d[50_040] = 65
    start = time.monotonic()
    assert line_dedup.near_pairs([a, b, c, d], np.array([0, 0, 0]), np.array([1, 2, 3]), 2).tolist() == [False, True, False]
    assert time.monotonic() - start < 2


def test_no_rows_for_pairs(spark):
    """A group of lines that share a segment makes rows in proportion to its lines."""
    made = {}
    for n in (400, 1600):
        texts = [f"one common beginning of many lines, then {i * 7919:09d} and {i * 104729:09d}, and one common end" for i in range(n)]
        rows = np.concatenate([line_dedup._keys(texts, 2)[1][None, :], np.repeat([line_dedup.line_hash(x) for x in texts], 1)[line_dedup._keys(texts, 2)[0]][None, :], line_dedup._keys(texts, 2)[2][line_dedup._keys(texts, 2)[0]][None, :]])
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "line", "classes"])
        made[n] = sum(b.num_rows for b in line_dedup._live(2)(iter([batch])))
        assert made[n] <= 2 * n
