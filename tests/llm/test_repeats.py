import hashlib
from collections import Counter

import numpy as np
import pytest
from gatelake.llm import repeats, substring_dedup, suffix_dedup

from .conftest import documents


def covered(n, hits, size):
    out = np.zeros(n, bool)
    for h in hits:
        out[h : h + size] = True
    return out


def judged(units_by_doc, size, keep_first):
    """Which units of each document go, by brute force."""
    where = Counter(tuple(u[j : j + size]) for u in units_by_doc for j in range(len(u) - size + 1))
    seen, out = set(), []
    for u in units_by_doc:
        hits = []
        for j in range(len(u) - size + 1):
            key = tuple(u[j : j + size])
            if (key in seen) if keep_first else where[key] > 1:
                hits.append(j)
            seen.add(key)
        out.append(covered(len(u), hits, size))
    return out


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize(("size", "gram", "most"), [(40, 16, 20_000), (40, 16, 1), (25, 25, 20_000)])
def test_bytes(spark, corpus, size, gram, most, keep_first):
    raw = [(t or "").encode() for t in corpus]
    got = suffix_dedup.remove_repeats(documents(spark, corpus), length=size, gram=gram, keep_first=keep_first, most=most, with_text=True).toPandas().set_index("doc_id")
    assert len(got) == len(corpus)
    for i, gone in enumerate(judged(raw, size, keep_first)):
        kept = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)
        r = got.loc[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256, bytes(r.kept)) == (len(raw[i]), gone.sum(), hashlib.sha256(kept).hexdigest(), kept), i
        assert r.n_spans == np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1) == len(r.spans)


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize(("size", "gram", "most"), [(20, 8, 200_000), (12, 4, 1), (5, 5, 200_000), (3, 1, 200_000)])
def test_words(spark, corpus, size, gram, most, keep_first):
    words = [(t or "").encode().split() for t in corpus]
    got = substring_dedup.remove_repeats(documents(spark, corpus), length=size, gram=gram, keep_first=keep_first, most=most, with_text=True).toPandas().set_index("doc_id")
    for i, gone in enumerate(judged(words, size, keep_first)):
        kept = b" ".join(w for w, g in zip(words[i], gone, strict=True) if not g)
        r = got.loc[i]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (len(words[i]), gone.sum(), hashlib.sha256(kept).hexdigest(), kept.decode()), i


@pytest.mark.parametrize(("size", "gram"), [(1100, 16), (2100, 64), (5000, 16), (5000, 4000)])
@pytest.mark.parametrize("keep_first", [True, False])
def test_long_windows(spark, size, gram, keep_first):
    """Windows wider than any field of a packed run once was; runs of many windows, too."""
    rng = np.random.default_rng(1)
    shared, other = (bytes(rng.integers(97, 123, 9000, dtype=np.uint8)) for _ in range(2))
    raw = [shared, b"x" * 300 + shared[:6200] + b"y", other + shared[100:5400], other[:5001] + other[:5000], b"z" * 7000, shared[1:6000]]
    got = suffix_dedup.remove_repeats(documents(spark, [r.decode() for r in raw]), length=size, gram=gram, keep_first=keep_first, with_text=True).toPandas().set_index("doc_id")
    for i, gone in enumerate(judged(raw, size, keep_first)):
        assert (got.loc[i].n_removed, bytes(got.loc[i].kept)) == (gone.sum(), bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)), i
    words = [r.replace(b"a", b" ").replace(b"e", b" ").split() for r in raw[:2] + [raw[5]]]
    texts = [" ".join(f"{w.decode()}{j}" for j, w in enumerate(ws * 9)) for ws in words]
    texts[2] = texts[0][500:]
    got = substring_dedup.remove_repeats(documents(spark, texts), length=size, gram=min(gram, 64), keep_first=keep_first).toPandas().set_index("doc_id")
    for i, gone in enumerate(judged([t.split() for t in texts], size, keep_first)):
        assert got.loc[i].n_removed == gone.sum(), i


def test_windows_that_are_too_wide_are_an_error(spark):
    with pytest.raises(ValueError, match="windows have"):
        suffix_dedup.remove_repeats(documents(spark, ["a"]), length=20_000)


def test_rows_that_share_an_id_stand_for_themselves(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = documents(spark, [text, text, "other " + text, None, None], [4, 4, 4, None, 9])
    got = substring_dedup.remove_repeats(docs.selectExpr("*", "1 AS did", "'x' AS spans", "2 AS h")).toPandas()
    assert sorted(got.n_removed) == [0, 0, 0, 30, 30] and got.doc_id.isna().sum() == 1


@pytest.mark.parametrize("f", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats])
def test_empty_table(spark, f):
    assert f(documents(spark, [])).count() == 0


def test_long_documents_are_cut_into_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    kind = repeats.Kind("byte", 30, 10, True)
    whole = {(int(s) + j, int(s + a)) for _, s, n, a, _, _ in zip(*repeats.runs(*kind.values(data, np.array([0, 5000])), kind), strict=True) for j in range(n)}
    monkeypatch.setattr(repeats.hashing, "GROUP", 700)
    pieces = set()
    for got in repeats.document_runs(*kind.values(data, np.array([0, 5000])), kind):
        pieces |= {(int(s) + j, int(s + a)) for _, s, n, a, _, _ in zip(*got, strict=True) for j in range(n)}
    assert pieces == whole and {s for s, _ in whole} == set(range(5000 - 29))


def test_longest_previous_factor():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = rng.integers(97, 99, 60).astype(np.uint8)
        at, depth = np.arange(40), 20
        order, shared = suffix_dedup.suffix_order(text, at, depth)
        length, source = suffix_dedup.longest_previous_factor(order, shared, at)
        for i in range(40):
            best = max((next((k for k in range(depth) if text[i + k] != text[j + k]), depth) for j in range(i)), default=0)
            assert length[i] == best
            if best:
                assert source[i] < i and (text[source[i] : source[i] + best] == text[i : i + best]).all()
