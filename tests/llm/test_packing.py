import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from gatelake.llm import packing

from .conftest import documents

P = pytest.importorskip("public_tokenizers")


def test_tree_finds_the_tightest():
    rng = random.Random(1)
    tree, on = packing.TightestFit(100), set()
    for _ in range(2000):
        at = rng.randint(0, 100)
        tree.set(at, new := at not in on)
        on ^= {at}
        least = rng.randint(0, 100)
        assert tree.first(least) == min((x for x in on if x >= least), default=None), new


def brute(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= n]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(20))
def test_runs_pack_as_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 300))]
    hist = {n: lengths.count(n) for n in set(lengths)}
    rows = packing.best_fit_decreasing(hist, 50)
    used, places = {}, {}
    for length, rank, n, first, each, offset in rows.tolist():
        for r in range(n):
            b, o = first + r // each, offset + r % each * length
            assert used.get(b, 0) == o  # gapless, in this order
            used[b] = o + length
        places[length] = places.get(length, 0) + n
    assert places == hist
    assert sorted(50 - x for x in used.values()) == brute(lengths, 50)


def test_encoder_equals_the_tokenizer(corpus):
    e = packing.Encoder(Path(P.path("byte_bpe_50k.json")).read_text())
    rng = random.Random(2)
    parts = ["a", "b", " ", "\n", "it's", "'ll", "1", "é", "\t", "  ", "?!", " ", "<|endoftext|>", "日本", "\r\n", ".", "x"]
    texts = [t for t in corpus if t] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(5000)]
    assert e.kept is not None
    for t in texts:
        assert e(t) == e.direct(t), repr(t)


def test_pieces(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(documents(spark, corpus), capacity=64, with_ids=True).toPandas()
    for i, text in enumerate(corpus):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == i].sort_values("piece")
        assert [x for p in own.ids for x in p] == ids
        assert list(own.piece) == list(range(len(own))) and list(own.start) == list(np.cumsum([0, *own.length[:-1]]))
        assert all(own.length[1:] == 64) and own.length.iloc[0] == (len(ids) - 1) % 64 + 1
        assert list(own.ids_crc32) == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own.ids]
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in by:
        assert list(g.offset) == list(np.cumsum([0, *g.length[:-1]])) and g.length.sum() <= 64
    assert by.ngroups == len(brute(list(got.length), 64))


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_repeated_rows_and_other_columns(spark):
    docs = documents(spark, ["one two"] * 3, [7, 7, 8]).selectExpr("*", "1 AS piece", "2 AS length", "3 AS rank", "4 AS task")
    got = packing.pack(docs).toPandas()
    assert sorted(got.doc_id) == [7, 7, 8] and got.ids_crc32.nunique() == 1 and got.sequence_id.nunique() == 1 and got.offset.nunique() == 3
