import corpus_pipeline
import pytest
from gatelake.llm import catalog, packing

from .conftest import documents
from .test_decontam import brute as contaminated
from .test_line_dedup import brute as lines
from .test_ngram_join import brute as components
from .test_ngram_join import sets_of


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5 and set(catalog.QUERIES) >= {f"op{n}_" + x for n, x in [(1, "search"), (2, "warc"), (3, "suffix_dedup"), (4, "decontamination"), (5, "packing"), (6, "substring_dedup"), (7, "language_id"), (8, "line_dedup"), (9, "pii"), (10, "ngram_join")]}


def test_run_equals_brute_force(spark, sf):
    """The decisions of each stage on the smallest table, each made again from the texts alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = docs.toPandas().sort_values("doc_id")
    told = at["language ID"]
    want = [(i, kept) for i, (_, _, kept) in zip(told.doc_id, lines(list(told.text), 2, 16), strict=True) if kept.strip(" ")]
    have = at["line dedup"]
    assert list(zip(have.doc_id, have.text, strict=True)) == want and (have.n_chars == have.text.str.len()).all()
    roots = components(sets_of(have.text))
    assert list(at["n-gram Jaccard join"].doc_id) == [i for k, i in enumerate(have.doc_id) if roots[k] == k]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    near = at["n-gram Jaccard join"]
    bad = [x[3] for x in contaminated(list(near.text), list(zip(bench.item_id, bench.text, strict=True)), 13)]
    clean = at["benchmark decontamination"]
    assert list(clean.doc_id) == [i for i, b in zip(near.doc_id, bad, strict=True) if not b]
    got, again = (x.select("doc_id", "piece", "length", "ids_crc32").toPandas().sort_values(["doc_id", "piece"]) for x in (corpus_pipeline.run(spark, sf), packing.pack(docs)))
    assert got.values.tolist() == again.values.tolist()


@pytest.mark.parametrize("texts", [[], [None], ["", " "]])
def test_odd_tables(spark, sf, texts):
    docs = documents(spark, texts)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_near_copies_share_four_fifths_of_five_words(spark, sf):
    """Pairs between this stage's limits and op10's, on both sides, against brute force."""
    words = [[f"t{t}w{i}" for i in range(n)] for t, n in enumerate([46, 48, 49, 60, 44])]
    texts = [x for w in words for x in (" ".join(w), " ".join([*w[:20], "changed", *w[21:]]))]
    roots = components(sets_of(texts, 5), 4, 5)
    got = corpus_pipeline.near_copies(spark, documents(spark, texts), sf).toPandas().doc_id
    assert sorted(got) == [i for i in range(len(texts)) if roots[i] == i] != [i for i, r in enumerate(components(sets_of(texts))) if r == i]


def test_null_and_repeated_ids(spark, sf):
    """Rows that share an id, or have none, keep their own text and fate in each stage that rejoins."""
    bad = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 13)
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    ids = [None, None, 1, 1, 2]
    told = lambda stage, t, i: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in stage(spark, documents(spark, t, i), sf).collect())
    want = sorted(zip([-1, -1, 1, 1], texts, strict=True))
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_copies):
        assert told(stage, [*texts, texts[0]], ids) == want
        assert told(stage, [texts[0]] * 3, [3, 3, 3]) == [(3, texts[0])]
    assert told(corpus_pipeline.benchmarks, [*texts[:3], bad, bad], [None, 1, 2, 2, None]) == sorted(zip([-1, 1, 2], texts, strict=False))


def test_extra_columns_with_clashing_names(spark, sf):
    """Columns named like those that stages and operators add come through every stage."""
    texts = [" ".join(f"word{c}{i}" for i in range(40)) for c in "abc"]
    extra = {"score": "7.5", "lang_pred": "'x'", "kept": "'k'", "row": "1", "_hash": "2", "line": "3", "cls": "4", "version": "5", "words": "6", "did": "7", "sha1": "8", "component_id": "9", "c0": "10"}
    docs = documents(spark, texts).selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert set(extra) <= set(docs.columns)
    assert docs.count() == 3 and docs.select("score", "row", "_hash").distinct().collect() == [(7.5, 1, 2)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 3
