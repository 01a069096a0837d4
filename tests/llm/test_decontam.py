import random
import re

import pytest
from gatelake.llm import decontam

from .conftest import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, size):
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for i, text in items:
            v = words(text)
            n = min(size, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1 if v else 0):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids.add(str(i))
        out.append((len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def case():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Éa", "éa", "ΣΑ", "x", "y1", "z"] + [f"w{i}" for i in range(30)]
    text = lambda n: rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(12)] + [(50, None), (51, "..!"), (52, "the the the the the the the the"), (53, "unseen words only here"), (7, "second text of seven " + text(20))]
    texts = [text(rng.randint(0, 60)) for _ in range(30)]
    for i, t in items[:12]:
        texts += [text(5) + " " + t.upper() + ". " + text(8), t + " " + t, " ".join(t.split()[2:])]
    texts += [None, "", " ?", "the " * 300, text(5000) + " " + items[3][1] + " " + text(5000)]
    return texts, items


@pytest.mark.parametrize(("size", "rows"), [(13, 200_000), (5, 200_000), (5, 0), (1, 200_000)])
def test_documents(spark, size, rows, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(documents(spark, texts), bench, window=size).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, items, size)):
        r = got.loc[i]
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == want, i


def test_plan_is_native(spark):
    texts, items = case()
    plan = decontam.decontaminate(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_proximity(spark):
    docs = documents(spark, ["a b x c d", "a x x x b", "b a", None, "A, B"])
    bench = spark.createDataFrame([(1, "a b"), (2, "d a"), (3, "")], "item_id int, text string")
    got = decontam.proximity_matches(docs, bench, span=3)
    assert sorted(map(tuple, got.collect())) == [(0, "1"), (2, "1"), (4, "1")]
    got = decontam.proximity_matches(docs, bench, span=5)
    assert sorted(map(tuple, got.collect())) == [(0, "1"), (0, "2"), (1, "1"), (2, "1"), (4, "1")]


def test_phrases(spark):
    got = decontam.phrase_matches(documents(spark, ["q a b c q a b"]), spark.createDataFrame([("i", "a b c d")], "item_id string, text string"), window=2)
    assert sorted((r["first"], r["last"]) for r in got.collect()) and {(r["first"], r["last"]) for r in got.collect()} <= {(1, 2), (2, 3), (1, 3), (5, 6)}


def test_odd_tables(spark):
    docs = documents(spark, ["a b", "a b", "c d", None], [1, 1, 1, None]).selectExpr("*", "1 AS term", "2 AS pos", "3 AS version", "4 AS n")
    bench = spark.createDataFrame([("i", "a b", 1)], "item_id string, text string, words int")
    got = decontam.decontaminate(docs, bench).toPandas()
    assert sorted(got.n_hit) == [0, 0, 2, 2] and got.doc_id.isna().sum() == 1
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontam.decontaminate(docs, none).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(documents(spark, []), bench).count() == 0
