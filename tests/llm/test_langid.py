import random

import pytest
from gatelake.llm import langid
from pyspark.sql import functions as F

from .conftest import documents


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def test_held_out_accuracy(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    got = langid.predict(docs, model).select("lang", "lang_pred").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_nothing_but_the_text_counts(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    a = langid.predict(docs, model).select("text", "lang_pred", "score")
    b = langid.predict(docs.selectExpr("-doc_id AS doc_id", "text", "'zz' AS lang", "null AS source", "'old' AS score"), model).select("text", "lang_pred", "score")
    assert sorted(a.collect()) == sorted(b.collect())


def test_odd_texts(spark, model):
    texts = [None, "", "  ", "123 ²½ !?", "_", "zzzzqqq", "und der die", "the of and " * 20000, "日本語"]
    got = langid.predict(documents(spark, texts), model).orderBy("doc_id").select("lang_pred", "score").collect()
    assert [r.lang_pred for r in got[:5]] == ["und"] * 5 and all(r.score == 0 for r in got[:5])
    assert all(0 <= r.score <= 1 for r in got) and got[6].lang_pred == "de" and got[7].lang_pred == "en"
    assert got[8].score <= 0.5


def test_no_labels(spark):
    empty = langid.train(documents(spark, [None]))
    assert [tuple(r) for r in langid.predict(documents(spark, ["word"]), empty).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert langid.predict(documents(spark, []), empty).count() == 0


def test_backoff_takes_the_longest_known_grams(model):
    assert model.words
    word = next(w for w in model.words if len(w) > 4)
    made = word + "qqqq"
    longest = next(n for n in range(4, 0, -1) if any(g in model.grams[n] for g in langid.grams(made, n)))
    rows = [model.grams[longest][g] for g in langid.grams(made, longest) if g in model.grams[longest]]
    assert model.unseen(made).tolist() == model.gram_scores[longest][rows].mean(axis=0).tolist()


def brute(labelled, text):
    """The best language and its posterior, counted anew for every word: known words first, then ever shorter n-grams."""
    import math
    import re
    from collections import Counter

    words_of = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    languages = sorted({lang for lang, _ in labelled})
    counts = {lang: Counter(w for own, t in labelled if own == lang for w in words_of(t)) for lang in languages}

    def log_frequency(key, tables):
        known = {k for t in tables.values() for k in t}
        if key not in known:
            return None
        return [math.log((tables[lang][key] + 0.5) / (sum(tables[lang].values()) + 0.5 * len(known) + 1)) for lang in languages]

    def grams(word, n):
        padded = f"<{word}>"
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    by_gram = {n: {lang: Counter(g for w, k in counts[lang].items() for g in grams(w, n) for _ in range(k)) for lang in languages} for n in range(1, 5)}
    total = [0.0] * len(languages)
    for w in words_of(text):
        scores = log_frequency(w, counts)
        for n in (4, 3, 2, 1):
            if scores is not None:
                break
            found = [s for g in grams(w, n) if (s := log_frequency(g, by_gram[n])) is not None]
            scores = [sum(x) / len(found) for x in zip(*found, strict=True)] if found else None
        total = [a + b for a, b in zip(total, scores or total, strict=True)] if scores else total
    best = max(range(len(languages)), key=lambda i: total[i])
    return languages[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    roots = {"xx": ["alpha", "beta", "gamma", "über"], "yy": ["omega", "sigma", "gamma", "naïve"], "zz": ["kappa", "lamda", "étoile"]}
    make = lambda lang, n: " ".join(rng.choice(roots[lang]) + rng.choice(["", "s", "en", "um"]) for _ in range(n))
    labelled = [(lang, make(lang, rng.randint(1, 12))) for lang in roots for _ in range(15)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(labelled)], "doc_id long, text string, lang string")
    model = langid.train(df)
    texts = [make(lang, rng.randint(1, 9)) + " " + rng.choice(["", "betamax", "sigmoid Kappas", "qqq", "日本語 12"]) for lang in roots for _ in range(10)]
    got = langid.predict(documents(spark, texts), model).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        lang, score = brute(labelled, t)
        assert got.loc[i].lang_pred == lang and got.loc[i].score == pytest.approx(score, rel=1e-6), t


def test_rows_without_an_id_are_told_apart(spark):
    """A sample of rows without ids takes some of them, not all or none."""
    letters = "abcdefghijklmnopqrst"
    texts = [f"w{letters[i // 20]}{letters[i % 20]} some text" for i in range(400)]
    df = spark.createDataFrame([(None, t, "xx") for t in texts], "doc_id long, text string, lang string")
    words = langid.train(df, train_docs=100).words
    assert 50 < sum(w.startswith("w") for w in words) < 150
