"""Language identification: known words first, then ever shorter character n-grams.

Training counts words per language over a bounded, documented sample of labelled rows; the model has all words and n-grams of this
sample (or a given number of each a language), so it is small enough to send to every executor. Prediction is a narrow pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, mapped

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
#: The bound of the training sample: documents a language. The model's size follows from it.
TRAIN_DOCS = 3000
#: Words outside the vocabulary that a worker keeps scored; beyond that it starts over. Affects speed only.
CACHE_ENTRIES = 200_000
UNDETERMINED = "und"


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; a word too short for n has none."""
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """languages, and log probabilities by word and by n-gram: one column a language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_scores: dict[int, np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        """The mean score of the known n-grams of the greatest length that has any; zeros without any."""
        for n in range(LONGEST_GRAM, 0, -1):
            found = [i for g in grams(word, n) if (i := self.grams[n].get(g)) is not None]
            if found:
                return self.gram_scores[n][found].mean(axis=0)
        return np.zeros(len(self.languages))


def _table(counts: dict[str, Counter], most: int | None) -> tuple[dict[str, int], np.ndarray]:
    """The `most` commonest keys of each language, and their smoothed log frequencies."""
    kept = sorted({k for c in counts.values() for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]})
    scores = np.array([[c.get(k, 0) for c in counts.values()] for k in kept], dtype=np.float64).reshape(len(kept), len(counts))
    total = np.array([sum(c.values()) for c in counts.values()], dtype=np.float64)
    return {k: i for i, k in enumerate(kept)}, np.log((scores + 0.5) / (total + 0.5 * len(kept) + 1))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])


def train(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, vocabulary: int | None = None, n_grams: int | None = None) -> Model:
    """Fit on about `train_docs` rows of each language, chosen by a hash of the id (and the text, so that rows without an id are told apart); rows without language or text don't count.

    All words of these rows feed the model, and all their n-grams; `vocabulary` and `n_grams` keep the commonest only. An empty table gives a model without languages, which finds every text undetermined.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, np.zeros((0, 0)), {n: {} for n in range(1, LONGEST_GRAM + 1)}, {})
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(train_docs / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    words = sample.transform(mapped, _count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {lang: Counter() for lang in sorted(sizes)}
    for lang, word, n in words.select("lang", "word", "n").toLocalIterator():
        counts[lang][word] = n
    table, scores = _table(counts, vocabulary)
    gram_ids, gram_scores = {}, {}
    for n in range(1, LONGEST_GRAM + 1):
        by_lang = {}
        for lang, c in counts.items():
            by_lang[lang] = Counter()
            for word, k in c.items():
                for g in grams(word, n):
                    by_lang[lang][g] += k
        gram_ids[n], gram_scores[n] = _table(by_lang, n_grams)
    return Model(list(counts), table, scores, gram_ids, gram_scores)


class Scorer:
    """A model with room for the words it hasn't seen, so that each is broken into n-grams once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.scores = np.zeros((len(model.words) + CACHE_ENTRIES, len(model.languages)))
        self.scores[: len(model.words)] = model.word_scores
        self.ids = dict(model.words)

    def _add(self, word: str) -> int:
        i = len(self.ids)
        self.scores[i] = self.model.unseen(word)
        self.ids[word] = i
        return i

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The best language and its posterior probability under equal priors."""
        counts = Counter(WORD.findall(text.lower())) if text else None
        if not counts or not self.model.languages or not any(x.isalpha() for w in counts for x in w):
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.languages))
        words = list(counts.items())
        for at in range(0, len(words), CACHE_ENTRIES // 2):
            part = words[at : at + CACHE_ENTRIES // 2]
            if len(self.ids) + len(part) > len(self.scores):
                self.ids = dict(self.model.words)
            get, add = self.ids.get, self._add
            found = [i if (i := get(w)) is not None else add(w) for w, _ in part]
            total += np.array([n for _, n in part], dtype=np.float64) @ self.scores[found]
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with columns lang_pred and score. `und` and score 0 where the text is null or has no letter.

    Reads nothing but the text. Ties go to the language whose name sorts first. Columns named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by the training sample
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index(text_col)
    schema = extended(kept, "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            out = [scorer(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=schema.names)

    return kept.transform(mapped, run, schema)
