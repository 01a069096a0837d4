"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The corpus is split into words twice. The first pass counts the benchmark's words over all documents; they order each window's words
(`window` consecutive words of an item), the rarest first. The second pass stores the postings of the `PICKS` rarest words of all windows: term,
document, position. A window's lists are intersected from the rarest on: a posting of its rarest word, less the word's offset, is a
place where the window may begin, and stays one if the other lists have their words at their offsets from there. What is left is compared
word by word with the documents that it is in, which are read again; all others are never looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW = 13
#: Lists that are intersected for each window, the rarest ones.
PICKS = 3
#: Rows that carry documents' lengths are spread over so many keys where terms are joined by shuffle.
SPREAD = 1024
#: Splits lower-cased text; the complement of a word character.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Small tables are broadcast up to so many rows (each has at most a few words); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """text with A-Z in lower case and all else unchanged."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_and_end(text: Column) -> Column:
    """The words, an empty string behind them, and one before them if the text begins with a separator."""
    return F.split(F.concat(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), SEPARATOR, -1)


def small(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its row count is within the bound."""
    out = staged(df, "small")
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, words: distinct items that have words."""
    words = F.filter(words_and_end(F.col(text_col).cast("string")), lambda w: w != "")
    return items.select(F.col(item_col).cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0).distinct()


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version, words: version tells rows apart that share an id but not their text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), words_and_end(text).alias("words"))


def term_counts(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How often each of the given terms (column term) occurs in all documents; absent ones have no row."""
    found = _docs(docs, id_col, text_col).select(F.explode("words").alias("term")).where("term != ''")
    return found.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def index(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of the given terms (column term): doc_id, version, term, pos; and for each document a row with a null term, whose pos is the number of words."""
    lengths = terms.sparkSession.range(SPREAD).select(F.concat(F.lit(" "), F.col("id")).alias("key"))
    wanted = terms.select(F.col("term").alias("key")).distinct().unionByName(lengths)
    rows = _docs(docs, id_col, text_col).select("doc_id", "version", (F.size("words") - 1).alias("end"), F.when(F.element_at("words", 1) == "", 1).otherwise(0).alias("lead"), F.posexplode("words").alias("at", "term"))
    rows = rows.where((F.col("term") != "") | (F.col("at") == F.col("end")))  # one empty string is behind the words, no word has a space
    key = F.when(F.col("term") != "", F.col("term")).otherwise(F.concat(F.lit(" "), F.pmod(F.xxhash64("doc_id", "version"), F.lit(SPREAD))))
    found = rows.withColumn("key", key).join(small(wanted), "key", "left_semi")
    return found.select("doc_id", "version", F.nullif("term", F.lit("")).alias("term"), F.greatest(F.col("at") - F.col("lead"), F.lit(0)).alias("pos"))


def around(docs: DataFrame, terms: DataFrame, radius: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, near: for each place of the given terms the words up to `radius` before and behind it, its own in between."""
    rows = _docs(docs, id_col, text_col).select("doc_id", F.filter("words", lambda w: w != "").alias("words"))
    rows = rows.select("doc_id", "words", F.posexplode("words").alias("at", "term")).join(small(terms.select("term").distinct()), "term", "left_semi")
    first = F.greatest(F.col("at") - radius, F.lit(0))
    return rows.select("doc_id", "term", F.slice("words", first + 1, F.col("at") - first + 1 + radius).alias("near"))


def windows_of(words: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """wid, window (its words) of each distinct window, and wid, item_id of the items that have it. An item of fewer words is one window."""
    n = F.size("words")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    each = staged(words.select("item_id", "words", starts.alias("w")).select("item_id", F.slice("words", F.col("w") + 1, window).alias("window")).distinct(), "item_windows")
    distinct = staged(each.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window"), "windows")
    return distinct, each.join(distinct, "window").select("wid", "item_id")


def picked(windows: DataFrame, counts: DataFrame, picks: int) -> DataFrame:
    """wid, picks: (n, o, term) of the rarest words of each window, the rarest first, ties by offset. Windows with a word that no document has are left out."""
    cells = windows.select("wid", F.posexplode("window").alias("o", "term")).join(counts, "term", "left")
    rated = cells.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "term"))).alias("all"))
    return rated.where(F.col("all")[0]["n"] > 0).select("wid", F.slice("all", 1, picks).alias("picks"))


def intersected(postings: DataFrame, picks: DataFrame, most: int) -> DataFrame:
    """wid, doc_id, version, first: places where the picked words of a window are at their offsets; lists are joined one by one, the rarest first."""
    own = postings.where("term is not null")
    head = picks.select("wid", "picks", F.col("picks")[0]["term"].alias("term"), F.col("picks")[0]["o"].alias("o"))
    left = own.join(small(head), "term").select("wid", "picks", "doc_id", "version", (F.col("pos") - F.col("o")).alias("first")).where("first >= 0")
    for i in range(1, most):
        left = staged(left, "places")
        pick = F.get(F.col("picks"), F.lit(i))
        asked = left.where(F.size("picks") > i).withColumns({"term": pick["term"], "pos": F.col("first") + pick["o"]})
        lists = own.select(*[F.col(c).alias(f"_{c}") for c in own.columns])
        same = (F.col("term") == F.col("_term")) & (F.col("pos") == F.col("_pos")) & (F.col("version") == F.col("_version")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        left = left.where(F.size("picks") <= i).unionByName(asked.join(lists, same, "left_semi").select(left.columns))
    return left.select("wid", "doc_id", "version", "first").distinct()


def _vocabulary(words: DataFrame) -> DataFrame:
    return words.select(F.explode("words").alias("term")).distinct()


def _phrases(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings, wid, doc_id, version, first, last of each occurrence of a window, and the windows' owners."""
    words = item_words(items, item_col, item_text_col)
    windows, owners = windows_of(words, window)
    counts = staged(term_counts(docs, small(_vocabulary(words)), id_col=id_col, text_col=text_col), "term_counts")
    picks = staged(picked(windows, counts, PICKS), "picks")
    postings = staged(index(docs, picks.select(F.explode("picks.term").alias("term")), id_col=id_col, text_col=text_col), "postings")
    places = staged(intersected(postings, picks, min(PICKS, window)), "places")
    # the documents of these places, word by word
    some = small(places.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct())
    text = F.col(text_col).cast("string")
    hit = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    hit = hit.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left_semi").dropDuplicates(["doc_id", "version"])
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.filter(words_and_end(F.col("text")), lambda w: w != "").alias("words"))
    pairs = places.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))).join(small(windows), "wid")
    n = F.size("window")
    found = pairs.where(F.slice("words", F.col("first") + 1, n) == F.col("window"))
    return postings, found.select("wid", "doc_id", "version", "first", (F.col("first") + n - 1).alias("last")), owners


def phrase_matches(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first, last: where a document has a window of the item.

    A window is `window` consecutive words of an item; an item of fewer is one window, and an item without words has none. Matches may overlap.
    """
    _, found, owners = _phrases(docs, items, window, id_col, text_col, item_col, item_text_col)
    return found.join(owners, "wid").select("doc_id", "item_id", "first", "last").distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, *, span: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id: documents that have all words of the item, in any order, within `span` consecutive words."""
    words = item_words(items, item_col, item_text_col).select("item_id", F.array_distinct("words").alias("words"))
    counts = staged(term_counts(docs, small(_vocabulary(words)), id_col=id_col, text_col=text_col), "term_counts")
    cells = words.select("item_id", "words", F.explode("words").alias("term")).join(counts, "term", "left")
    best = cells.groupBy("item_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("best"))
    drivers = small(best.where("best.n > 0").select("item_id", F.col("best.term").alias("term"), F.col("words").alias("all_words")))
    places = around(docs, drivers, span - 1, id_col=id_col, text_col=text_col)
    pairs = places.join(drivers, "term").select("doc_id", "item_id", "all_words", "near")
    pairs = pairs.where(F.size(F.array_except("all_words", "near")) == 0)
    holds = F.exists(F.sequence(F.lit(1), F.greatest(F.size("near") - span + 1, F.lit(1))), lambda i: F.size(F.array_except("all_words", F.slice("near", i, span))) == 0)
    return pairs.where(holds).select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row: doc_id, version, n_words, n_hit, items, contaminated.

    n_hit counts the words inside any occurrence of a window, items are the ids (as sorted strings) of items with occurring windows, and a
    document is contaminated if n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and are never
    contaminated; without items, none is. Rows that repeat both id and text get equal results; rows that share an id but not their
    text are told apart by version. Items without an id add hits but no entry to items. Other columns are ignored.
    """
    postings, found, owners = _phrases(docs, items, window, id_col, text_col, item_col, item_text_col)
    found = staged(found, "matches")
    spans = found.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    of = found.select("wid", "doc_id", "version").distinct().join(owners, "wid").groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))

    def add(done: Column, span: Column) -> Column:
        new = F.greatest(span["last"] - F.greatest(span["first"] - 1, done["end"]), F.lit(0))
        return F.struct(F.greatest(done["end"], span["last"]).alias("end"), (done["n"] + new).alias("n"))

    hits = spans.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.aggregate("spans", start, add)["n"].alias("n_hit"))
    of = of.withColumnsRenamed({"doc_id": "d2", "version": "v2"})
    all_docs = postings.where("term is null").select("doc_id", "version", F.col("pos").cast("long").alias("n_words"))
    out = all_docs.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    out = out.join(of, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("version") == F.col("v2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "version", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
