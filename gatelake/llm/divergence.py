"""How much the words of a language's sources differ: each source against each other one, and its terms against the whole language.

Terms are counted in the tasks that read the texts, so what is shuffled are counts by language, source and term. A range partitioning by language and
term makes the dictionary: sorted arrays of kept terms in chunks, in which np.searchsorted gives each term its id, and ids, (partition, place), follow
the UTF-8 order of the terms. np.bincount lays a group's counts out over a chunk, and pairs of sources are compared chunk by chunk on these vectors.

No task holds more than CHUNK terms of BLOCK + BLOCK sources, and no vocabulary, source list or language as a whole. All arithmetic is in integers.

Odd tables: null text, language and source count as empty. Rows are documents, whatever their ids, repeated ones too. A source without terms is a group
all the same; a language without kept terms has pairs of value 0 and no terms. An empty table has no rows. Other columns, of whatever name, are
ignored. A long text is counted like any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions, staged

#: Terms of a chunk; sources that a task lays out at a time; counts that a task holds before it hands them on.
CHUNK, BLOCK, HELD = 8192, 64, 200_000
SCALE = 1_000_000_000
#: Bytes that aren't in a term become spaces, capitals small letters.
_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters (small) and of characters beyond ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split(b" ")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, how often and in how many documents; a term comes once for every HELD counts."""
    tf: dict[tuple[str, str], Counter] = {}
    df: dict[tuple[str, str], Counter] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in tf.items():
            counts.pop(b"", None)
            n, docs = len(counts), df[lang, source]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        tf.clear()
        df.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = terms(text)
            tf.setdefault((lang, source), Counter()).update(found)
            df.setdefault((lang, source), Counter()).update(set(found))
        if sum(map(len, tf.values())) > HELD:
            yield from handed()
    yield from handed()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n (occurrences), docs (documents that have it)."""
    said = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = mapped(said, _counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def encoded(counted: DataFrame, least: int, most: int = CHUNK) -> DataFrame:
    """lang, source, chunk, id, term, n and lang_n (in the language) of the terms in at least `least` documents of a language.

    A chunk has at most `most` terms of a language, and about HELD rows; id is a term's place in its sorted array, so (chunk, id) ascends with the terms.
    """
    keys = ["lang", "term"]
    ordered = counted.repartitionByRange(shuffle_partitions(counted.sparkSession), *keys).sortWithinPartitions(*keys).select("lang", "source", "term", "n", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        lang, held, n_terms, last = None, [], 0, None

        def chunk() -> Iterator[pa.RecordBatch]:
            nonlocal number
            source, term, n, docs = zip(*held, strict=True)
            n, every = np.array(n, np.int64), np.array(term, object)
            start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            in_docs, in_lang = np.add.reduceat(np.array(docs, np.int64), start), np.add.reduceat(n, start)
            kept = in_docs >= least
            dictionary = every[start][kept]  # sorted, as the rows are
            if len(dictionary):
                at = np.flatnonzero(np.repeat(kept, np.diff([*start, len(n)])))
                ids = np.searchsorted(dictionary, every[at])
                out = [pa.array([lang] * len(at), pa.string()), pa.array([source[i] for i in at], pa.string()), pa.array(np.full(len(at), number)), pa.array(ids.astype(np.int32)), pa.array(every[at], pa.binary()), pa.array(n[at]), pa.array(in_lang[kept][ids])]
                yield pa.RecordBatch.from_arrays(out, names=["lang", "source", "chunk", "id", "term", "n", "lang_n"])
            number += 1

        for batch in batches:
            for at, s, t, n, d in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (at != lang or t != last and (n_terms >= most or len(held) >= HELD)):
                    yield from chunk()
                    held, n_terms, last = [], 0, None
                n_terms += t != last
                lang, last = at, t
                held.append((s, t, n, d))
        if held:
            yield from chunk()

    return mapped(ordered, run, "lang string, source string, chunk long, id int, term binary, n long, lang_n long")


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total)."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)"))).cast("long")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of arrays, by long division, so that no product leaves 64 bits."""
    out, rest = np.divmod(n + 1, total)
    for _ in range(9):
        digit, rest = np.divmod(rest * 10, total)
        out = out * 10 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compared(task: pa.Table, rows: pa.Table) -> pa.Table:
    """For a chunk and two blocks of sources, the sums of gaps of all ordered pairs between them."""
    own = task.to_pylist()[0]
    size, v, sides = own["n_terms"], own["v"], [own["a"]] + ([own["b"]] if own["a_block"] != own["b_block"] else [])
    source = {s["place"]: i for i, s in enumerate(s for side in sides for s in side)}
    totals = np.array([s["total"] for side in sides for s in side], np.int64)
    place = np.array([source[x] for x in rows["place"].to_pylist()], np.int64)
    flat = place * size + rows["id"].to_numpy()
    n = rows["n"].to_numpy()
    # bincount sums in doubles, which are exact to 2 ** 53: high and low halves stay below
    low, high = (np.bincount(flat, x, len(source) * size).astype(np.int64) for x in (n & 0xFFFFFFFF, n >> 32))
    p = shares(((high << 32) + low).reshape(len(source), size), (totals + v)[:, None])
    names = list(source)
    first = range(len(sides[0]))
    pairs = [(i, j) for i in first for j in (range(len(sides[0]), len(names)) if len(sides) == 2 else range(len(names))) if i != j]
    if len(sides) == 2:
        pairs += [(j, i) for i, j in pairs]
    return pa.table({"lang": pa.array([own["lang"]] * len(pairs), pa.string()), "p": pa.array([names[i] for i, _ in pairs], pa.int64()), "q": pa.array([names[j] for _, j in pairs], pa.int64()), "value": pa.array([int(gap(p[i], p[j]).sum()) for i, j in pairs], pa.int64())})


def audit(docs: DataFrame, *, least: int = 3, top: int = 200, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of documents(text, lang, source).

    Each language keeps the terms in at least `least` of its documents, V of them. A group's share of a term is p = 1 + floor(10^9 (n + 1) / (N + V)),
    N its occurrences of kept terms; a language has shares, too. Part "pair": for each other source of the language, (p - q)^2 / q summed over
    the kept terms, each rounded down. Part "term": the `top` terms whose p is above the language's, by (p - q)^2 / q.
    Ranks go by value, descending, then by item. `chunk` terms and twice `block` sources are what a task lays out.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    coded = staged(encoded(staged(counts(docs), "term_counts"), least, chunk), "coded_terms")
    chunks = staged(coded.groupBy("lang", "chunk", "id").agg(F.first("lang_n").alias("n")).groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("n_terms"), F.sum("n").alias("n")), "chunks")
    langs = chunks.groupBy("lang").agg(F.sum("n_terms").alias("v"), F.sum("n").alias("lang_total"))
    totals = coded.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("lang").orderBy("source")
    sources = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(w) - 1).cast("long").alias("place"))
    sources = staged(sources.join(langs, "lang", "left").withColumn("block", F.floor(F.col("place") / block)), "sources")

    # a language's own share of a term, and the source's
    known = coded.join(sources.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total") + F.col("v")), _share(F.col("lang_n"), F.col("lang_total") + F.col("v"))
    near = known.select("lang", "source", "chunk", "id", "term", p.alias("p"), q.alias("q")).where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id")
    said = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    by_term = said.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))

    # every chunk of a language with every two blocks of its sources
    blocks = sources.groupBy("lang", "block", "v").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("s"))  # `block` at most
    tasks = chunks.select("lang", "chunk", "n_terms").join(blocks.select("lang", "v", F.col("block").alias("a_block"), F.col("s").alias("a")), "lang").join(blocks.select("lang", F.col("block").alias("b_block"), F.col("s").alias("b")), "lang").where("a_block <= b_block")
    n_blocks = sources.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"))
    placed = coded.select("lang", "source", "chunk", "id", "n").join(sources.select("lang", "source", "place", "block"), ["lang", "source"]).join(n_blocks, "lang")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).select("lang", "chunk", F.least("block", "other").alias("a_block"), F.greatest("block", "other").alias("b_block"), "place", "id", "n")
    key = ["lang", "chunk", "a_block", "b_block"]
    sums = tasks.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_compared, "lang string, p long, q long, value long").groupBy("lang", "p", "q").agg(F.sum("value").alias("value"))
    own, other = sources.select("lang", "source", F.col("place").alias("p")), sources.select("lang", F.col("source").alias("item"), F.col("place").alias("q"))
    pairs = own.join(other, "lang").where("p <> q").join(sums, ["lang", "p", "q"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))
    return by_pair.unionByName(by_term)
