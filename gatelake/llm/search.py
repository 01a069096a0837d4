"""Exact BM25 top-k search: sharded inverted indexes with block-max WAND pruning, merged by global statistics.

A shard holds the postings of some documents, stored once: terms, where each one's list begins, documents and counts. Document
frequencies, document count and mean length are of the whole corpus, so shards' scores are comparable and the merge is exact.

A task puts its documents in order before it cuts shards: by groups that share their common terms, and by size. So maxima are those of documents
alike, and most shards of other languages than a query's are skipped whole. Queries are asked in batches, those with the same commonest term together, and
each test of block-max WAND is made for a whole batch at once. The threshold of a query is the k-th best score that it has anywhere so far; the
first shards are searched before the others for its sake.

1. Lists: a shard is skipped if the lists' maxima don't sum to the threshold.
2. Blocks: a block of documents is skipped if the maxima that the lists have within it don't. Where a query has no threshold yet, the
   blocks of the highest bounds come first.
3. Pivot: the lists are ordered with the rare terms' before the frequent ones'. The rare lists are read first; a document whose score by these
   and the frequent lists' maxima in its block don't reach the threshold is passed over, so where no rare term is needed, none is read on.
4. The frequent lists are read for what is left: products of matrices in single floats, with a margin for their error. What reaches the threshold
   is summed again in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import freed, mapped, staged, unstage
from .hashing import U

K1, B, K = 1.2, 0.75, 10
#: Scores are rounded to so many places, so that equal documents tie in whatever order their terms are summed.
DIGITS = 6
#: Documents of a block; documents and postings of a shard (a longer document is a shard of its own).
BLOCK, SHARD_DOCS, SHARD_POSTINGS = 64, 4096, 500_000
#: A task's documents are put in order, so that blocks hold documents alike, by so many postings; groups of them are told apart by so many of their commonest terms.
ORDER_POSTINGS, GROUPS, COMMON = 3_000_000, 8, 128
#: Terms of the queries that are broadcast at a time (16 bytes each; a longer query goes alone), and queries and terms of a batch.
QUERY_TERMS, QUERY_BATCH, BATCH_TERMS = 1_000_000, 128, 30_000
#: A term in at least one of so many documents of a shard is frequent, as far as its lists fit into so many cells.
FREQUENT, CELLS = 32, 4 << 20
#: Blocks scored before the others where a query has no floor yet.
STEP = 8
#: One of so many shards is searched before the others.
AHEAD = 8
#: How far a sum may be off in another order of its terms, and the rounding.
SLACK = 2 * 10.0**-DIGITS
SHARD = "shard long, n_docs long, n_words long, ids binary, known binary, lengths binary, terms binary, starts binary, docs binary, counts binary"


def terms_of(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its distinct terms' hashes, sorted, and how often each occurs. Terms: A-Z lower-cased, split at ASCII white space."""
    data = hashing.LOWER[data]
    start, end = hashing.words(data, bounds)
    h = hashing.word_hashes(data, start, end)
    cut = np.searchsorted(start, bounds)
    return [np.unique(h[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> query_id, term: the distinct terms of each document."""
    for batch in batches:
        for i, j, data, bounds in hashing.documents(batch, 1):
            bags = [t for t, _ in terms_of(data, bounds)]
            ids = np.repeat(batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False), [len(x) for x in bags])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashing.signed(np.concatenate(bags)))], names=["query_id", "term"])


def inverted(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Distinct terms, where each one's postings begin (and the end), documents and counts by term, then document."""
    doc = np.repeat(np.arange(len(bags), dtype=np.uint32), [len(t) for t, _ in bags])
    term = np.concatenate([t for t, _ in bags])
    order = np.argsort(term, kind="stable")
    term = term[order]
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    return term[starts], np.append(starts, len(term)), doc[order], np.concatenate([c for _, c in bags]).astype(np.uint32)[order]


def alike(bags: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Groups of documents with the same common terms (so, of one language), the shorter documents of each before the longer.

    k-means over the presence of the commonest terms. The order is for pruning's sake, and no result depends on it.
    """
    some = [t for t, _ in bags[:: max(1, len(bags) // 1024)]]
    term, df = np.unique(np.concatenate(some), return_counts=True)
    common = np.sort(term[np.argsort(-df, kind="stable")[:COMMON]])
    x = np.zeros((len(bags), len(common)), np.float32)
    for i, (t, _) in enumerate(bags):
        if len(t):
            x[i] = t[np.minimum(np.searchsorted(t, common), len(t) - 1)] == common
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    x = unit(x)
    centre = x[np.linspace(0, len(x) - 1, min(GROUPS, len(x))).astype(int)]
    for _ in range(6):
        group = (x @ centre.T).argmax(axis=1)
        centre = unit(np.stack([x[group == g].sum(axis=0) for g in range(len(centre))]))
    sizes = np.array([len(t) for t, _ in bags])
    order = np.lexsort((sizes, group))
    return [g for g in np.split(order, np.searchsorted(group[order], np.arange(1, len(centre)))) if len(g)]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> a row for each shard of the task."""
    task, n = TaskContext.get().partitionId(), 0
    rows: list[tuple[int | None, tuple[np.ndarray, np.ndarray]]] = []
    held = 0

    def shard(part: list[int]) -> pa.RecordBatch:
        nonlocal n
        bags = [rows[i][1] for i in part]
        ids, known = [rows[i][0] or 0 for i in part], [rows[i][0] is not None for i in part]
        lengths = np.array([int(c.sum()) for _, c in bags], np.int64)
        blobs = [np.array(ids, np.int64), np.array(known, bool), lengths, *inverted(bags)]
        values = [pa.array([(task << 32) + n], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]
        n += 1
        return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in SHARD.split(", ")])

    def shards() -> Iterator[pa.RecordBatch]:
        part: list[int] = []
        size = 0
        for group in alike([bag for _, bag in rows]):
            if part and size >= SHARD_POSTINGS // 8:  # fewer postings aren't worth a shard of their own
                yield shard(part)
                part, size = [], 0
            for i in group.tolist():
                own = len(rows[i][1][0])
                if part and (len(part) >= SHARD_DOCS or size + own > SHARD_POSTINGS):
                    yield shard(part)
                    part, size = [], 0
                part.append(i)
                size += own
        yield shard(part)

    for batch in batches:
        for i, j, data, bounds in hashing.documents(batch, 1):
            for own, bag in zip(batch.column(0).slice(i, j - i).to_pylist(), terms_of(data, bounds), strict=True):
                if rows and (held + len(bag[0]) > ORDER_POSTINGS or len(rows) >= 4 * SHARD_DOCS):
                    yield from shards()
                    rows, held = [], 0
                rows.append((own, (bag[0], bag[1].astype(np.uint32))))
                held += len(bag[0])
    if rows:
        yield from shards()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """terms, starts of shards -> term, df."""
    for batch in batches:
        for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(starts, np.int64)))], names=["term", "df"])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start ... start + size - 1 of each range, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Batch:
    """Queries that are asked together: the terms of all, looked up in a shard once."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n = len(queries)
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in queries])
        self.idf = np.concatenate([x for _, x in queries]) if queries else np.zeros(0)
        self.terms, at = np.unique(np.concatenate([t for t, _ in queries]) if queries else np.zeros(0, U), return_inverse=True)
        self.at = at.astype(np.int32)


def batched(queries: list[tuple[np.ndarray, np.ndarray]]) -> list[Batch]:
    """The queries in batches, as they follow each other."""
    out, part, size = [], [], 0
    for q in queries:
        if part and (len(part) == QUERY_BATCH or size + len(q[0]) > BATCH_TERMS):
            out.append(Batch(part))
            part, size = [], 0
        part.append(q)
        size += len(q[0])
    return [*out, Batch(part)] if part else out


class Shard:
    """An inverted index of some documents, for the weights of one corpus. `tested` and `skipped` count blocks of queries, and `passed` documents that the pivot test left out."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, counts: np.ndarray, mean: float, k1: float = K1, b: float = B) -> None:
        self.ids, self.terms, self.docs = ids, terms, docs.astype(np.int32)
        self.weight = counts * (k1 + 1) / (counts + (k1 * (1 - b + b * lengths / mean))[self.docs])
        n, df = len(ids), np.diff(starts)
        term = np.repeat(np.arange(len(terms), dtype=np.int32), df)
        self.most = np.maximum.reduceat(self.weight, starts[:-1]) if len(terms) else np.zeros(0)
        self.blocks = -(-n // BLOCK)
        self.known = np.zeros(self.blocks * BLOCK, bool)
        self.known[:n] = known
        self.known = self.known.reshape(self.blocks, BLOCK)
        # the frequent lists, as rows of weights in each block
        frequent = np.flatnonzero(df * FREQUENT >= n)
        frequent = frequent[np.argsort(-df[frequent], kind="stable")][: CELLS // (self.blocks * BLOCK)]
        f = len(frequent)
        self.row = np.full(len(terms), -1)
        self.row[frequent] = np.arange(f)
        self.lists = np.zeros((self.blocks, f, BLOCK), np.float32)
        own = np.flatnonzero((self.row >= 0)[term])
        doc = self.docs[own]
        self.lists.ravel()[(doc // BLOCK * f + self.row[term[own]]) * BLOCK + doc % BLOCK] = self.weight[own]
        del own, doc
        self.list_most = self.lists.max(axis=2, initial=0.0).T
        # sums of so many positive single floats are off by this share at most
        self.off = (f + 8) * 2.0**-23
        # cells: the postings of a term within a block
        block = self.docs // BLOCK
        cell = np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, bool)
        self.cell_start = np.append(np.flatnonzero(cell), len(term))
        self.cell_size = np.diff(self.cell_start).astype(np.int32)
        self.cell_block = block[self.cell_start[:-1]]
        del block, cell
        self.cell_most = np.maximum.reduceat(self.weight, self.cell_start[:-1]) if len(term) else np.zeros(0)
        self.term_cells = np.searchsorted(self.cell_start, starts)
        # the same postings by document
        order = np.argsort(docs.astype(np.uint16) if n < 1 << 16 else docs, kind="stable")
        self.doc_terms, self.doc_weight = term[order], self.weight[order]
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=n))])
        self.tested = self.skipped = self.passed = 0

    def reaches(self, bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return (bound > 0) & (bound * (1 + self.off) + SLACK >= floor)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]] | Batch, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (its terms, sorted, and their idf) ids and scores of the k best documents that share a term and reach its floor, ties by smaller id."""
        batch = queries if isinstance(queries, Batch) else Batch(queries)
        out = [(self.ids[:0], np.zeros(0))] * batch.n
        self.tested += self.blocks * batch.n
        if not len(self.terms):
            self.skipped += self.blocks * batch.n
            return out
        places = np.minimum(np.searchsorted(self.terms, batch.terms), len(self.terms) - 1)
        shared = self.terms[places] == batch.terms
        # lists: what the whole shard can reach
        bound = np.bincount(batch.of, np.where(shared, self.most[places], 0.0)[batch.at] * batch.idf, batch.n)
        able = self.reaches(bound, floors)
        self.skipped += self.blocks * int((~able).sum())
        picked = np.flatnonzero(able)
        if not len(picked):
            return out
        found = np.flatnonzero(shared[batch.at] & able[batch.of])
        of, at, idf, floor = (np.cumsum(able) - 1)[batch.of[found]], places[batch.at[found]], batch.idf[found], floors[picked].copy()
        m, row = len(picked), self.row[at]
        asks = np.zeros((m, self.lists.shape[1]), np.float32)
        asks[of[row >= 0], row[row >= 0]] = idf[row >= 0]
        # blocks: frequent lists' maxima, and rare ones' cells
        rest = (asks @ self.list_most).astype(np.float64)
        rare = np.flatnonzero(row < 0)
        n_cells = self.term_cells[at[rare] + 1] - self.term_cells[at[rare]]
        cell = _ranges(self.term_cells[at[rare]], n_cells)
        cell_idf = np.repeat(idf[rare], n_cells)
        flat = np.repeat(of[rare] * self.blocks, n_cells) + self.cell_block.take(cell)
        bounds = rest + np.bincount(flat, self.cell_most.take(cell) * cell_idf, m * self.blocks).reshape(m, self.blocks)
        score = np.full((m, self.blocks, BLOCK), -1.0)
        # where all floors are known, no more is learnt on the way
        order = np.argsort(-bounds.max(axis=0), kind="stable")
        for some in [order] if floor.all() else [order[:STEP], order[STEP:]]:
            asked = np.zeros((m, self.blocks), bool)
            asked[:, some] = self.reaches(bounds[:, some], floor[:, None])
            self.skipped += m * len(some) - int(asked.sum())
            some = np.flatnonzero(asked.any(axis=0))
            if not len(some):
                continue
            # the rare lists' parts in the open blocks
            own = np.flatnonzero(asked.ravel().take(flat))
            column = np.zeros(self.blocks, np.int64)
            column[some] = np.arange(len(some))
            shift = ((np.arange(m) * len(some))[:, None] + column - np.arange(self.blocks)) * BLOCK
            own_cell, own_idf, base = cell.take(own), cell_idf.take(own), shift.ravel().take(flat.take(own))
            start, size = self.cell_start.take(own_cell), self.cell_size.take(own_cell)
            part = np.bincount(base + self.docs.take(start), self.weight.take(start) * own_idf, m * len(some) * BLOCK)
            if len(more := np.flatnonzero(size > 1)):  # most cells have one posting
                size = size[more] - 1
                posting = _ranges(start[more] + 1, size)
                part += np.bincount(np.repeat(base[more], size) + self.docs.take(posting), self.weight.take(posting) * np.repeat(own_idf[more], size), m * len(some) * BLOCK)
            part = part.reshape(m, len(some), BLOCK)
            # pivot: what these and the frequent lists' maxima can reach
            wanted = asked[:, some, None] & self.reaches(part + rest[:, some, None], floor[:, None, None])
            self.passed += int(asked.sum()) * BLOCK - int(wanted.sum())
            wanted &= self.known[some]
            who_of = wanted.any(axis=2)
            for i, x in enumerate(some.tolist()):
                who = np.flatnonzero(who_of[:, i])
                if len(who):
                    full = part[who, i] + (asks if len(who) == m else asks[who]) @ self.lists[x]
                    score[who, x] = np.where(wanted[who, i] & (full > 0), full, -1.0)
            if not floor.all() and len(self.ids) >= k:
                best = -np.partition(-score.reshape(m, -1), k - 1, axis=1)[:, k - 1]
                floor = np.maximum(floor, best * (1 - self.off) - SLACK)
        # sums in the order of the document's terms, so that equal documents tie
        score = score.reshape(m, -1)
        near = (score > 0) & (score * (1 + self.off) + SLACK >= floor[:, None])
        idf_of = np.zeros(len(self.terms))
        cut = np.searchsorted(of, np.arange(m + 1))
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            docs = np.flatnonzero(near[i])
            if len(docs) > k:
                least = -np.partition(-score[i, docs], k - 1)[k - 1]
                docs = docs[score[i, docs] * (1 + self.off) + SLACK >= least * (1 - self.off) - SLACK]
            mine = slice(cut[i], cut[i + 1])
            idf_of[at[mine]] = idf[mine]
            size = self.doc_starts[docs + 1] - self.doc_starts[docs]
            posting = _ranges(self.doc_starts[docs], size)
            sums = np.add.reduceat(self.doc_weight[posting] * idf_of[self.doc_terms[posting]], np.cumsum(size) - size)
            idf_of[at[mine]] = 0.0
            ids, sums = self.ids[docs], np.round(sums, DIGITS)
            top = np.lexsort((ids, -sums))[:k]
            out[picked[i]] = ids[top], sums[top]
        return out


def _searched(queries, mean: float, k: int, k1: float, b: float):
    """Rows of shards -> query_id, doc_id, score: the k best of all the task's shards."""
    kinds = (np.int64, bool, np.int64, U, np.int64, np.uint32, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, parts, given = queries.value
        ids, scores = ([np.zeros(0, t) for _ in asked] for t in (np.int64, np.float64))
        floors = given.copy()
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(*(np.frombuffer(batch.column(i)[r].as_buffer(), t) for i, t in enumerate(kinds)), mean, k1, b)
                at = 0
                for part in parts:
                    for q, (d, s) in enumerate(shard.search(part, k, floors[at : at + part.n]), at):
                        if len(d):
                            d, s = np.concatenate([ids[q], d]), np.concatenate([scores[q], s])
                            top = np.lexsort((d, -s))[:k]
                            ids[q], scores[q] = d[top], s[top]
                            if len(top) == k:
                                floors[q] = max(floors[q], s[top[-1]])
                    at += part.n
                shard = None
                freed()
        q = np.repeat(asked, [len(d) for d in ids])
        yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in ((ids, np.int64), (scores, np.float64)))], names=["query_id", "doc_id", "score"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, terms (structs) -> query_id, n, terms and idf as bytes, by term."""
    for batch in batches:
        flat, edges = batch.column(1).flatten(), batch.column(1).offsets.to_numpy()
        term, idf = flat.field("term").to_numpy().view(U), flat.field("idf").to_numpy()
        edges = edges - edges[0] if len(edges) else edges
        blobs: tuple[list[bytes], list[bytes]] = ([], [])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            order = np.argsort(term[a:b])
            for to, x in zip(blobs, (term, idf), strict=True):
                to.append(x[a:b][order].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["query_id", "n", "terms", "idf"])


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = K, k1: float = K1, b: float = B, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text_col: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k documents of highest BM25 score for each query, exactly.

    A query is the set of its text's distinct terms, whole texts on both sides; idf is ln(1 + (N - df + 0.5) / (df + 0.5)). Documents that share no term
    aren't returned; scores are rounded to DIGITS places and ties go to the smaller id; rows that share an id are documents of their own. Null and empty texts have no terms but
    count as documents; so do rows without an id, which are never returned, and queries without one aren't asked; queries that share an id are
    one query of all their terms. Queries are sent to all shards by blocks of about QUERY_TERMS terms. Terms are 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    index = staged(rows.transform(mapped, _indexed, SHARD), "shards")
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).head()
    mean = max(total.words, 1) / max(total.n, 1)
    asked = queries.select(F.col(query_col).cast("long").alias("doc_id"), F.coalesce(F.col(query_text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    df = index.select("terms", "starts").transform(mapped, _counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((total.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    cells = asked.transform(mapped, _bags, "query_id long, term long").distinct().join(df, "term").select("query_id", "term", idf.alias("idf"))
    weighted = cells.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    weighted = staged(weighted.transform(mapped, _packed, "query_id long, n long, terms binary, idf binary"), "queries")
    blocks = max(1, -(-(weighted.agg(F.sum("n")).head()[0] or 0) // QUERY_TERMS))
    ahead = F.pmod(F.xxhash64("shard"), F.lit(AHEAD)) == 0
    columns = ["ids", "known", "lengths", "terms", "starts", "docs", "counts"]
    best = None

    def search(shards: DataFrame, *asked) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)
        found = staged(shards.select(columns).transform(mapped, _searched(sent, mean, k, k1, b), "query_id long, doc_id long, score double"), "found")
        sent.unpersist()
        return found

    for i in range(blocks):
        some = [(r.query_id, np.frombuffer(r.terms, U), np.frombuffer(r.idf, np.float64)) for r in weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toLocalIterator()]
        some.sort(key=lambda x: (x[2].min(), x[1][x[2].argmin()], len(x[1])))  # by the commonest term, so that a batch is of one language
        ids, parts = np.array([q for q, _, _ in some], np.int64), batched([x[1:] for x in some])
        first = search(index.where(ahead), ids, parts, np.zeros(len(ids)))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        floors = {r.query_id: r.score for r in first.withColumn("place", place).where(F.col("place") == k).select("query_id", "score").toLocalIterator()}
        found = first.unionByName(search(index.where(~ahead), ids, parts, np.array([floors.get(q, 0.0) for q in ids.tolist()])))
        best = found if best is None else best.unionByName(found)
    unstage(index, weighted)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
