"""A stored inverted index with block maxima, searched exactly.

Documents are stored in ranges. A range has the terms of its documents with the
largest weight of each, and the documents' own postings. The sum of a query's
weights times a range's largest ones bounds the score of all its documents, so
the postings of a range that can't reach a query's k-th score so far are not
scored for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import best, top_k
from docloom.sources.stored import new_path, rows_at_once, written

#: Documents and postings of a range (one document at least), and postings of the queries that are sent out at once.
RANGE_DOCS, RANGE_POSTINGS = 16, 1 << 16
QUERY_POSTINGS = 1 << 18
#: Bytes of text that are indexed at once: bounds a task's memory.
SLICE = 4 << 20
#: Documents and ranges of a batch, and bytes of a stored group of ranges: a task holds no more than one of each, however large its file.
DOCS_AT_ONCE, RANGES_AT_ONCE, GROUP = 2048, 32, 8 << 20
#: Terms of a document, the most frequent ones, that its place among the others goes by.
ALIKE = 24
#: Ranges that each query scores first.
FIRST = 4
#: Half a unit of the last place of a rounded score.
SLACK = 5e-7 + 1e-9

RANGE = "range long, docs int, terms array<string>, tops array<double>, cids array<long>, counts array<int>, numbers array<int>, weights array<double>"


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE`` bytes in a text column, one row at least."""
    ends, a = pc.binary_length(batch.column(column)).to_numpy().astype(np.int64).cumsum(), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _alike(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` documents of a batch in an order that puts those with the same frequent terms together, so that a range has few terms and tight bounds."""
    often = np.bincount(code)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    order = np.lexsort((rank[code], doc))
    own, ranks = doc[order], rank[code[order]]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    keys = np.full((ALIKE, n), len(often))
    keys[place[place < ALIKE], own[place < ALIKE]] = ranks[place < ALIKE]
    return np.lexsort(keys[::-1])


def build(docs: DataFrame, path: str | None = None) -> str:
    """Write the index of ``docs(cid, text)`` in one pass, without a shuffle, and return its path.

    A term is a word of ASCII letters and digits in lower case; at place p it
    weighs 1 / (1 + ln(1 + p)) to six places, its first place counting. Null
    texts have no terms; ids are unique and not null. Ranges are numbered by the
    task that wrote them.
    """
    lowered = docs.where("cid IS NOT NULL").select(F.col("cid").cast("long").alias("cid"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (own for whole in batches for own in _slices(whole, 1)):
            words = pc.ascii_split_whitespace(pc.replace_substring_regex(batch.column(1), "[^a-z0-9]+", " "))
            flat = words.flatten()
            some = pc.not_equal(flat, "")
            size = np.bincount(np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())[some.to_numpy(zero_copy_only=False)], minlength=len(words))
            word = flat.filter(some).dictionary_encode()
            ends = size.cumsum()
            doc = np.repeat(np.arange(len(size)), size)
            code = word.indices.to_numpy().astype(np.int64)
            key, first = np.unique(doc << 32 | code, return_index=True)  # the first place of each term in its document
            doc, code = key >> 32, key & 0xFFFFFFFF
            weight = np.round(1 / (1 + np.log1p((first - (ends - size)[doc]).astype(float))), 6)
            order = _alike(doc, code, len(size))
            ids = batch.column(0).take(pa.array(order))
            place = np.argsort(order)[doc]
            turn = np.argsort(place, kind="stable")
            doc, code, weight = place[turn], code[turn], weight[turn]
            last = np.bincount(doc, minlength=len(size)).cumsum()
            a = 0
            while a < len(size):
                base = int(last[a - 1]) if a else 0
                b = min(a + RANGE_DOCS, max(a + 1, int(np.searchsorted(last, base + RANGE_POSTINGS, side="right"))))
                own, place = np.unique(code[base : last[b - 1]], return_inverse=True)
                w, top = weight[base : last[b - 1]], np.zeros(len(own))
                np.maximum.at(top, place, w)
                counts = np.diff(np.append(base, last[a:b]))
                lists = [word.dictionary.take(pa.array(own)), pa.array(top), ids[a:b], pa.array(counts.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(w)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b - a], pa.int32()), *lists], names=[p.split()[0] for p in RANGE.split(", ")])
                number, a = number + 1, b

    path = path or new_path(docs.sparkSession, "inverted")
    with rows_at_once(docs.sparkSession, DOCS_AT_ONCE):
        lowered.mapInArrow(run, RANGE).write.option("parquet.block.size", GROUP).parquet(path)
    return path


class Queries:
    """Postings of some queries: their terms, and weights by term."""

    def __init__(self, rows: pa.Table):
        self.ids, row = np.unique(rows.column("qid").to_numpy(), return_inverse=True)
        word = rows.column("term").combine_chunks().dictionary_encode()
        code, weight = word.indices.to_numpy(), rows.column("weight").to_numpy()
        order = np.argsort(code, kind="stable")
        self.terms, self.row, self.weight = word.dictionary, row[order], weight[order]
        self.start = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        self.least = np.zeros(len(self.ids))

    def entries(self, own: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``own``, query, weight) of all postings whose term is in ``own``."""
        at = pc.index_in(own, value_set=self.terms)
        place = np.flatnonzero(at.is_valid())
        at = at.drop_null().to_numpy()
        n = self.start[at + 1] - self.start[at]
        flat = np.repeat(self.start[at] - (n.cumsum() - n), n) + np.arange(n.sum())
        return np.repeat(place, n), self.row[flat], self.weight[flat]

    def bounds(self, own: pa.Array, top: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(highest score that each query can have in a range, entries)."""
        place, row, weight = made = self.entries(own)
        return np.bincount(row, weights=weight * top[place], minlength=len(self.ids)), made


def _values(column: pa.Array, k: int) -> pa.Array:
    return column[k].values


def _scored(batch: pa.RecordBatch, k: int, made: tuple, chosen: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, cid, score) of the ``n`` best documents of range ``k`` for each of the ``chosen`` queries."""
    place, row, weight = made
    cids, counts, numbers, w = (_values(batch.column(c), k).to_numpy() for c in ("cids", "counts", "numbers", "weights"))
    spot = np.full(len(ids), -1)
    spot[chosen] = np.arange(len(chosen))
    mine = spot[row] >= 0
    used = np.unique(place[mine])
    asked = np.zeros((len(used), len(chosen)))
    asked[np.searchsorted(used, place[mine]), spot[row[mine]]] = weight[mine]
    at = np.minimum(np.searchsorted(used, numbers), max(0, len(used) - 1))
    held = np.flatnonzero(used[at] == numbers) if len(used) else np.empty(0, np.int64)
    have = np.zeros((len(cids), len(used)))
    have[np.repeat(np.arange(len(cids)), counts)[held], at[held]] = w[held]
    order = np.argsort(cids, kind="stable")
    score = np.round(asked.T @ have[order].T, 6)
    q, c = best(score, n)
    some = score[q, c] > 0
    q, c = q[some], c[some]
    return ids[chosen[q]], cids[order[c]], score[q, c]


HIT = "qid long, cid long, score double, scored long"


class Found:
    """The ``n`` best (query, id, score) of each query so far, ties by smaller id."""

    def __init__(self, n: int):
        self.n, self.held = n, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def add(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        q, c, s = (np.concatenate(x) for x in zip(self.held, *parts, strict=True))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        stay = place < self.n
        last = place == self.n - 1
        self.held, self.kth = (q[stay], c[stay], s[stay]), (q[last], s[last])

    def rows(self, scored: int) -> pa.RecordBatch:
        """Hits, and a row without a query that tells how many postings were scored, once for each query."""
        null = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(1, t)])
        q, c, s = self.held
        return pa.RecordBatch.from_arrays([null(q, pa.int64()), null(c, pa.int64()), null(s, pa.float64()), pa.array([0] * len(q) + [scored], pa.int64())], names=["qid", "cid", "score", "scored"])


def _first(ranges: DataFrame, sent, k: int) -> DataFrame:
    """Hits in the ranges that promise each query most."""

    def promise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = sent.value, Found(FIRST)
        for batch in batches:
            top = np.array([own.bounds(_values(batch.column("terms"), r), _values(batch.column("tops"), r).to_numpy())[0] for r in range(batch.num_rows)]).reshape(batch.num_rows, -1)
            q, r = best(top.T, FIRST)
            good = top[r, q] > 0
            q, r = q[good], r[good]
            found.add([(own.ids[q], batch.column("range").to_numpy()[r], top[r, q])])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.held], names=["qid", "cid", "score"])

    promised = top_k(ranges.select("range", "terms", "tops").mapInArrow(promise, "qid long, cid long, score double"), FIRST)
    chosen = written(promised.groupBy(F.col("cid").alias("r_")).agg(F.collect_list("qid").alias("qids")), "promised")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, scored = sent.value, Found(k), 0
        for batch in batches:
            parts = []
            for r in range(batch.num_rows):
                q = np.searchsorted(own.ids, np.sort(_values(batch.column("qids"), r).to_numpy()))
                parts.append(_scored(batch, r, own.entries(_values(batch.column("terms"), r)), q, own.ids, k))
                scored += len(q) * len(_values(batch.column("numbers"), r))
            found.add(parts)
        yield found.rows(scored)

    return ranges.join(F.broadcast(chosen), F.col("range") == F.col("r_")).mapInArrow(score, HIT)


def _rest(ranges: DataFrame, sent, k: int) -> DataFrame:
    """Hits in all ranges that can reach a query's k-th score; the postings of others are not scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, scored = sent.value, Found(k), 0
        least = own.least.copy()
        for batch in batches:
            parts = []
            for r in range(batch.num_rows):
                bound, made = own.bounds(_values(batch.column("terms"), r), _values(batch.column("tops"), r).to_numpy())
                q = np.flatnonzero((bound >= least - SLACK) & (bound > 0))
                if len(q):
                    parts.append(_scored(batch, r, made, q, own.ids, k))
                    scored += len(q) * len(_values(batch.column("numbers"), r))
            found.add(parts)
            at = np.searchsorted(own.ids, found.kth[0])
            least[at] = np.maximum(least[at], found.kth[1])
        yield found.rows(scored)

    return ranges.mapInArrow(run, HIT)


def search(queries: DataFrame, index: str, k: int) -> tuple[DataFrame, DataFrame]:
    """((qid, cid, score, rk), (scored, postings)) by the inner product of weights.

    ``queries`` is (qid, term, weight), weights over 0. Scores are rounded to
    six places, those of 0 are no hits, ties go to the lower id. Queries are
    sent to the ranges in groups of about ``QUERY_POSTINGS`` postings; ranges
    stay where they lie, a few at once, and a task keeps k hits a query. The second table counts, over all queries, the postings
    that were scored once the k-th scores were known, and all of the index.
    """
    spark: SparkSession = queries.sparkSession
    ranges = spark.read.schema(RANGE).parquet(index)
    asked = written(queries.where("qid IS NOT NULL AND term IS NOT NULL").select(F.col("qid").cast("long"), "term", F.col("weight").cast("double")), "asked")
    groups = max(1, -(-asked.count() // QUERY_POSTINGS))
    out = None
    with rows_at_once(spark, RANGES_AT_ONCE):
        for g in range(groups):
            own = Queries(asked.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g).toArrow())
            if not len(own.ids):
                continue
            near = written(_first(ranges, spark.sparkContext.broadcast(own), k), "near")
            kth = top_k(near.where("qid IS NOT NULL").select("qid", "cid", "score").distinct(), k).where(F.col("rk") == k).select("qid", "score").toArrow()
            own.least[np.searchsorted(own.ids, kth.column("qid").to_numpy())] = kth.column("score").to_numpy()
            found = _rest(ranges, spark.sparkContext.broadcast(own), k)
            out = found if out is None else out.unionByName(found)
        out = written(out if out is not None else spark.createDataFrame([], HIT), "hits")
    n = asked.select("qid").distinct().count()
    total = ranges.agg((n * F.coalesce(F.sum(F.size("numbers").cast("long")), F.lit(0).cast("long"))).alias("postings"))
    count = out.agg(F.coalesce(F.sum("scored"), F.lit(0).cast("long")).alias("scored"))
    read = count.withColumn("one_", F.lit(1)).join(total.withColumn("one_", F.lit(1)), "one_").drop("one_")
    return top_k(out.where("qid IS NOT NULL").select("qid", "cid", "score"), k), read
