"""Hard negatives by bounds along a spanning tree of anchors.

Anchors meet the rows in blocks. Each block of anchors has a spanning tree of
least distances. A parent's scores, plus or minus the length of the edge times a
row's norm, bound the child's scores; only rows whose bounds overlap the window
that the child looks at are scored again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop_table, materialize

#: Rows and anchors of a block.
ROWS, ANCHORS = 8192, 256
#: Scores are exact in doubles below this product of norms, and in 64-bit integers beyond.
DOUBLE = 2.0**52
#: Components are held to 32 bits.
LARGEST = 2.0**31 - 1


def spanning_tree(a: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(order, parent, length of the edge to it) of a least spanning tree of the rows of ``a``; parents come first, the root is its own."""
    n = len(a)
    order, parent, gap = [], np.zeros(n, np.int64), np.full(n, np.inf)
    left = np.ones(n, bool)
    at = 0
    for _ in range(n):
        order.append(at)
        left[at] = False
        far = np.sqrt(((a - a[at]) ** 2).sum(1))
        nearer = left & (far < gap)
        parent[nearer], gap[nearer] = at, far[nearer]
        at = int(np.where(left, gap, np.inf).argmin())
    gap[0] = 0.0
    return order, parent, gap


class Rows:
    """A block of rows: ids, labels, vectors, and what scoring needs of them."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, dim: int):
        self.id, self.label = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x = np.frombuffer(vectors, np.int32).reshape(len(self.id), dim).astype(float)
        self.norm = np.sqrt((self.x**2).sum(1))

    def scores(self, c: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
        """Inner products of ``c`` with the rows ``at``; most rows at once where most are asked for."""
        x = self.x if 4 * len(at) > len(self.x) else self.x[at]
        if reach * float(np.sqrt((c**2).sum())) < DOUBLE:
            s = np.rint(x @ c).astype(np.int64)
        else:
            s = x.astype(np.int64) @ c.astype(np.int64)
        return s[at] if len(x) != len(at) else s


def along_tree(rows: Rows, anchors: Rows, overlap) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, their scores): for each anchor the rows whose bounds ``overlap(anchor, low, high)`` lets through.

    Bounds of a row that was not scored at a parent are the parent's bounds,
    wider by the edge; an anchor's bounds go once its last child has them.
    """
    if not len(anchors.id):
        return
    order, parent, gap = spanning_tree(anchors.x)
    children = np.bincount(parent, minlength=len(order))
    children[order[0]] -= 1
    reach = float(rows.norm.max(initial=0.0))
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in order:
        if k == order[0]:
            every = np.arange(len(rows.id))
            low = high = rows.scores(anchors.x[k], every, reach).astype(float)
        else:
            low, high = known[parent[k]]
            children[parent[k]] -= 1
            if not children[parent[k]]:
                del known[parent[k]]
            margin = gap[k] * rows.norm * (1 + 1e-9) + 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1
            low, high = low - margin, high + margin
        at = np.flatnonzero(overlap(k, low, high))
        exact = rows.scores(anchors.x[k], at, reach)
        if children[k]:
            low, high = low.copy(), high.copy()
            low[at] = high[at] = exact
            known[k] = low, high
        yield k, at, exact


def first_of(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id."""
    if len(score) > n:
        at = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:n]


def _positives(rows: Rows, anchors: Rows, n: int) -> list[tuple]:
    """(anchor, row, score) of the first ``n`` rows of each anchor's label in one block."""
    def overlap(k, low, high):
        own = (rows.label == anchors.label[k]) & (rows.id != anchors.id[k])
        if own.sum() > n:
            own &= high >= np.partition(low[own], own.sum() - n)[own.sum() - n]
        return own

    out = []
    for k, at, score in along_tree(rows, anchors, overlap):
        best = first_of(score, rows.id[at], n)
        out += zip([int(anchors.id[k])] * len(best), rows.id[at][best].tolist(), score[best].tolist(), strict=True)
    return out


def _negatives(rows: Rows, anchors: Rows, given: list[list[tuple[int, int]]], n: int, low_part: int, high_part: int) -> list[tuple]:
    """(anchor, positive, its score, row, score) of the first ``n`` rows of each window in one block."""
    window = [[(i, p, -(-low_part * p // 100), high_part * p // 100) for i, p in own] for own in given]

    def overlap(k, low, high):
        hit = np.zeros(len(rows.id), bool)
        for _, _, a, b in window[k]:
            hit |= (high >= a) & (low <= b)
        return hit & (rows.label != anchors.label[k])

    out = []
    for k, at, score in along_tree(rows, anchors, overlap):
        for i, p, a, b in window[k]:
            own = np.flatnonzero((score >= a) & (score <= b))
            best = own[first_of(score[own], rows.id[at][own], n)]
            out += zip([int(anchors.id[k])] * len(best), [i] * len(best), [p] * len(best), rows.id[at][best].tolist(), score[best].tolist(), strict=True)
    return out


def _packer(size: int, scale: float, extra: bool):
    """Rows that follow each other (same dim and block) as blobs of at most ``size`` rows."""
    names = ["dim", "block", "ids", "labels", "vectors", "positives"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def done():
            dim, block = held
            v = np.array([r[2] for r in rows], float).reshape(len(rows), dim)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(scale * v), -LARGEST, LARGEST).astype(np.int32)
            one = [[dim], [block], [np.array([r[0] for r in rows], np.int64).tobytes()], [np.array([r[1] for r in rows], np.int64).tobytes()], [v.tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(x, t) for x, t in zip(one, kinds, strict=True)]
            kind = pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())])))
            return pa.RecordBatch.from_arrays([*columns, pa.array([[r[3] or [] for r in rows] if extra else None], kind)], names=names)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for dim, block, *row in zip(*columns, strict=True):
                if rows and ((dim, block) != held or len(rows) == size):
                    yield done()
                    rows = []
                held = dim, block
                rows.append(row)
        if rows:
            yield done()

    return run


PACKED = "dim int, block long, ids binary, labels binary, vectors binary, positives array<array<struct<id:long,score:long>>>"


def _meet(packed: DataFrame, anchors: DataFrame, load: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows, anchors, positives)`` of each block of rows with each block of anchors of the same length.

    A task holds one block of rows, while the anchors' blocks stream past it.
    """
    everywhere = anchors.join(load.select(F.col("dim").alias("d_"), "blocks"), F.col("dim") == F.col("d_"))
    asked = everywhere.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("turn"), "ids", "labels", "vectors", "positives")
    both = packed.select("dim", "block", F.lit(0).alias("turn"), "ids", "labels", "vectors", "positives").unionByName(asked)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, None
        for batch in batches:
            for dim, block, turn, ids, labels, vectors, positives in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turn == 0:
                    held, rows = (dim, block), Rows(ids, labels, vectors, dim)
                elif held == (dim, block):
                    given = None if positives is None else [[(x["id"], x["score"]) for x in own] for own in positives]
                    out = work(rows, Rows(ids, labels, vectors, dim), given)
                    columns = list(zip(*out, strict=True)) or [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return both.repartition("dim", "block").sortWithinPartitions("dim", "block", "turn").mapInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, anchor: Column, vector: str = "embedding", id_col: str = "vec_id", label: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x); scores are integer inner products,
    higher first, ties by smaller id. For each row that ``anchor`` (of the id and
    label columns) picks, its positives are the first rows of its label but
    itself, and for each of these the first rows of other labels whose score is
    between ``window`` percent of the positive's are returned, ranked from 1.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part. Repeated rows count once; of rows of one id that differ, the
    one of the smallest label, then vector, counts. Vectors of different lengths
    don't meet; empty ones score 0. Components past 32 bits are held to 32 bits;
    scores must fit 64. An anchor without positives, and a positive without
    negatives, gives no row; an empty table gives an empty result; other columns
    are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    single = materialize(rows.where(fit).groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*", F.size("r.v").alias("dim")), "vectors")
    load = materialize(single.groupBy("dim").agg(F.ceil(F.count("*") / ROWS).alias("blocks")), "load")
    blocked = single.join(load.select(F.col("dim").alias("d_"), "blocks"), F.col("dim") == F.col("d_")).select("dim", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "label", "v")
    # A block by hash holds ROWS rows and few more, so that no limit cuts it.
    packed = materialize(blocked.repartition("dim", "block").sortWithinPartitions("dim", "block", "id").mapInArrow(_packer(1 << 62, scale, False), PACKED), "blocks")

    def asked(given: DataFrame) -> DataFrame:
        """Anchors with like ones together: vectors that begin alike, equal ones above all."""
        chosen = given.select("dim", F.lit(0).cast("long").alias("block"), "id", "label", "v", "positives")
        return chosen.repartitionByRange("dim", "v", "id").sortWithinPartitions("dim", "v", "id").mapInArrow(_packer(ANCHORS, scale, True), PACKED)

    some = single.where("anchor")
    plain = materialize(asked(some.withColumn("positives", F.lit(None).cast("array<struct<id:long,score:long>>"))), "anchors")
    near = _meet(packed, plain, load, lambda r, a, _: _positives(r, a, positives), "anchor_id long, id long, score long")
    w = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")
    first = near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= positives)
    own = first.groupBy(F.col("anchor_id").alias("a_")).agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("positives"))
    given = materialize(asked(some.join(own, F.col("id") == F.col("a_"))), "anchors")
    low_part, high_part = window
    far = _meet(packed, given, load, lambda r, a, p: _negatives(r, a, p, negatives, low_part, high_part), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    out = materialize(far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives), "negatives")
    for used in (single, load, packed, plain, given):
        drop_table(used)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with every seventh label changed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", "embedding", changed.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM r a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
