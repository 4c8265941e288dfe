"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random directions. In each pair of blocks the
projections of one side are sorted, and the window around each query of the
other side is a stretch of that order; pairs whose windows collide on enough
projections are verified by their cosine. The windows of a block are prefix sets
of bits, so that a collision costs one bit, and counts are kept in bit planes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop_table, link_classes, materialize, roots

THRESHOLD = 0.9
#: Projections (under 32), the half width of a window in deviations of a pair at the threshold, and the recall of the count.
PROJECTIONS, HALF_WIDTH, RECALL = 30, 2.0, 0.9999
#: Vectors of a block.
BLOCK = 4096


def least_collisions(recall: float = RECALL, k: int = PROJECTIONS, half_width: float = HALF_WIDTH) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``.

    Its difference on a random direction is normal, so each window catches it
    with probability erf(half_width / sqrt 2); closer pairs are caught more often.
    """
    p = math.erf(half_width / math.sqrt(2))
    total = 0.0
    for c in range(k, 0, -1):
        total += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if total >= recall:
            return c
    return 0


def directions(dim: int, k: int = PROJECTIONS, seed: int = 3) -> np.ndarray:
    """Gaussian directions, the same in every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, k))


def prefix_bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted values, bit sets of the r lowest for r = 0 ... n) of one projection."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    step = np.zeros((n + 1, (n + 63) // 64), np.uint64)
    step[np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    return values[order], np.bitwise_xor.accumulate(step, axis=0)


def candidates(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors whose windows collide on ``least`` projections or more (``same``: i < j only)."""
    a = directions(x.shape[1])
    width = HALF_WIDTH * math.sqrt(2 - 2 * threshold)
    p, q = x @ a, y @ a
    planes: list[np.ndarray] = []
    for k in range(a.shape[1]):
        ranks, sets = prefix_bits(q[:, k])
        carry = sets[np.searchsorted(ranks, p[:, k] + width, side="right")] ^ sets[np.searchsorted(ranks, p[:, k] - width, side="left")]
        for plane in planes:
            over = plane & carry
            plane ^= carry
            carry = over
        if (k + 1).bit_length() > len(planes):
            planes.append(carry)
    # count >= least, from the highest bit down
    more, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for bit in range(len(planes) - 1, -1, -1):
        if least >> bit & 1:
            equal &= planes[bit]
        else:
            more |= equal & planes[bit]
            equal &= ~planes[bit]
    hit = more | equal
    row, word = np.nonzero(hit)
    bits = np.unpackbits(hit[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    i, j = row[at], word[at] * 64 + bit
    ok = (j < len(y)) & ((i < j) if same else True)
    return i[ok], j[ok]


def link_blocks(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Verified index pairs with cosine of ``threshold`` or more, in double precision.

    Each vector is first scaled by a power of two, which is exact and keeps squares of very large and very small components in range.
    """
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=1e-300))[1][:, None]) for v in (x, y))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    i, j = candidates(x / nx[:, None], y / ny[:, None], threshold, same, least_collisions())
    kept_i, kept_j = [], []
    for s in range(0, len(i), 1 << 16):
        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        ok = (x[a] * y[b]).sum(1) / (nx[a] * ny[b]) >= threshold
        kept_i.append(a[ok])
        kept_j.append(b[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate(kept_i or [none]), np.concatenate(kept_j or [none])


def _pack(batches):
    """One row a block: keys, copies and vectors as bytes, from rows sorted by block."""
    held, rows = None, []

    def done():
        key, copies, vector = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([b"".join(key)], pa.binary()), pa.array([np.array(copies, np.int64).tobytes()], pa.binary()), pa.array([np.array(vector, np.float64).tobytes()], pa.binary())],
            names=["dim", "block", "keys", "copies", "vectors"],
        )

    for batch in batches:
        for d, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d, b) != held:
                if rows:
                    yield done()
                held, rows = (d, b), []
            rows.append(row)
    if rows:
        yield done()


def _linked(batches, threshold: float):
    """Links of each pair of blocks; its one or two rows are together."""
    held, sides = None, {}

    def done():
        dim, a, b = held
        if a not in sides or b not in sides:
            return None
        one = lambda s: (np.frombuffer(s[0], "S16"), np.frombuffer(s[1], np.int64), np.frombuffer(s[2], np.float64).reshape(-1, dim))
        (kx, cx, x), (ky, cy, y) = one(sides[a]), one(sides[b])
        i, j = link_blocks(x, y, threshold, a == b)
        raw = sides[a][0] if a == b else sides[a][0] + sides[b][0]
        n = len(kx) if a == b else len(kx) + len(ky)
        copies = cx if a == b else np.concatenate([cx, cy])
        j = j if a == b else j + len(kx)
        links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
        root, some = roots(n, i, j), np.flatnonzero(links)
        key = lambda r: raw[16 * r : 16 * r + 16]
        return pa.RecordBatch.from_arrays([pa.array([key(r) for r in some.tolist()], pa.binary()), pa.array([key(r) for r in root[some].tolist()], pa.binary()), pa.array(links[some].astype(np.int64))], names=["a", "b", "links"])

    for batch in batches:
        for d, a, b, block, *side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d, a, b) != held:
                if held and (made := done()) is not None:
                    yield made
                held, sides = (d, a, b), {}
            sides[block] = side
    if held and (made := done()) is not None:
        yield made


def near_duplicates(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, class_id, copies, n_links, component_id, kept), a row for each row of ``vectors``.

    Links pairs with a cosine of ``threshold`` or more, whatever their other
    columns. Equal vectors form one class, which takes part once. Null, empty
    and zero vectors, and those with a null or non-finite component, link with
    nothing: each such row is its own component. Vectors of different lengths
    don't link. Null ids come last; repeated rows count as copies; an empty
    table gives an empty result. ``kept`` marks a component's smallest id.
    Blocks of vectors meet in pairs, so work grows with the square of the number
    of distinct vectors, one bit a pair and projection.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = vectors.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("some", F.coalesce(good, F.lit(False)))
    base = base.withColumn("key", F.unhex(F.md5(F.when(F.col("some"), F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))))))
    reps = materialize(base.where("some").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    load = materialize(reps.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "load")
    blocked = reps.withColumn("d_", F.size("v")).join(load, F.col("d_") == F.col("dim")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = blocked.select("dim", "block", "blocks", "key", "copies", "v")
    dealt = rows.select("dim", "block", "key", "copies", "v").repartition("dim", "block").sortWithinPartitions("dim", "block")
    packed = materialize(dealt.mapInArrow(_pack, "dim int, block long, keys binary, copies binary, vectors binary"), "blocks")
    counted = packed.join(load.select(F.col("dim").alias("d_"), "blocks"), F.col("dim") == F.col("d_"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    paired = counted.select("dim", "block", "keys", "copies", "vectors", other).select("dim", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "keys", "copies", "vectors")
    dealt = paired.repartition("dim", "x", "y").sortWithinPartitions("dim", "x", "y")
    found = materialize(dealt.mapInArrow(lambda batches: _linked(batches, threshold), "a binary, b binary, links long"), "found")
    classes = link_classes(reps.select("key", "first_id", "copies", F.lit(True).alias("some")), found)
    for used in (load, packed, found, reps):
        drop_table(used)
    known = base.select("id", "key").join(classes.withColumnRenamed("key", "k_"), F.col("key") == F.col("k_"), "left")
    linked = F.col("k_").isNotNull()
    return known.select(
        F.col("id").alias("vec_id"),
        F.when(linked, F.col("first_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(linked, F.col("id").eqNullSafe(F.col("component_id"))).otherwise(F.lit(True)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
