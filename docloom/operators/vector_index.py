"""A stored vector index of cells, searched exactly.

Vectors are dealt to the nearest of some centres and stored by cell, with the
widest angle of each cell. The angle between a query and a passage is at least
the query's angle to the centre less the cell's, so a cell whose best possible
score is under a query's k-th score so far is not read for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import PASSAGE_BLOCK, QUERY_BLOCK, SCORES, score_blocks, top_k, usable
from docloom.sources.stored import new_path, written

#: Most cells, and rows that the centres are fitted on.
CELLS, SAMPLE = 4096, 65_536
#: Pairs of a query and a cell that a task looks at and passes on at once.
VISITS = 1 << 16
#: Half a unit of the last place of a rounded score, and room for errors of the angles.
SLACK = 5e-7 + 1e-9
#: The cell of zero vectors, which score 0 with all.
ZERO = -1


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n == 0, 1, n)[:, None]


def fit_centres(passages: DataFrame, cells: int, seed: int = 1) -> np.ndarray:
    """Unit centres by k-means over at most about ``SAMPLE`` unit vectors of ``passages`` (n, v)."""
    n = passages.count()
    if not n:
        return np.zeros((0, 0))
    drawn = passages if n <= SAMPLE else passages.sample(SAMPLE / n, seed)
    unit = F.transform("v", lambda x: x.cast("double") / F.col("n"))
    model = KMeans(k=min(cells, n), maxIter=8, seed=seed, featuresCol="x").fit(drawn.select(array_to_vector(unit).alias("x")))
    centres = np.array(model.clusterCenters())
    return _unit(centres)[np.linalg.norm(centres, axis=1) > 1e-9]


def build(passages: DataFrame, dim: int, path: str | None = None, cells: int | None = None) -> str:
    """Write the index of ``passages(cid, v, ...)`` and return its path.

    ``rows`` are in folders by cell, each cell in parts of about
    ``PASSAGE_BLOCK``; ``cells`` has cell, parts, n, centre and the widest
    angle. Passages without an id, with a null or non-finite component or of
    another length than ``dim`` are left out, as they match nothing. ``cells``
    is the square root of their number, 4,096 at most.
    """
    spark = passages.sparkSession
    path = path or new_path(spark, "vectors")
    fit = passages.where(F.col("cid").isNotNull() & usable(F.col("v")) & (F.size("v") == dim))
    normed = fit.withColumn("n_", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    some = normed.where("n_ > 0").select(F.col("n_").alias("n"), "v")
    k = cells or min(CELLS, max(1, round(some.count() ** 0.5)))
    centres = spark.sparkContext.broadcast(fit_centres(some, k))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        step = max(1, SCORES // max(1, len(c)))
        for rows in (whole.iloc[a : a + step] for whole in batches for a in range(0, len(whole), step)):
            v = np.array(rows["v"].tolist(), float).reshape(len(rows), dim)
            cell, angle = np.full(len(rows), ZERO, np.int32), np.zeros(len(rows))
            some = np.flatnonzero(v.any(axis=1))
            if len(some):
                dot = _unit(v[some]) @ c.T
                cell[some] = dot.argmax(1)
                angle[some] = np.arccos(np.clip(dot.max(1), -1, 1))
            yield rows.assign(cell=cell, angle=angle)

    kept = fit.select(*passages.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["cell int", "angle double"])
    dealt = written(kept.mapInPandas(assign, schema), "assigned")
    sizes = written(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")), "sizes")
    parts = F.ceil(F.col("n") / PASSAGE_BLOCK).cast("int")
    known = sizes.select("cell", parts.alias("parts_"))
    placed = dealt.join(known, "cell").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts_")).cast("int")).drop("angle", "parts_")
    placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "cid").write.partitionBy("cell").parquet(f"{path}/rows")
    middle = pd.DataFrame({"cell": range(len(centres.value)), "centre": centres.value.tolist()})
    middle = spark.createDataFrame(middle, "cell int, centre array<double>")
    sizes.join(middle, "cell", "left").select("cell", parts.alias("parts"), "n", "centre", "radius").coalesce(1).write.parquet(f"{path}/cells")
    return path


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Highest cosine that each query can have with a vector of each cell: of angles on the sphere, one side is no shorter than the difference of the others."""
    angle = np.arccos(np.clip(_unit(queries) @ centres.T, -1, 1))
    out = np.cos(np.maximum(angle - radius[None], 0))
    out[~queries.any(axis=1)] = 0
    return out


def _visited(cells: pd.DataFrame, rows: pd.DataFrame, k: int, dim: int) -> Iterator[pd.DataFrame]:
    """(qid, v, cell) of :func:`_visits` for some queries, about ``VISITS`` pairs at once."""
    centres = np.array([np.zeros(dim) if c is None else c for c in cells["centre"]], float).reshape(len(cells), dim)
    cell, later, step = cells["cell"].to_numpy(), "least" in rows.columns, max(1, VISITS // len(cells))
    for own in (rows.iloc[a : a + step] for a in range(0, len(rows), step)):
        v = np.array(own["v"].tolist(), float).reshape(len(own), dim)
        top = bounds(v, centres, cells["radius"].to_numpy())
        top[:, cell == ZERO] = 0
        order = np.argsort(-top, axis=1, kind="stable")
        n = cells["n"].to_numpy()[order]
        first = np.zeros(top.shape, bool)
        np.put_along_axis(first, order, n.cumsum(1) - n < k, 1)
        wanted = ~first & (top >= own["least"].to_numpy()[:, None] - SLACK) if later else first
        q, c = np.nonzero(wanted)
        yield pd.DataFrame({"qid": own["qid"].to_numpy()[q], "v": own["v"].to_numpy()[q], "cell": cell[c]})


def _visits(queries: DataFrame, cells: pd.DataFrame, k: int, dim: int) -> DataFrame:
    """(qid, v, cell) of every query and cell that may hold one of its hits.

    ``queries`` with a column ``least`` (the k-th score so far) get the cells
    that can reach it and come after the first; without it they get the first:
    the best ones, up to k passages.
    """
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield from _visited(sent.value, rows, k, dim)

    return queries.mapInPandas(run, "qid long, v array<double>, cell int")


def _read(index: str, visits: DataFrame, cells: pd.DataFrame, where: Column | None, k: int, blocks: int) -> DataFrame:
    """(qid, cid, score): the k best passages a block of the cells that each query visits; other cells' folders are not read."""
    spark = visits.sparkSession
    parts = spark.createDataFrame(cells[["cell", "parts"]], "cell int, parts int")
    asked = visits.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("qid", "v", "cell", "part", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("x"))
    wanted = written(asked.select("cell", "part", "x").distinct(), "wanted")
    chosen = [r["cell"] for r in wanted.select("cell").distinct().collect()]  # as many as cells at most
    rows = spark.read.parquet(f"{index}/rows").where(F.col("cell").isin(chosen))
    rows = rows if where is None else rows.where(where)
    met = rows.select("cid", F.transform("v", lambda x: x.cast("double")).alias("v"), "cell", "part").join(wanted, ["cell", "part"])
    return asked.groupBy("cell", "part", "x").cogroup(met.groupBy("cell", "part", "x")).applyInPandas(score_blocks(k), "qid long, cid long, score double")


def search(queries: DataFrame, index: str, dim: int, k: int, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((qid, cid, score, rk), (visited, cells)): the k passages of the highest cosine for each query, as :func:`docloom.operators.search.knn`.

    Each query first reads its best cells, then those that its bound does not
    rule out given the k-th score found; ``where`` keeps passages by their
    other columns. The second table counts the pairs of a query and a cell that
    were read, and all there are. A query with a null or non-finite component or
    of another length finds nothing.
    """
    spark: SparkSession = queries.sparkSession
    cells = spark.read.parquet(f"{index}/cells").toPandas()  # 4,096 rows at most
    if not len(cells):
        none = spark.createDataFrame([], "qid long, cid long, score double, rk int")
        return none, none.agg(F.count("*").alias("visited"), F.count("*").alias("cells"))
    q = queries.where(usable(F.col("v")) & (F.size("v") == dim)).select(F.col("qid").cast("long"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    q = written(q, "queries")
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    first = written(_visits(q, cells, k, dim), "visits")
    near = written(_read(index, first, cells, where, k, blocks), "near")
    kth = top_k(near, k).where(F.col("rk") == k).select(F.col("qid").alias("q_"), F.col("score").alias("least"))
    # Fewer than k so far: no bound rules a cell out.
    open_ = q.join(kth, F.col("qid") == F.col("q_"), "left").select("qid", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
    second = written(_visits(open_, cells, k, dim), "visits")
    far = _read(index, second, cells, where, k, blocks)
    read = first.select("qid").unionByName(second.select("qid")).agg(F.count("*").alias("visited"), F.lit(n * len(cells)).cast("long").alias("cells"))
    return top_k(near.unionByName(far), k), read
