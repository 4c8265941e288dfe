"""Dense and lexical search for batches of queries, and rank fusion.

Queries and passages meet in blocks: each task scores one block of queries with
one block of passages and passes on no more than k hits a query, so neither side
is broadcast and no pair of a query and a passage becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of passages, and scores of two blocks that a task holds at once.
QUERY_BLOCK, PASSAGE_BLOCK = 1024, 16384
SCORES = 1 << 20
DENSE_K, SPARSE_K, REWRITE_K = 30, 5, 5


def usable(v: Column) -> Column:
    """Whether a vector is not null or empty and has neither null nor non-finite components."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k highest values of each row, ties by smaller column; only what reaches a row's k-th value is sorted."""
    if s.shape[1] > k:
        row, column = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    else:
        row, column = np.divmod(np.arange(s.size), max(1, s.shape[1]))
    order = np.lexsort((column, -s[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def cosines(q: pd.Series, c: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) by parts of a block of queries: cosines with all vectors of a block to six places; a zero vector has 0 with all.

    A part has about ``SCORES`` of them, one query at least.
    """
    b = np.array(c.tolist(), float)
    nb, step = np.linalg.norm(b, axis=1), max(1, SCORES // len(c))
    for at in range(0, len(q), step):
        a = np.array(q.iloc[at : at + step].tolist(), float)
        s = a @ b.T
        with np.errstate(invalid="ignore", divide="ignore"):
            s /= np.linalg.norm(a, axis=1)[:, None] * nb
        yield at, np.nan_to_num(np.round(s, 6, out=s), copy=False)


def score_blocks(k: int):
    """The k best passages for each query of one block of queries and one of passages."""

    def score(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"qid": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})]
        if len(q) and len(c):
            c = c.sort_values("cid", kind="stable")
            qids, ids = q["qid"].to_numpy(), c["cid"].to_numpy()
            for at, s in cosines(q["v"], c["v"]):
                row, hit = best(s, k)
                found.append(pd.DataFrame({"qid": qids[at + row], "cid": ids[hit], "score": s[row, hit]}))
        return pd.concat(found)

    return score


def _top(budgets: list[int]):
    """Scores of one block of queries with one block of passages; the best of each branch stay, as many as its budget."""

    def score(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"branch": pd.Series(dtype="int32"), "qid": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})]
        if len(q) and len(c):
            c = c.sort_values("cid", kind="stable")
            qids, ids, flags = q["qid"].to_numpy(), c["cid"].to_numpy(), c["flags"].to_numpy()
            own = [np.flatnonzero(flags >> n & 1) for n in range(len(budgets))]
            for at, s in cosines(q["v"], c["v"]):
                for n, k in enumerate(budgets):
                    if len(own[n]):
                        row, hit = best(s if len(own[n]) == len(c) else s[:, own[n]], k)
                        hit = own[n][hit]
                        found.append(pd.DataFrame({"branch": np.full(len(hit), n, np.int32), "qid": qids[at + row], "cid": ids[hit], "score": s[row, hit]}))
        return pd.concat(found)

    return score


def knn_branches(queries: DataFrame, passages: DataFrame, branches: list[tuple[Column, int]]) -> DataFrame:
    """(branch, qid, cid, score, rk): for each query and branch (which passages, how many) those of the highest cosine.

    ``queries`` is (qid, v), ``passages`` (cid, v) with the columns that the
    branches ask for. All branches share one meeting of the blocks. Scores are
    rounded to six places; ties go to the lower id. A zero vector scores 0 with
    all. Vectors match those of their own length alone; null and empty ones and
    those with a null or non-finite component match nothing.
    """
    if not branches or min(k for _, k in branches) < 1:
        raise ValueError("k is 1 or more")
    flags = F.lit(0)
    for n, (which, _) in enumerate(branches):
        flags = flags + F.when(which, 1 << n).otherwise(0)
    passages = passages.where(usable(F.col("v"))).select("cid", "v", flags.alias("flags")).where("flags <> 0")
    queries = queries.where(usable(F.col("v")))
    nq, nc = queries.count(), passages.count()
    bq, bc = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nc // PASSAGE_BLOCK))
    q = queries.select(F.col("qid").cast("long"), "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("qid"), F.lit(bq)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(bc - 1))).alias("y"))
    c = passages.select(F.col("cid").cast("long"), "v", F.size("v").alias("dim"), "flags", F.pmod(F.xxhash64("cid"), F.lit(bc)).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("x"))
    budgets = [k for _, k in branches]
    hits = q.groupBy("dim", "x", "y").cogroup(c.groupBy("dim", "x", "y")).applyInPandas(_top(budgets), "branch int, qid long, cid long, score double")
    limit = F.try_element_at(F.array(*[F.lit(k) for k in budgets]), F.col("branch") + 1)
    w = Window.partitionBy("branch", "qid").orderBy(F.col("score").desc(), "cid")
    return hits.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= limit)


def knn(queries: DataFrame, passages: DataFrame, k: int = DENSE_K) -> DataFrame:
    """(qid, cid, score, rk): the k passages of the highest cosine for each query, as :func:`knn_branches` with one branch of all."""
    return knn_branches(queries, passages, [(F.lit(True), k)]).drop("branch")


def top_k(hits: DataFrame, k: int, by: str = "score") -> DataFrame:
    """Rank ``rk`` by score within each query, ties by id; the first k stay."""
    w = Window.partitionBy("qid").orderBy(F.col(by).desc(), "cid")
    return hits.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def terms(text: Column) -> Column:
    """Words of letters and digits (ASCII), in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, weight): each term's largest weight in its text, over 0, to six places.

    A term at place p weighs 1 / (1 + ln(1 + p)); the largest weight wins, so
    repetition adds nothing.
    """
    words = docs.select(F.col(key), F.posexplode(terms(F.coalesce(text, F.lit("")))).alias("p", "term"))
    return words.groupBy(key, "term").agg(F.round(F.max(1.0 / (1.0 + F.log1p(F.col("p").cast("double")))), 6).alias("weight")).where("weight > 0")


def fuse(branches: list[DataFrame], k: int = DENSE_K) -> DataFrame:
    """Reciprocal rank fusion: (qid, cid, score, rk) with the sum of 1 / (rank + 1) over branches.

    A table may hold one branch, or several as :func:`knn_branches` gives them.
    """
    rows = None
    for b in branches:
        b = b.select("qid", "cid", (1.0 / (F.col("rk") + 1)).alias("part"))
        rows = b if rows is None else rows.unionByName(b)
    return top_k(rows.groupBy("qid", "cid").agg(F.round(F.sum("part"), 6).alias("score")), k)


def hybrid(dense: DataFrame, sparse: DataFrame, rewrites: list[DataFrame] = (), k: int = DENSE_K) -> DataFrame:
    """Dense, sparse and rewrite branches with their own budgets, fused; a query without lexical hits is dense only."""
    return fuse([dense, sparse, *rewrites], k)
