"""Selection after reranking: tail cut and per-document diversity."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.search import terms

TAIL, TOP = 0.10, 5


def overlap(question: Column, passage: Column) -> Column:
    """The share of the question's distinct terms that a passage holds, to six places: the scorer where no model is given."""
    own = F.array_distinct(terms(question))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(own, terms(passage))) / F.size(own), 6))


def batch_scorer(model: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A scorer from a model that takes lists of questions and passages; it gets whole Arrow batches."""

    @F.pandas_udf("double")
    def score(question: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(model(question.tolist(), passage.tolist()), dtype=float)

    return score


def score_pairs(candidates: DataFrame, questions: DataFrame, passages: DataFrame, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """``candidates(qid, cid, pos)`` with ``score``; texts of (qid, question) and (cid, passage) are joined to the candidates alone."""
    pairs = candidates.join(questions.select("qid", "question"), "qid").join(passages.select("cid", "passage"), "cid")
    return pairs.select("qid", "cid", "pos", scorer(F.coalesce("question", F.lit("")), F.coalesce("passage", F.lit(""))).alias("score"))


def score_banded(candidates: DataFrame, questions: DataFrame, passages: DataFrame, model: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> DataFrame:
    """``candidates(qid, cid, pos)`` with score, size and width: pairs are scored in batches of like length.

    A model pads each pair of a batch to the longest. Pairs are dealt and sorted
    by their number of terms (``size``), so that a batch's ``width`` is little
    more; scores go back by key, whatever the batch. Null texts are empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    pairs = candidates.select("qid", "cid", "pos").join(questions.select("qid", text("question").alias("question")), "qid").join(passages.select("cid", text("passage").alias("passage")), "cid")
    sized = pairs.withColumn("size", F.size(terms(F.col("question"))) + F.size(terms(F.col("passage"))))

    def run(parts):
        held = None

        def scored(rows: pd.DataFrame) -> pd.DataFrame:
            score = pd.Series(model(rows["question"].tolist(), rows["passage"].tolist()), index=rows.index, dtype=float)
            return rows.assign(score=score, width=rows["size"].max())[["qid", "cid", "pos", "score", "size", "width"]]

        for part in parts:
            held = part if held is None else pd.concat([held, part])
            while len(held) >= batch:
                yield scored(held.iloc[:batch])
                held = held.iloc[batch:]
        if held is not None and len(held):
            yield scored(held)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = f"qid {kinds['qid']}, cid {kinds['cid']}, pos {kinds['pos']}, score double, size int, width int"
    return sized.repartitionByRange("size", "qid", "cid").sortWithinPartitions("size").mapInPandas(run, schema)


def padding(scored: DataFrame) -> DataFrame:
    """(terms, padded): terms of all pairs of :func:`score_banded`, and places that their batches take."""
    return scored.agg(F.sum(F.col("size").cast("long")).alias("terms"), F.sum(F.col("width").cast("long")).alias("padded"))


def tail_cut(scored: DataFrame, ratio: float = TAIL) -> DataFrame:
    """Rows with at least ``ratio`` of their query's best score."""
    best = F.max("score").over(Window.partitionBy("qid"))
    return scored.withColumn("cut", best * ratio).where(F.col("score") >= F.col("cut")).drop("cut")


def select_diverse(scored: DataFrame, k: int = TOP, cap: int | None = None, ratio: float = TAIL) -> DataFrame:
    """Up to k rows a query of (qid, cid, doc, score, pos), with ``rk``.

    First the rows over the tail cut, at most ``cap`` (k - 1 unless given) of a
    document; slots that are left go to the best row of each document that has
    none, even under the cut. With one document there is no cap. Equal scores
    keep their order ``pos``.
    """
    cap = max(1, k - 1) if cap is None else cap
    q = Window.partitionBy("qid")
    order = [F.col("score").desc(), F.col("pos")]
    s = scored.withColumns({"cut": F.max("score").over(q) * ratio, "nd": F.size(F.collect_set("doc").over(q))})
    s = s.withColumn("ok", F.col("score") >= F.col("cut"))
    s = s.withColumn("rd", F.row_number().over(Window.partitionBy("qid", "doc", "ok").orderBy(*order)))
    s = s.withColumn("elig", F.col("ok") & ((F.col("nd") < 2) | (F.col("rd") <= cap)))
    s = s.withColumn("p1", F.col("elig") & (F.row_number().over(Window.partitionBy("qid", "elig").orderBy(*order)) <= k))
    s = s.withColumns({
        "n1": F.count_if("p1").over(q), "taken": F.bool_or("p1").over(Window.partitionBy("qid", "doc")),
        "rdoc": F.row_number().over(Window.partitionBy("qid", "doc").orderBy(*order)),
    })
    s = s.withColumn("cand", (F.col("nd") > 1) & ~F.col("taken") & (F.col("rdoc") == 1))
    s = s.withColumn("p2", F.col("cand") & (F.row_number().over(Window.partitionBy("qid", "cand").orderBy(*order)) <= k - F.col("n1")))
    out = s.where("p1 or p2").withColumn("rk", F.row_number().over(q.orderBy(F.col("score").desc(), F.col("p1").desc(), "pos")))
    return out.select(*scored.columns, "rk")
