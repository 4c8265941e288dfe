"""Stored indexes against plain search over all passages."""

import math
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.operators import inverted, search, vector_index
from docloom.sources.stored import rows_at_once


def plain_knn(queries, passages, k):
    """Top k by cosine in plain loops; unusable vectors match nothing, others those of their length."""
    fit = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
    out = []
    for qid, q in queries:
        scores = []
        for cid, c in passages:
            if fit(q) and fit(c) and len(q) == len(c):
                a, b = np.array(q, float), np.array(c, float)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                scores.append((-(round(float(a @ b / n), 6) if n else 0.0), cid))
        out += [(qid, cid, -s, r + 1) for r, (s, cid) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted((x.qid, x.cid, x.score + 0.0, x.rk) for x in df.select("qid", "cid", "score", "rk").collect())


def close(got, want):
    assert [(a[0], a[1], a[3]) for a in got] == [(b[0], b[1], b[3]) for b in want] and all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want, strict=True))


ODD = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [1.0, 2.0]), (903, []), (904, [math.nan, 1.0, 0.0, 0.0]), (905, [math.inf, 1.0, 0.0, 0.0]), (906, [0.0] * 4)]


def test_best_takes_ties_by_column():
    r = np.random.default_rng(1)
    for _ in range(50):
        s = r.integers(0, 4, (r.integers(1, 6), r.integers(1, 12))).astype(float)
        k = int(r.integers(1, 8))
        want = [(i, j) for i in range(len(s)) for j in sorted(range(s.shape[1]), key=lambda j: (-s[i, j], j))[:k]]
        assert list(zip(*map(np.ndarray.tolist, search.best(s, k)), strict=True)) == want


def test_knn_with_odd_vectors(spark):
    r = np.random.default_rng(2)
    p = [(k, v.tolist()) for k, v in enumerate(r.integers(-2, 3, (60, 4)).astype(float))] + ODD
    q = p[:5] + ODD
    make = lambda x, c: spark.createDataFrame(x, f"{c} long, v array<double>").repartition(3)
    close(rows(search.knn(make(q, "qid"), make(p, "cid"), 7)), plain_knn(q, p, 7))
    assert search.knn(make(q, "qid"), make([], "cid"), 7).count() == 0


def test_index_is_exact_and_skips_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PASSAGE_BLOCK", 40)
    r = np.random.default_rng(4)
    middle = r.standard_normal((30, 4))
    v = middle[r.integers(0, 30, 900)] + 0.02 * r.standard_normal((900, 4))
    p = [(k, x.tolist()) for k, x in enumerate(v) if k < 880] + [(k, v[3].tolist()) for k in range(2000, 2100)] + ODD  # a hundred copies
    q = [(k, v[k].tolist()) for k in range(0, 60)] + ODD
    passages = spark.createDataFrame([(c, x, c % 2) for c, x in p], "cid long, v array<double>, odd long").repartition(3)
    queries = spark.createDataFrame(q, "qid long, v array<double>")
    index = vector_index.build(passages, 4, cells=25)
    hits, read = vector_index.search(queries, index, 4, 6)
    mine = [x for x in q if x[1] is not None and len(x[1]) == 4]
    close(rows(hits), plain_knn(mine, p, 6))
    seen = read.first()
    assert seen.visited < 0.35 * seen.cells
    hits, _ = vector_index.search(queries, index, 4, 6, where=F.col("odd") == 1)
    close(rows(hits), plain_knn(mine, [x for x in p if x[0] % 2], 6))
    few = vector_index.build(passages.limit(3), 4)
    assert len(rows(vector_index.search(queries, few, 4, 6)[0])) == 3 * len([x for x in mine if all(c is not None and math.isfinite(c) for c in x[1])])
    none = vector_index.build(passages.limit(0), 4)
    assert vector_index.search(queries, none, 4, 6)[0].count() == 0


def test_bounds_hold():
    r = np.random.default_rng(6)
    x, q = r.standard_normal((400, 5)), r.standard_normal((50, 5))
    c = vector_index._unit(r.standard_normal((7, 5)))
    dot = vector_index._unit(x) @ c.T
    cell, angle = dot.argmax(1), np.arccos(np.clip(dot.max(1), -1, 1))
    radius = pd.Series(angle).groupby(cell).max().reindex(range(7)).fillna(0).to_numpy()
    top = vector_index.bounds(q, c, radius)
    cosine = vector_index._unit(q) @ vector_index._unit(x).T
    assert (cosine <= top[:, cell] + 1e-9).all()


def plain_lexical(queries, docs, k):
    weigh = lambda t: {w: round(1 / (1 + math.log1p(p)), 6) for p, w in reversed(list(enumerate(re.findall("[a-z0-9]+", (t or "").lower()))))}
    held, out = {c: weigh(t) for c, t in docs}, []
    for qid, text in queries:
        q = weigh(text)
        scores = sorted((-round(sum(w * d[t] for t, w in q.items() if t in d), 6), c) for c, d in held.items())
        out += [(qid, c, -s, r + 1) for r, (s, c) in enumerate([x for x in scores if x[0] < 0][:k])]
    return sorted(out)


def test_inverted_index_is_exact_and_skips_ranges(spark, monkeypatch):
    monkeypatch.setattr(inverted, "RANGE_DOCS", 5)
    monkeypatch.setattr(inverted, "RANGE_POSTINGS", 60)
    r = random.Random(7)
    topic = [[f"t{k}x{j}" for j in range(12)] for k in range(20)]
    docs = [(100 * k + j, " ".join(r.choice(topic[k] + ["the", "of"]) for _ in range(r.randint(1, 25)))) for k in range(20) for j in range(10)]
    docs += [(5000, None), (5001, ""), (5002, "THE Of É the" + " zz" * 300), (5003, docs[3][1]), (5004, docs[3][1])]
    queries = [(k, " ".join(r.sample(topic[k % 20], 4)) + r.choice(("", " the"))) for k in range(30)] + [(90, ""), (91, None), (92, "nowhere"), (93, "the")]
    d = spark.createDataFrame(docs, "cid long, text string").coalesce(1)
    q = search.postings(spark.createDataFrame(queries, "qid long, text string"), "qid")
    hits, read = inverted.search(q, inverted.build(d), 4)
    want = plain_lexical(queries, docs, 4)
    close(rows(hits), want)
    alone, _ = inverted.search(q.where("qid < 20"), inverted.build(d), 4)
    seen = inverted.search(q.where("qid = 1"), inverted.build(d), 4)[1].first()
    assert 0 < seen.scored < 0.5 * seen.postings and read.first().scored <= read.first().postings
    monkeypatch.setattr(inverted, "QUERY_POSTINGS", 30)  # several groups of queries
    close(rows(inverted.search(q, inverted.build(d.repartition(4)), 4)[0]), want)
    close(rows(alone), [x for x in want if x[0] < 20])
    assert inverted.search(q.limit(0), inverted.build(d), 4)[0].count() == 0
    none, read = inverted.search(q, inverted.build(d.limit(0)), 4)
    assert none.count() == 0 and tuple(read.first()) == (0, 0)


def test_inverted_index_holds_few_rows_at_once(spark, monkeypatch):
    """However long a file is, a task gets some ranges at a time, keeps k hits a query, and finds the same."""
    monkeypatch.setattr(inverted, "RANGE_DOCS", 2)
    monkeypatch.setattr(inverted, "RANGES_AT_ONCE", 8)
    plain = inverted._scored

    def watched(batch, *rest):
        assert batch.num_rows <= 8
        return plain(batch, *rest)

    monkeypatch.setattr(inverted, "_scored", watched)
    docs = [(k, f"common w{k % 7} w{k % 5}") for k in range(600)]
    queries = [(k, f"common w{k}") for k in range(7)]
    d = spark.createDataFrame(docs, "cid long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    path = inverted.build(d)
    q = search.postings(spark.createDataFrame(queries, "qid long, text string"), "qid")
    close(rows(inverted.search(q, path, 3)[0]), plain_lexical(queries, docs, 3))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    own = inverted.Queries(q.toArrow())
    with rows_at_once(spark, 8):
        made = inverted._rest(spark.read.schema(inverted.RANGE).parquet(path).coalesce(1), spark.sparkContext.broadcast(own), 3)
        assert made.where("qid IS NOT NULL").count() == 21


def test_blocks_are_scored_in_parts(monkeypatch):
    """The scores of two whole blocks are never held at once, and the hits are those of one part."""
    r = np.random.default_rng(8)
    make = lambda n, **more: pd.DataFrame({"v": list(r.standard_normal((n, 4)))} | more)
    q, c = make(400, qid=np.arange(400)), make(8000, cid=r.permutation(8000), flags=r.integers(1, 4, 8000))
    tracemalloc.start()
    got = search._top([5, 3])((), q, c), search.score_blocks(5)((), q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores take 26 MB, and were held several times over
    monkeypatch.setattr(search, "SCORES", 1 << 30)
    for a, b in zip(got, (search._top([5, 3])((), q, c), search.score_blocks(5)((), q, c)), strict=True):
        order = [x for x in ("branch", "qid", "cid") if x in a]
        pd.testing.assert_frame_equal(a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True))


def test_visits_leave_in_parts(monkeypatch):
    monkeypatch.setattr(vector_index, "VISITS", 50)
    r = np.random.default_rng(9)
    cells = pd.DataFrame({"cell": range(20), "centre": list(r.standard_normal((20, 3))), "n": 4, "radius": 3.0})
    q = pd.DataFrame({"qid": range(30), "v": list(r.standard_normal((30, 3))), "least": -2.0})
    parts = list(vector_index._visited(cells, q, 4, 3))
    assert max(map(len, parts)) <= 50 and sum(map(len, parts)) == 30 * 19
    assert sum(map(len, vector_index._visited(cells, q.drop(columns="least"), 4, 3))) == 30
