"""Hard negatives against brute force over all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import negatives
from docloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, is_anchor, scale=256.0):
    """All hard negatives of (id, label, vector) rows in plain loops."""
    fit = {}
    for i, lab, v in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit[i] = min(fit.get(i, (lab, v)), (lab, v))
    q = {i: (lab, [int(min(max(math.floor(scale * x), -negatives.LARGEST), negatives.LARGEST)) for x in v]) for i, (lab, v) in fit.items()}
    out = []
    for a, (la, va) in q.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in q.items() if i != a and len(v) == len(va)}
        for p in sorted((i for i in score if q[i][0] == la), key=lambda i: (-score[i], i))[:5]:
            own = [i for i in score if q[i][0] != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for k, i in enumerate(sorted(own, key=lambda i: (-score[i], i))[:5]):
                out.append((a, p, k + 1, i, score[p], score[i]))
    return sorted(out)


def made(df):
    return sorted(tuple(x) for x in df.collect())


def test_spanning_tree_is_least():
    r = np.random.default_rng(3)
    a = np.floor(20 * r.standard_normal((40, 5)))
    a[7] = a[3]
    order, parent, gap = negatives.spanning_tree(a)
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))
    seen = {order[0]}
    for k in order[1:]:
        assert parent[k] in seen and gap[k] == d[k, parent[k]]
        seen.add(k)
    edges, root, total = sorted((d[i, j], i, j) for i in range(40) for j in range(i)), list(range(40)), 0.0
    for w, i, j in edges:  # Kruskal
        if root[i] != root[j]:
            total += w
            root = [root[j] if x == root[i] else x for x in root]
    assert abs(total - gap.sum()) < 1e-9 and sorted(order) == list(range(40))
    assert negatives.spanning_tree(np.zeros((1, 3)))[0] == [0]


def test_bounds_hold_and_cut():
    r = np.random.default_rng(5)
    base = r.standard_normal((6, 8))
    x = np.floor(256 * (base[r.integers(0, 6, 400)] + 0.05 * r.standard_normal((400, 8)))).astype(np.int32)
    pack = lambda ids, v: negatives.Rows(np.asarray(ids, np.int64).tobytes(), np.zeros(len(ids), np.int64).tobytes(), v.tobytes(), 8)
    rows, anchors = pack(range(400), x), pack(range(1000, 1060), x[:60])
    truth, scored = anchors.x @ rows.x.T, 0

    def overlap(k, low, high):
        assert (low <= truth[k]).all() and (truth[k] <= high).all()
        return high >= 250000

    for k, at, score in negatives.along_tree(rows, anchors, overlap):
        assert (score == truth[k][at]).all() and set(np.flatnonzero(truth[k] >= 250000)) <= set(at.tolist())
        scored += len(at)
    assert scored < 0.7 * truth.size


@pytest.mark.parametrize("blocks", [False, True])
def test_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(negatives, "ROWS", 30)
        monkeypatch.setattr(negatives, "ANCHORS", 4)
    r = random.Random(8)
    pool = [[r.choice((-1.0, -0.3, 0.0, 0.2, 0.5, 1.0)) for _ in range(4)] for _ in range(25)]
    rows = [(k, r.randint(0, 3), list(r.choice(pool))) for k in range(160)]
    rows += [(k, 1, pool[0]) for k in range(200, 240)]  # copies
    rows += [(10, rows[10][1], rows[10][2])] * 3 + [(20, 0, [9.0, 0.0, 0.0, 0.0])]  # repeated rows, and one id twice
    rows += [(None, 1, pool[1]), (300, None, pool[1]), (310, 1, None), (320, 1, [1.0, None, 0.0, 0.0]), (330, 1, [1.0, math.nan, 0.0, 0.0]), (340, 2, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(350, 1, [1.0, 2.0]), (351, 1, [1.0, 1.5]), (352, 2, [0.9, 1.4]), (360, 1, []), (361, 1, []), (362, 3, [])]
    rows += [(370, 4, [1e6, 2e6, 0.0, 1.0]), (371, 4, [1e6, 2e6, 1.0, 1.0]), (372, 5, [9e5, 2e6, 3.0, 1.0])]  # past the exact doubles
    rows += [(380, 6, [-1.0, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(i, lab, v, i, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, block long, dim string").repartition(5)
    got = made(negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0))
    want = brute(rows, lambda i: i % 10 == 0)
    assert got == want and {370, 350, 360} <= {x[0] for x in got}
    assert negatives.hard_negatives(docs.limit(0), F.lit(True)).count() == 0


def test_query_equals_sql(spark):
    got = QUERIES["op13_hard_negatives"](spark, SF)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = c.sql(ORACLES["op13_hard_negatives"])
    assert got.columns == want.columns and dict(got.dtypes)["rank"] == "int"
    assert made(got) == sorted(want.fetchall()) and len(want.fetchall()) >= 0 and got.count() > 20
