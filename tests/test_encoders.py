"""The encoder and its lexical head against plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.operators import adapters, encoders, inverted, search


def plain_states(tokens, table):
    """States of tokens, number by number."""
    raw = []
    for t in tokens:
        m = "<" + t + ">"
        grams = {m} | {m[k : k + n] for n in (3, 4) for k in range(len(m) - n + 1)}
        raw.append([sum(table[zlib.crc32(g.encode()) % encoders.BUCKETS][j] for g in grams) / len(grams) for j in range(encoders.DIM)])
    out = []
    for k, v in enumerate(raw):
        s = [x + encoders.SHARE * ((raw[k - 1][j] if k else 0) + (raw[k + 1][j] if k + 1 < len(raw) else 0)) for j, x in enumerate(v)]
        n = sum(x * x for x in s) ** 0.5
        out.append([x / n for x in s])
    return out


def test_postings_equal_plain_loops(spark):
    r = random.Random(4)
    words = ["the", "court", "x", "section", "9", "of"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for k in range(30)] + [(30, None), (31, "Éa THE the"), (None, "of")]
    head = encoders.Head(np.random.default_rng(1).standard_normal(encoders.DIM), 0.1)
    got = {(x.cid, x.term): x.weight for x in encoders.head_postings(spark.createDataFrame(rows, "cid long, text string"), "cid", head).collect()}
    table, want = encoders.Encoder().table, {}
    for cid, text in rows:
        tokens = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()]
        for t, s in zip(tokens, plain_states(tokens, table)):
            x = sum(a * b for a, b in zip(s, head.w)) + head.b
            if cid is not None and x > 0:
                want[cid, t] = max(want.get((cid, t), 0), x)
    want = {k: round(x, 6) for k, x in want.items() if round(x, 6) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert encoders.head_postings(spark.createDataFrame([], "cid long, text string"), "cid", head).count() == 0


def test_fit_tells_telling_terms(spark):
    r = random.Random(6)
    topics, plain = [f"topic{k}" for k in range(30)], ["the", "of", "and", "to"]
    rows = []
    for _ in range(300):
        t, other = r.sample(topics, 2)
        fill = lambda: [r.choice(plain) for _ in range(6)]
        rows.append((" ".join([t, *fill()]), " ".join([*fill(), t]), 1))
        rows.append((" ".join([t, *fill()]), " ".join([*fill(), other]), 0))
    head = encoders.fit_head(spark.createDataFrame(rows, "query string, passage string, label int"), sample=400)
    encoder = encoders.Encoder()

    def score(q, p):
        a, c = head.weights(encoder, q.split()), head.weights(encoder, p.split())
        return sum(a[t] * c[t] for t in a.keys() & c.keys())

    fresh = rows[-100:]
    good, bad = [score(q, p) for q, p, y in fresh if y], [score(q, p) for q, p, y in fresh if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    one = head.weights(encoder, "the topic3 of".split())
    assert one["topic3"] > one.get("the", 0) and one["topic3"] > one.get("of", 0)


def test_dense_vectors_through_an_index_of_chunks(spark):
    chunks = spark.createDataFrame([("a", "of the court"), ("b", "of the court"), ("c", "zebra stripes"), ("d", None)], "chunk_id string, content string")
    made = adapters.index_chunks(chunks, encoders.dense_encoder, F.lit("Act"), F.lit("Part"), F.lit("1"))
    got = {x.chunk_id: np.array(x.vector) for x in made.collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values()) and (got["a"] == got["b"]).all() and got["a"] @ got["c"] < 0.95
    bare = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "k int, text string").select("k", encoders.dense_encoder(F.col("text")).alias("v")).collect()
    assert [np.linalg.norm(x.v) > 0 for x in sorted(bare)] == [False, False, True]


def test_learned_postings_through_the_inverted_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta")], "cid long, text string")
    head = encoders.Head(np.zeros(encoders.DIM), 1.0)  # every term weighs 1
    q = encoders.head_postings(spark.createDataFrame([(7, "beta alpha alpha")], "qid long, text string"), "qid", head)
    assert {(x.term, x.weight) for x in q.collect()} == {("beta", 1.0), ("alpha", 1.0)}
    hits, _ = inverted.search(q, inverted.build(docs), 2)
    assert [(x.cid, x.rk) for x in hits.orderBy("rk").collect()] == [(1, 1), (2, 2)]
    assert search.postings(docs, "cid").count() == 5


def test_texts_are_encoded_together(monkeypatch):
    """Texts of a batch share one pass by parts; states don't cross texts, and forgotten tokens are made again."""
    monkeypatch.setattr(encoders, "TOKENS", 7)
    monkeypatch.setattr(encoders, "LOOKED_UP", 3)
    monkeypatch.setattr(encoders, "REMEMBERED", 5)
    r = random.Random(12)
    texts = [[r.choice(["a", "court", "the", "section9", "of", "x1"]) for _ in range(n)] for n in (0, 3, 0, 9, 1, 2, 0, 4)]
    encoder, got, parts = encoders.Encoder(), {}, []
    for a, names, code, sizes in encoders._texts(pa.array(texts, pa.list_(pa.string()))):
        states, ends = encoder.coded(names.to_pylist(), code, sizes), sizes.cumsum()
        got |= {a + k: states[ends[k] - sizes[k] : ends[k]] for k in range(len(sizes))}
        parts.append(len(states))
    assert len(parts) > 2 and sum(parts) == sum(map(len, texts)) and len(encoder.known) <= 5
    for k, own in enumerate(texts):
        assert np.allclose(got[k], np.array(plain_states(own, encoder.table)).reshape(len(own), encoders.DIM), atol=1e-12)


def test_buckets_of_many_tokens_equal_those_of_one():
    r = random.Random(3)
    tokens = ["", "a", "ab", "abc", "aaaaaaa", "0", "abababab", "<<>>"] + ["".join(r.choice("ab09z") for _ in range(r.randint(1, 14))) for _ in range(300)]
    n, bucket = encoders._buckets([f"<{t}>".encode() for t in tokens if t])
    want = []
    for t in tokens[1:]:
        m = f"<{t}>"
        want.append([zlib.crc32(g.encode()) % encoders.BUCKETS for g in sorted({m, *(m[k : k + j] for j in (3, 4) for k in range(len(m) - j + 1))})])
    assert n.tolist() == [len(g) for g in want] and bucket.tolist() == [x for g in want for x in g]
    encoder = encoders.Encoder()
    assert np.allclose(encoder.made(["café", "ab"])[1], encoder.made(["ab"])[0])
