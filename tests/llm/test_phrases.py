"""Collocations against counts in dictionaries and against SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from docloom.llm import phrases
from docloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, least=10, top=2000, share=50):
    """Collocations of (lang, text) rows in plain loops."""
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n, found = sum(c for p, c in own.items() if len(p) == 1), []
        some = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        for p, a in some.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * c >= share * a for q, c in some.items()) and len(p) == 2:
                continue
            s, _, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_trie_leads_to_its_sequences_alone(seed):
    r = random.Random(seed)
    symbols = [r.getrandbits(64) - (1 << 63) for _ in range(300 if seed else 3)]
    two = sorted({(r.choice(symbols[:4]), r.choice(symbols)) for _ in range(400)})
    three = sorted({(a, b, r.choice(symbols)) for a, b in two for _ in range(r.choice((0, 1, 40)))})
    trie = phrases.Trie([np.array(two), np.array(three).reshape(-1, 3)])
    for k, s in enumerate([*two, *three]):
        state = np.zeros(1, np.int32)
        for c in trie.codes(np.array(s)):
            on, state = trie.step(state, np.array([c], np.int32))
            assert len(on) == 1
        assert trie.accept[state[0]] == k
    flat = [r.choice(symbols) for _ in range(2000)]
    for start in symbols[:4]:
        got = np.zeros(len(two) + len(three), np.int64)
        trie.add_counts(trie.codes(np.array(flat)), int(trie.codes(np.array([start]))[0]), got, 2)
        want = Counter((start, a) for a in flat) + Counter((start, a, b) for a, b in zip(flat, flat[1:]))
        assert got.tolist() == [want[s] for s in [*two, *three]]


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(12)
    words = ["The", "the", "of", "cat", "é", "x-1", "\x00", "Ärger", "İ", "zz"]
    rows = [(r.choice(("en", "en", "en", "fr", None, "und")), "".join(r.choice(words) + r.choice((" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x1c", " ! ")) for _ in range(r.randint(0, 60)))) for _ in range(250)]
    rows += [("en", "of the cat " * 3000), ("de", None), ("de", ""), (None, "a a a a a a a a a a a a a"), ("en", "x" * 90000 + " of the")] + [rows[3]] * 12
    docs = spark.createDataFrame([(i, t, la, 1) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, f long").repartition(6)
    want = brute(rows)
    got = made(phrases.collocations(docs))
    assert got == want and {x[0] for x in got} == {"en", "fr", "und"}
    monkeypatch.setattr(phrases, "SHARD", 20)  # several shards, small blocks, full bitmaps
    monkeypatch.setattr(phrases, "BLOCK", 2000)
    monkeypatch.setattr(phrases, "BITS", 64)
    assert made(phrases.collocations(docs, top=7)) == brute(rows, top=7)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert made(phrases.collocations(docs, least=3, share=90)) == brute(rows, least=3, share=90)


def test_score_is_exact(spark):
    rows = [(a, l, r) for a in (1, 10, 3_000_000_007, 9_000_000_000_000) for l in (a, a + 1, 10**13) for r in (a, 3 * a, 10**14)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score(*[phrases.F.col(c) for c in "alr"]).alias("s")).collect()
    assert [x.s for x in got] == [1000000 * a * a // (l * r) for a, l, r in rows]


def test_seed_that_clashes_is_left(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a b " * 20)], "lang string, text string")
    texts = phrases._texts(docs, "text", "lang")
    plain, seen = phrases.word_hash, []
    count = phrases.count_words

    def once(coded):
        seen.append(1)
        df = count(coded)
        return df.withColumn("h", phrases.F.lit(1).cast("long")) if len(seen) == 1 else df

    monkeypatch.setattr(phrases, "count_words", once)
    coded, counted, seed = phrases.words_counted(texts)
    assert seed == 1 and len(seen) == 2 and {(x.h, x.word) for x in counted.collect()} == {(plain(w.encode(), 1), w) for w in "ab"} and coded.count() == 1


def test_query_equals_sql(spark):
    got = QUERIES["op12_collocations"](spark, SF)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(ORACLES["op12_collocations"])
    assert got.columns == want.columns and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert made(got) == sorted(want.fetchall()) and got.count() > 100
