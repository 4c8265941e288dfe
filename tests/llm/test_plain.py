"""Operators against plain versions, columns with clashing names, and every query on the smallest tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import common, embeddings, jaccard, licenses, mixing, pieces, quality, queries, secrets, suffixes, toxicity

SF = "/root/testdata/sf0.001"


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_logit(net, text):
    """The most toxic window's logit, word by word in plain loops."""
    words = re.findall(r"\w+", text.lower())
    n, best = toxicity.HIDDEN, -math.inf
    vector = {x: net.inputs([x])[2][0].astype(float) for x in words}
    for s in toxicity.starts(len(words)):
        own = [vector[x] for x in words[s : s + toxicity.WINDOW]]
        states = []
        for side, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
            h, made = np.zeros(n), {}
            for t in order:
                p, q = own[t] @ net.w["x" + side] + net.w["c" + side], h @ net.w["u" + side]
                z, r = (np.array([sigmoid(v) for v in p[k : k + n] + q[k : k + n]]) for k in (0, n))
                new = np.tanh(p[2 * n :] + r * q[2 * n :])
                h = z * h + (1 - z) * new
                made[t] = h
            states.append(made)
        h = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(own))]
        e = [math.exp(float(np.tanh(x @ net.w["a"]) @ net.w["v"][:, 0])) for x in h]
        c = sum((w / sum(e) * x for w, x in zip(e, h)), np.zeros(2 * n))
        best = max(best, float(c @ net.w["o"][:, 0] + net.w["ob"][0]))
    return best


def test_toxicity_equals_plain_loops(spark):
    r = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "blarg", "zorkish", "é", "x1"]
    texts = [" ".join(r.choice(words) for _ in range(k)) for k in (0, 1, 2, 47, 48, 49, 84, 85, 130)]
    train = [(" ".join(r.choice(words[:3]) for _ in range(30)) + (" blarg" if k % 2 else ""), k % 2) for k in range(80)]
    net = toxicity.fit([t for t, _ in train], [y for _, y in train], epochs=2)
    want = [plain_logit(net, t) for t in texts]
    assert np.allclose(net.text_scores(texts), want, atol=1e-4)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[3]), (None, None)], "doc_id long, text string")
    got = toxicity.score(rows, net).collect()
    assert len(got) == len(texts) + 3 and all(abs(x.score - sigmoid(net.scale * plain_logit(net, x.text or "") + net.shift)) < 1e-4 for x in got)


def test_sample_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b")] * 500 + [(1, "a"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    texts, y, _ = toxicity.sample(docs, labels, "toxic", bound=2)
    keep = [(t, y) for k, t, y in ((1, "a", 1), (2, "c", 0)) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(zip(texts, y)) == sorted(keep)


def plain_quality(rows, model):
    """(p_site, score) of rows (text, host, path) from sums in dictionaries."""
    p = model.probability([t or "" for t, _, _ in rows])
    paths, hosts = {}, {}
    for (_, h, q), x in zip(rows, p):
        for d, k in ((paths, (h, q)), (hosts, h)):
            g, n = d.get(k, (0.0, 0))
            d[k] = g + x, n + 1
    rate = sum(p) / len(p)

    def strength(sites):  # (rate, prior, n)
        n = sum(x[2] for x in sites)
        spread = sum(k * (r - m) ** 2 for r, m, k in sites) / n
        within = sum(m * (1 - m) for _, m, _ in sites) / n
        return min(max(sum(k * m * (1 - m) for _, m, k in sites) / n / max(spread - within, 1e-9) - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    a = strength([(g / n, rate, n) for g, n in hosts.values()])
    of_host = {h: (g + a * rate) / (n + a) for h, (g, n) in hosts.items()}
    b = strength([(g / n, of_host[k[0]], n) for k, (g, n) in paths.items()])
    out = []
    for (_, h, q), x in zip(rows, p):
        g, n = paths[h, q]
        site = min(max((max(g - x, 0.0) + b * of_host[h]) / (n - 1 + b), 1e-6), 1 - 1e-6)
        logit = lambda v: math.log(v / (1 - v))
        out.append((site, sigmoid(logit(x) + logit(site) - logit(rate))))
    return out


def quality_rows():
    r = random.Random(5)
    prose = lambda: " ".join(r.choice(("the", "old", "river", "runs", "slowly", "under")) for _ in range(r.randint(5, 80))).capitalize() + "."
    junk = lambda: " | ".join(r.choice(("###", "$$$", "aa", "%%%")) for _ in range(r.randint(5, 80)))
    model = quality.fit([prose() if k % 3 else junk() for k in range(200)], [int(k % 3 > 0) for k in range(200)])
    rows = [(prose() if k % 5 else junk(), r.choice(("a", "b", "c", None)), r.choice(("en", "de", None))) for k in range(150)]
    return rows + [rows[0], rows[0], (None, "a", "en"), ("", None, None), ("word " * 30000, "a", "en")], model


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_quality_equals_plain_sums(spark, broadcast):
    rows, model = quality_rows()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        docs = spark.createDataFrame([(k if k % 9 else None, *x) for k, x in enumerate(rows)], "doc_id long, text string, source string, lang string")
        for c in ("n", "good", "host_rate", "salt", "site_host", "site_path", "site_text", "body", "h", "q", "s", "H_", "p_doc"):
            docs = docs.withColumn(c, F.lit("clash"))
        got = quality.classify(docs, model)
        assert got.columns == [c for c in docs.columns if c != "p_doc"] + ["p_doc", "p_site", "quality_score", "kept"]
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(x.n == x.good == x.H_ == x.body == "clash" for x in got)
    key = lambda t, h, q: (t or "", h or "", q or "")
    want = sorted((*key(*x), *v) for x, v in zip(rows, plain_quality(rows, model)))
    have = sorted((*key(x.text, x.source, x.lang), x.p_site, x.quality_score) for x in got)
    assert [x[:3] for x in have] == [x[:3] for x in want] and np.allclose([x[3:] for x in have], [x[3:] for x in want], atol=1e-9)
    assert all(x.kept == (x.quality_score >= 0.5) for x in got)


def test_hosts_and_paths(spark):
    urls = {"http://u:p@Ab.example.com:80/en/825?page=2": ("ab.example.com", "en"), "https://m.x.net#top": ("m.x.net", ""), "https://x.org/a/b/": ("x.org", "a"), "x.org/a": (None, None), None: (None, None), "http://x.org?q=/a": ("x.org", "")}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", quality.host_of("u").alias("h"), quality.path_of("u").alias("p")).collect()
    assert {x.u: (x.h, x.p) for x in got} == urls


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_mixed_keeps_clashing_columns(spark, broadcast):
    r = random.Random(7)
    rows = [(k, "w " * r.randint(0, 30), r.choice(("a", "b", None, "a"))) for k in range(200)] + [(7, "same", "a")] * 3 + [(None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("h", "H_", "full", "below", "cut_source", "cut_source_", "cut_salt", "copy", "copy_", "size", "taken", "target")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(x[c] == f"{c}{-1 if x.doc_id is None else x.doc_id}" for x in got for c in names)
    want = Counter()
    for x in mixing.mix(docs).collect():
        want[x.doc_id] += x.copies
    assert Counter(x.doc_id for x in got) == +want


def test_order_and_targets_of_many_sources(spark):
    r = random.Random(9)
    sizes = {f"h{k}.example": r.choice((0, 1, 5, 40, 1000, 90_000)) for k in range(500)} | {None: 7, "": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {x.source: x for x in mixing.in_order(df, [F.col("source").isNull(), F.col("source")], ["source_size"]).collect()}
    names, total = sorted(s for s in sizes if s is not None) + [None], 0
    for k, s in enumerate(names):
        assert (got[s]["rank"], got[s].before_source_size) == (k + 1, total)
        total += sizes[s]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped: dict = {}
    while True:
        free = [s for s in names if s not in capped]
        level = (1.5 * total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    want = {s: capped.get(s, weight[s] * level) for s in names}
    made = {x.source: x.target for x in mixing.source_targets(df).collect()}
    assert made.keys() == want.keys() and all(abs(made[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert mixing.source_targets(df.limit(0)).count() == 0


def test_deduplicate_keeps_clashing_columns(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, ""), (4, "!!"), (5, "!!"), (5, "!!"), (None, "!!"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("key", "key_", "number", "number_", "absent", "absent_", "k_", "bands", "chars", "KEY__")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))))
    out = jaccard.deduplicate(docs)
    got = out.collect()
    assert out.columns == docs.columns and all(x[c] == f"{c}{-1 if x.doc_id is None else x.doc_id}" for x in got for c in names)
    assert sorted((x.doc_id or 0, x.text or "") for x in got) == [(0, ""), (1, rows[0][1]), (3, ""), (4, "!!")]


def test_redact_edges(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh12 x", "c"), (1, "token=abcdefgh12 x", "c"), (None, None, None), (2, "", "d")], "doc_id long, text string, found string")
    got = secrets.redact(docs)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, "[SECRET] x", "c"), (1, "[SECRET] x", "c"), (None, None, None), (2, "", "d")], docs.schema).collect()))
    assert secrets.redact(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 100_000 + "password=abcdefgh9 " + "é " * 50_000)], "doc_id long, text string")
    assert secrets.redact(long).first().text == "word " * 100_000 + "[SECRET] " + "é " * 50_000


def test_findings_of_documents(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(k, f"see mail{r.randint(1, 9)}.example{k}.com and donaudampfschifffahrtsgesellschaft or token=abcdefgh{k}") for k in range(60)], "doc_id long, text string")
    found = secrets.findings_in(docs)
    assert found == secrets.findings_in(docs.repartition(5)) and any(not t for _, t, _ in found)
    tokens = {t for _, t, _ in found if t}
    assert tokens and not any("abcdefgh" in t for t in tokens)
    net = secrets.fitted(docs)
    assert net.held_out["recall"] >= secrets.RECALL and net.held_out["false_in_documents"] <= 0.05
    assert secrets.findings_in(docs.limit(0)) == []


def test_candidates_need_no_digit():
    assert secrets.base_spans("see QwErTyUiOpAsDfGhJkLzXcVb end")[1] == [(4, 28)]


def test_embeddings_of_any_scale(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1e308]), (6, [0.0, 1e308]), (None, [0.0, 3.0]), (None, None)]
    got = {(x.vec_id, x.component_id, x.n_links) for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 3), (5, 5, 3), (6, 5, 3), (None, 5, 3), (None, None, 0)}


@pytest.mark.parametrize("k", [2, 4])
def test_whole_licenses_of_any_length(spark, k):
    text, name = next(x for x in licenses.NOTICES if x[1] == "mit-text")
    long = " ".join(f"w{i}" for i in range(3000))
    words = text.split()
    docs = spark.createDataFrame([(1, "Intro. " + text.upper() + " end"), (2, " ".join(words[:60] + ["added"] + words[60:120] + words[121:])), (3, " ".join(words[:40])), (4, long + " tail"), (5, "K\u212a \u0130 MIT LICENSE")], "doc_id long, text string")
    phrases = licenses.PHRASES if k == 2 else []
    got = {x.doc_id: x for x in licenses.label(docs, phrases=phrases, notices=[(text, name), (long, "long-text")], k=k).collect()}
    assert [got[i].labels.split(",").count(name) for i in (1, 2, 3)] == [1, 1, 0] and got[4].labels == "long-text"
    assert got[1].score == 1.0 and got[2].score > 0.9 and got[5].n_words == 4
    if k == 2:
        assert got[5].base_labels == "mit"
    with pytest.raises(ValueError):
        licenses.templates(spark, [("a", "b")], [], 2)


def test_blocks_of_the_jaccard_join(spark, monkeypatch):
    """Stars over a block, several groups a cluster, many meetings a batch."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    base = [r.choice(words) for _ in range(60)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            own[r.randrange(60)] = r.choice(words)
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join(r.choice(words[:6]) for _ in range(r.randint(5, 9)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x.doc_id: (x.n_links, x.component_id) for x in jaccard.near_duplicates(docs).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = Counter(i for i in sets for j in sets if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert {i: n for i, (n, _) in want.items()} == {i: links[i] for i in sets}
    for block, chars in ((4, 1_000_000), (512, 900)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_CHARS", chars)
        monkeypatch.setattr(jaccard, "GATHER_PAIRS", 30)
        assert {x.doc_id: (x.n_links, x.component_id) for x in jaccard.near_duplicates(docs).collect()} == want


def test_word_hashes_equal_the_pattern(monkeypatch):
    r = random.Random(1)
    alphabet = ["a", "B", "é", "ß", "İ", "_", "1", "٣", "²", " ", "\n", "-", "日本", "😀", "\u0300", "ǅ", "Σ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(300)]
    for step in (1 << 19, 7):
        monkeypatch.setattr(jaccard, "HASHED", step)
        h, count = jaccard.shingles(texts, 1)
        words = [re.findall(r"\w+", t.lower()) for t in texts]
        assert count.tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_tables_need_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="shared folder"):
        common.shared_dir(Session())
    assert common.fresh(["A", "b", "b_"], "a", "b", "c") == ["a_", "b__", "c"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
class TestQueries:
    @pytest.mark.parametrize("name", sorted(queries.ORACLES))
    def test_query_equals_sql(self, spark, db, name):
        got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        assert sorted(str([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())

    def test_substrings(self, spark, db):
        rows = db.sql("SELECT doc_id, text FROM documents").fetchall()
        first = {}
        for o, t in rows:
            b = (t or "").encode()
            for i in range(len(b) - 49):
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], o), o)
        want = set()
        for o, t in rows:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < o:
                    gone[i : i + 50] = b"\1" * 50
            want.add((o, len(b), sum(gone), sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1])), hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()))
        assert {tuple(x[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for x in queries.QUERIES["op1_suffix_array"](spark, SF).collect()} == want

    def test_pieces(self, spark, db):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = {(i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, x in ((i, lib.encode(t or "")) for i, t in db.sql("SELECT doc_id, text FROM documents").fetchall())}
        assert {tuple(x[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for x in queries.QUERIES["op2_sentencepiece"](spark, SF).collect()} == want

    def test_base_secrets(self, spark, db):
        from tests.llm.test_text_ops import base_string

        got = {x.doc_id: x for x in queries.QUERIES["op3_secret_scan"](spark, SF).collect()}
        for i, t in db.sql("SELECT doc_id, text FROM documents").fetchall():
            base = base_string(t or "")
            assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
            assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [base.count(k) for k in ("assign:", "access:", "hex:")]

    def test_vectors(self, spark, db):
        ids, x = zip(*db.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
        u = np.array(x, np.float64)
        u /= np.linalg.norm(u, axis=1)[:, None]
        links = (u @ u.T >= 0.9).sum(1) - 1
        got = {r.vec_id: r.n_links for r in queries.QUERIES["op4_embedding_neardup"](spark, SF).collect()}
        assert got == dict(zip(ids, links.tolist()))

    def test_similar_documents(self, spark, db):
        rows = db.sql("SELECT doc_id, text FROM documents").fetchall()
        sets = {}
        for i, t in rows:
            w = re.findall(r"\w+", (t or "").lower())
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        links = Counter(i for i in sets for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        got = {r.doc_id: r.n_links for r in queries.QUERIES["op5_ngram_jaccard"](spark, SF).collect()}
        assert got == {i: links[i] for i in sets}

    def test_media_digests(self, spark, db):
        got = {x.doc_id: x for x in queries.QUERIES["op7_matroska"](spark, SF).collect()}
        for i, t in db.sql("SELECT doc_id, text FROM documents").fetchall():
            b = (t or "").encode()
            p = b + b"\xff" * (-len(b) % 576 if b else 576)
            assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))

    def test_classifiers(self, spark, db):
        n = db.sql("SELECT count(*) FROM documents").fetchall()[0][0]
        toxic = queries.QUERIES["op8_toxicity"](spark, SF).collect()
        assert len(toxic) == n and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) for x in toxic)
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        model = quality.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        rows = db.sql("SELECT doc_id, text, source, lang FROM documents").fetchall()
        want = plain_quality([r[1:] for r in rows], model)
        got = {x.doc_id: (x.p_site, x.quality_score) for x in queries.QUERIES["op10_quality"](spark, SF).collect()}
        assert np.allclose([got[r[0]] for r in rows], want, atol=1e-9)


def test_pipeline_with_clashing_names_and_long_texts(spark, tmp_path):
    r = random.Random(1)
    words = ["the", "old", "river", "runs", "slowly", "under", "stone", "bridges"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(20, 60))) + ".", "en", f"s{k % 2}", 1, "h") for k in range(60)]
    rows += [(100, " ".join(r.choice(words) for _ in range(60_000)), "en", "s0", 1, "h"), (101, rows[0][1], "en", "s0", 1, "h"), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string"
    docs = spark.createDataFrame(rows, schema)
    for c in ("key", "full", "good", "n", "found", "size", "site_host", "kept", "P_doc"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(k, 0, 1) for k in range(900, 905)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps = stage(spark, steps, str(tmp_path)).cache()
        assert steps.columns == docs.columns and all(x.key == x.good == x.site_host == x.kept == x.P_doc == "clash" for x in steps.collect())
    coded = corpus_pipeline.STAGES[-1][1](spark, steps, str(tmp_path))
    assert coded.count() == steps.count() and coded.where("not exact").count() == 0
