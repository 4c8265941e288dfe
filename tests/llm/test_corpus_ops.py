"""Operators on whole corpora against plain versions: suffixes, Jaccard, embeddings, mixing, components, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import embeddings, jaccard, mixing, pieces, suffixes
from docloom.llm.common import connected_components, materialize, neighbours


def test_suffix_arrays():
    r = random.Random(2)
    for _ in range(1500):
        s = [r.randint(1, r.choice((2, 3, 6))) for _ in range(r.randint(0, 40))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def deduplicated(rows, length):
    """Removed and kept bytes by comparing all substrings."""
    first = {}
    for o, t in rows:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(first.get(t[i : i + length], suffixes.LAST), o)
    out = []
    for o, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < o:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((o, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(t, gone) if not x)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("blocks", [False, True])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, blocks):
    r = random.Random(6)
    if blocks:  # many blocks, buckets and sorting tasks
        monkeypatch.setattr(suffixes, "BLOCK", 400)
        monkeypatch.setattr(suffixes, "BUCKET", 60)
        monkeypatch.setattr(suffixes, "TASK", 300)
        monkeypatch.setattr(suffixes, "SORTED", 200)
    pool = ["".join(r.choice("abc é") for _ in range(r.randint(20, 90))) for _ in range(12)]
    rows = [(k, "".join(r.choice(pool)[r.randint(0, 10) :] + r.choice(("", "x", "zz")) for _ in range(r.randint(0, 6)))) for k in range(60)]
    rows += [(61, None), (62, ""), (63, "a" * 900), (64, "a" * 120), (64, "a" * 120), (65, "ab" * 200), (None, pool[0] * 2), (None, pool[0] * 2), (10, rows[12][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    made = suffixes.deduplicate(docs, length=30, gram=12).collect()
    got = sorted((suffixes.LAST if x.id is None else x.id, len((x.text or "").encode()), sum(s.stop - s.start for s in x.spans), len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in made)
    assert got == deduplicated([(suffixes.LAST if i is None else i, (t or "").encode()) for i, t in rows], 30)
    assert suffixes.deduplicate(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="integer"):
        suffixes.deduplicate(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


@pytest.mark.parametrize("length", [30, 50, 150, 200])
def test_substring_dedup_of_other_lengths(spark, monkeypatch, length):
    monkeypatch.setattr(suffixes, "BLOCK", 4000)
    r = random.Random(length)
    pick = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage, long = pick(400), pick(30_000)
    rows = [(i, pick(r.randint(0, 60)) + passage + pick(r.randint(0, 60))) for i in range(25)]
    rows += [(30, pick(50) + long), (31, long[:20_000] + pick(9)), (32, pick(700)), (33, passage[:length]), (34, passage[: length - 1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = suffixes.deduplicate(docs, length=length).collect()
    got = sorted((x.id, len(x.text.encode()), sum(s.stop - s.start for s in x.spans), len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in made)
    assert got == deduplicated([(i, t.encode()) for i, t in rows], length)


def test_one_hot_anchor_is_dealt_by_strings(spark, monkeypatch):
    r = random.Random(5)
    pick = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = pick(40)
    rows = [(i, pick(r.randint(0, 25)) + passage[: r.randint(25, 40)] + pick(r.randint(0, 25))) for i in range(400)]
    rows += [(1000 + i, r.choice(rows)[1]) for i in range(60)] + [(7, rows[3][1]), (None, rows[4][1]), rows[5], (2000, "-" * 90), (2001, "-" * 70 + "x")]
    monkeypatch.setattr(suffixes, "HOT", 40, raising=False)
    monkeypatch.setattr(suffixes, "SHARE", 1, raising=False)
    for name, value in (("BLOCK", 4000), ("BUCKET", 300), ("TASK", 1000), ("STRINGS", 500)):
        monkeypatch.setattr(suffixes, name, value, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, real = {}, suffixes.materialize
    monkeypatch.setattr(suffixes, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    made = suffixes.deduplicate(docs, length=30, gram=12).collect()
    got = sorted((suffixes.LAST if x.id is None else x.id, len(x.text.encode()), sum(s.stop - s.start for s in x.spans), len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in made)
    assert got == deduplicated([(suffixes.LAST if i is None else i, t.encode()) for i, t in rows], 30)
    marks = np.concatenate([suffixes.unpacked(x.marks, suffixes.MARK) for x in written["judged"].collect()])
    assert Counter(marks["anchor"][marks["sort"] == 1].tolist()).most_common(1)[0][1] < 2 * 40  # stretches for one suffix array


def components(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    near = materialize(neighbours(spark.createDataFrame(links, "a long, b long")), "near")
    got = {x.node: x.component for x in connected_components(near).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])


def similar(rows):
    """Links and components by comparing all sets of word 5-grams."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    text = dict(rows)
    links = [(a, b) for a in sets for b in sets if a < b and text[a] and (text[a] == text[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    n = Counter(x for pair in links for x in pair)
    low = components(list(sets), links)
    return {i: (n[i], low[i]) for i in sets}


@pytest.fixture(scope="module")
def near(spark):
    r = random.Random(9)
    words = ["w%d" % k for k in range(300)]
    rows, k = [], 0
    for _ in range(12):
        own = [r.choice(words) for _ in range(r.randint(6, 160))]
        for _ in range(r.randint(1, 8)):
            copy = list(own)
            for _ in range(r.choice((0, 0, 1, 2, 6))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, "!!"), (k + 3, "!!"), (k + 4, "one two"), (k + 5, "One, two"), (k + 6, "long " * 30000)]
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, near, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame(near, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = jaccard.near_duplicates(docs).collect()
    assert {x.doc_id: (x.n_links, x.component_id) for x in got} == similar(near)
    assert all(x.kept == (x.component_id == x.doc_id) for x in got)


def test_jaccard_edges(spark, near):
    docs = spark.createDataFrame([(i, t, 1) for i, t in [*near, near[0], near[0], (None, near[5][1]), (None, "only nulls here"), (None, "only nulls here"), (None, "")]], "doc_id long, text string, key int")
    kept = jaccard.deduplicate(docs)
    want = similar(near)
    ids = sorted(x.doc_id for x in kept.where("doc_id is not null").collect())
    assert kept.columns == docs.columns and ids == sorted(i for i, (_, low) in want.items() if i == low)
    assert sorted(x.text for x in kept.where("doc_id is null").collect()) == ["", "only nulls here"]
    assert jaccard.near_duplicates(docs).count() == docs.count()
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0 and jaccard.deduplicate(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches(0.8, jaccard.TOLERANCE)
    g = np.random.default_rng(0)
    draws = g.random((20000, jaccard.VALUES)) < 0.8
    n = np.arange(jaccard.STEP, jaccard.VALUES + 1, jaccard.STEP)
    alive = np.all(draws.cumsum(1)[:, n - 1] >= np.array(least), axis=1)
    assert alive.mean() > 0.999
    assert (np.all((g.random((5000, jaccard.VALUES)) < 0.4).cumsum(1)[:, n - 1] >= np.array(least), axis=1)).mean() < 0.001


@pytest.mark.parametrize("block", [4096, 40])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    g = np.random.default_rng(4)
    base = g.standard_normal((25, 32))
    x = np.concatenate([base[g.integers(0, 25, 200)] + 0.3 * g.standard_normal((200, 32)), g.standard_normal((60, 32)), base[:5], base[:5]])
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] + [1.0] * 31), (n + 3, [float("inf")] + [1.0] * 31), (n + 4, [None] + [1.0] * 31), (n + 5, []), (n + 6, rows[0][1][:16])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("key", F.lit(1))
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(hit, 1)))]
    low = components(list(range(n + 7)), [(int(a), int(b)) for a, b in links])
    count = Counter(int(k) for pair in links for k in pair)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (count[i], low[i], low[i] == i) for i in range(n + 7)}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_collision_count_recall():
    g = np.random.default_rng(1)
    x = g.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = g.standard_normal((3000, 64))
    other -= (other * x).sum(1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    y = 0.9 * x + np.sqrt(1 - 0.81) * other
    i, j = embeddings.candidates(x, y, 0.9, False, embeddings.least_collisions())
    assert (i == j).sum() >= 0.998 * len(x) and len(i) < 0.02 * 3000 * 3000


def mixed(rows):
    """The mix by sorting."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((int(md5(f"{'' if i is None else i}|{md5(t or '')}")[:15], 16), i, size(t)))
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    total = {s: sum(x[2] for x in by[s]) for s in names}
    weight, left, capped = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(total.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (left - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        if not over:
            break
        capped |= {s: 2.0 * total[s] for s in over}
    return names, total, {s: capped.get(s, weight[s] * level) for s in names}


def test_mixing(spark):
    r = random.Random(3)
    rows = [(k, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), r.choice(("a", "b", "é", "z", None, "a", "a"))) for k in range(400)]
    rows += [(401, None, "empty"), (402, "x y", "b"), (402, "x y", "b"), (None, "p q r", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    names, total, target = mixed(rows)
    assert len(got) == len(rows) and all(x.source_size == total[x.source] and abs(x.target - target[x.source]) < 1e-6 and 0 <= x.taken <= 2 * x.size for x in got)
    for s in names:
        assert abs(sum(x.taken for x in got if x.source == s) - target[s]) <= 20
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = mixing.mixed(docs)
    want = Counter()
    for x in got:
        want[x.doc_id] += x.copies
    assert taken.columns == docs.columns and Counter(x.doc_id for x in taken.collect()) == +want
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(12)
    words = ["the", "old", "river", "runs", "slowly", "under", "stone", "bridges", "near", "town", "at", "dawn"]
    prose = lambda: " ".join(r.choice(words) for _ in range(r.randint(30, 120))).capitalize() + "."
    rows = []
    for k in range(160):
        t = prose() if k % 6 else " | ".join(r.choice(("###", "$$$", "%%%")) for _ in range(60))
        rows.append((k, t + (" token=abcdefgh12" if k % 10 == 1 else ""), "en", f"s{k % 3}", len(t)))
    rows += [(200 + k, rows[k + 1][1], "en", "s0", 1) for k in range(4)] + [(300, None, None, None, None), (301, "", "en", "s1", 0), (None, "no id here at all", "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 > 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_stages(spark, folder):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], folder).cache())
    start, good, unique, masked, taken, coded = [x.collect() for x in steps]
    assert all(x.columns == docs.columns for x in steps[:5])
    assert not any("###" in (x.text or "") for x in good) and len(good) >= 130
    assert len({x.text for x in unique if x.text}) == len([x for x in unique if x.text]) and not {200, 201, 202, 203} & {x.doc_id for x in unique}
    low = similar([(x.doc_id, x.text) for x in good if x.doc_id is not None])
    assert {x.doc_id for x in unique if x.doc_id is not None} == {i for i, (_, c) in low.items() if i == c}
    assert sorted(x.doc_id or -1 for x in masked) == sorted(x.doc_id or -1 for x in unique) and not any("abcdefgh12" in (x.text or "") for x in masked)
    assert all(x.n_chars == len(x.text) for x in masked if x.text is not None)
    _, total, target = mixed([(x.doc_id, x.text, x.source) for x in masked])
    for s in total:
        assert abs(sum(len((x.text or "").split()) for x in taken if x.source == s) - target[s]) <= 120
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert sorted((str(x.doc_id), x.ids, x.exact) for x in coded) == sorted((str(x.doc_id), lib.encode(x.text or ""), True) for x in taken)
    assert corpus_pipeline.run(spark, folder).count() == len(coded)


def test_pipeline_over_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_edges_of_a_group_of_near_copies_follow_its_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    seen = []
    classes = jaccard.link_classes

    def counted(reps, found):
        seen.append((found.where("b IS NOT NULL").count(), found.where("b IS NULL").count()))
        return classes(reps, found)

    monkeypatch.setattr(jaccard, "link_classes", counted)
    base = [f"w{k}" for k in range(120)]
    for n in (128, 256, 512):
        docs = spark.createDataFrame([(k, " ".join([*base, f"x{k}"])) for k in range(n)], "doc_id long, text string")
        got = jaccard.near_duplicates(docs).collect()
        assert all(x.component_id == 0 and x.n_links == n - 1 for x in got) and len(got) == n
    # All classes are alike: an edge for each class of a block, and one for each two blocks that meet.
    assert all(edges <= n + (n / 16) ** 2 / 2 and rows <= 2 * n for (edges, rows), n in zip(seen, (128, 256, 512), strict=True)), seen
    print(seen)


def test_pipeline_stages_need_few_columns(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh12", "s"), (2, None, None)], "doc_id long, text string, source string")
    masked = corpus_pipeline.mask_secrets(spark, docs, "")
    assert masked.columns == docs.columns and masked.count() == 2
    coded = corpus_pipeline.encode(spark, docs, "")
    assert coded.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256", "exact"] and coded.count() == 2


def test_embedding_links_of_null_ids_and_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (3, None), (3, None), (4, [0.0, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got if x.vec_id is not None) == [(1, 2, 1, True), (1, 2, 1, True), (3, 0, 3, True), (3, 0, 3, True), (4, 1, 4, True)]
    assert sorted((x.n_links, x.component_id, x.kept) for x in got if x.vec_id is None) == [(1, 4, False), (2, 1, False)]
