"""Rule tables, adapters, caches, baselines and sinks on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import adapters, evaluate, grounding, validate
from docloom.sources import io


def test_text_problems(spark):
    docs = spark.createDataFrame([(1, "1.\nA\n2.\nB\n2.\n5A.\nPart I – X\nEND"), (2, "no numbers"), (3, None), (4, "1.\n3.\n3.\n")], "doc int, text string")
    schema = "doc int, markers array<struct<name:string,marker:string>>, n_sections int, want_lettered array<string>, n_parts int, n_chapters int, exempt array<int>"
    rules = spark.createDataFrame([(1, [("end", "END"), ("start", "START")], 3, ["5A", "6B"], 2, 0, []), (2, [], 2, [], 0, None, [7]), (3, None, None, None, None, None, None), (4, [], 3, [], 0, 0, [1, 3])], schema)
    got = {tuple(x) for x in validate.text_problems(docs, rules).collect()}
    assert got == {
        (1, "missing marker", "start"), (1, "missing section", "3"), (1, "repeated section", "2"), (1, "missing lettered section", "6B"), (1, "parts", "2 expected, 1 found"),
        (2, "no sections", ""), (4, "missing section", "2"), (4, "stale exemption", "1"),
    }


def test_unit_problems(spark):
    units = spark.createDataFrame([(1, 1, "section", "1", ["Part I", "Section 1"]), (1, 2, "section", "2", ["Part III", "Section 2"]), (1, 3, "section", "3", ["Part II", "Chapter I", "Section 3"])], "doc int, ordinal int, unit_type string, number string, path array<string>")
    schema = "doc int, counts map<string,int>, want_numbers array<string>, depths array<int>, part_order array<string>"
    rules = spark.createDataFrame([(1, {"section": 4, "schedule": 0}, ["1", "9"], [2], ["Part I", "Part II", "Part III"]), (2, {"section": 1}, ["1"], [2], None), (3, None, None, None, None)], schema)
    got = {tuple(x) for x in validate.unit_problems(units, rules).collect()}
    assert got == {(1, "counts", "section 3 of 4"), (1, "missing number", "9"), (1, "path depth", "1"), (1, "part order", "Part I,Part III,Part II"), (2, "counts", "section 0 of 1"), (2, "missing number", "1")}


def test_known_ids_and_questions(spark):
    q = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    kept, unknown = validate.known_only(q, spark.createDataFrame([("a",), ("c",)], "id string"), "id")
    assert [x.id for x in kept.collect()] == ["a"] and [x.id for x in unknown.collect()] == ["b"]
    assert [x.id for x in evaluate.pick_questions(q, spark.createDataFrame([("b",)], "id string")).collect()] == ["b"]
    with pytest.raises(Exception, match="unknown question id z"):
        evaluate.pick_questions(q, spark.createDataFrame([("b",), ("z",)], "id string")).collect()
    both = evaluate.label_suites({"x": q, "y": q.select("id")}).collect()
    assert sorted((r.suite, r.id, r.n) for r in both if r.suite == "x") == [("x", "a", 1), ("x", "b", 2)] and all(r.n is None for r in both if r.suite == "y")


def test_empty_corpus_is_not_checked(spark):
    q = spark.createDataFrame([(1, ["a", "b"])], "id int, expect_any_of array<string>")
    assert [x.expected for x in evaluate.missing_expected(q, spark.createDataFrame([("a",)], "chunk_id string")).collect()] == ["b"]
    assert evaluate.missing_expected(q, spark.createDataFrame([], "chunk_id string")).count() == 0


def test_verdicts(spark):
    rows = [
        (1, None, True, "none", ["stated"], 1, True, "none"), (2, "timeout", None, None, [], 1, None, None), (3, None, False, "none", ["stated"], 1, False, "unresponsive"), (4, None, False, "misreads", ["absent"], 1, False, "misreads"),
        (5, None, True, "none", ["stated", "absent"], 2, False, "absent"), (6, None, True, "none", ["stated"], 2, None, None), (7, None, True, None, ["stated"], 1, False, "none"), (8, None, None, "none", ["stated"], 1, None, "none"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "i int, error string, responsive boolean, defect string, findings array<string>, n_claims int").withColumn("error", evaluate.verdict_error())
    got = {x.i: (x.q, x.h) for x in df.select("i", evaluate.quality().alias("q"), evaluate.headline().alias("h")).collect()}
    assert got == {r[0]: r[6:] for r in rows}


def test_incomparable_runs(spark):
    names = ["embedding_model", "reranker_model", "collection", "tier", "reranked", "rewrite", "rerank_rewrites"]
    kinds = ["string"] * 3 + ["int"] + ["boolean"] * 3
    same = ["e", "r", "c", 1, True, True, False]
    cases = [(same, same, []), (["x", None, "", None, False, None, None], ["e", "r", "c", 2, False, False, True], ["embedding_model", "reranked", "rerank_rewrites"]), (["e", "r", "c", 2, None, False, False], [None, "r", "d", 1, True, True, None], ["collection", "tier", "rewrite"])]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in cases], ", ".join(f"{p}{n} {k}" for p in ("", "b_") for n, k in zip(names, kinds)))
    assert [x[0] for x in df.select(evaluate.incomparable_reasons()).collect()] == [c for _, _, c in cases]


def test_review_sample_fills_up(spark):
    rows = spark.createDataFrame([(i, i % 10 != 0) for i in range(60)], "id int, ok boolean")
    got = evaluate.review_sample(rows, 6).collect()
    assert [x.id for x in got if not x.ok] == [0, 10, 20] and [x.id for x in got if x.ok] == [1, 2, 3]
    assert len(evaluate.review_sample(rows.where("ok"), 6).collect()) == 6


def test_intent_decision(spark):
    c = spark.createDataFrame([("law", [1.0, 0.0]), ("talk", [0.0, 1.0])], "intent string, c array<double>")
    rows = spark.createDataFrame([(1, "Hello!", [1.0, 0.0]), (2, "hm", [0.1, 1.0]), (3, "hm", [1.0, 0.0]), (4, "hm", None), (5, None, [])], "id int, text string, v array<double>")
    got = {x.id: (x.intent, x.by) for x in evaluate.decide_intent(rows, c, "law").collect()}
    assert got == {1: ("greeting", "exact"), 2: ("talk", "centroid"), 3: ("law", "centroid"), 4: ("law", "default"), 5: ("law", "default")}
    assert {x.by for x in evaluate.decide_intent(rows, None, "law").collect()} == {"exact", "default"}


def test_baselines(spark):
    runs = spark.createDataFrame([(1, "s", 0, 5, None), (2, "s", 0, 9, "cached results"), (3, "s", 1, 2, None), (4, "s", 1, 2, None)], "run int, suite string, tier int, at int, refusal string")
    stored = spark.createDataFrame([(90, "s", 0), (91, "s", 2)], "run int, suite string, tier int")
    assert sorted(x.run for x in evaluate.latest_runs(runs).collect()) == [2, 4]
    assert sorted(x.run for x in evaluate.replace_baselines(stored, runs).collect()) == [1, 4, 91]


def test_cache_switches(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", "old")], "key string, value string")
    fresh = lambda missing: missing.select("key", F.lit("new").alias("value"))
    results, new = adapters.through_cache(wanted, cache, fresh)
    assert sorted(map(tuple, results.collect())) == [("a", "old", True), ("b", "new", False), ("b", "new", False)] and [tuple(x) for x in new.collect()] == [("b", "new")]
    assert tuple(adapters.cache_counts(results).first()) == (1, 2)
    results, new = adapters.through_cache(wanted, cache, fresh, read=False, write=False)
    assert {x.value for x in results.collect()} == {"new"} and new.count() == 0


def test_parsers_and_cleaners_by_name(spark):
    docs = spark.createDataFrame([(1, "act", "Part I – X\n1.\nA\nbody"), (2, "constitution", "HERE\nChapter ONE\nN\n1.\nA\nbody")], "doc int, document_type string, text string")
    assert sorted((x.doc, x.unit_type, x.body) for x in adapters.parse_by_type(docs).collect()) == [(1, "section", "body"), (2, "article", "body")]
    with pytest.raises(Exception, match="no parser for bill; there are act, constitution"):
        adapters.parse_by_type(docs.withColumn("document_type", F.lit("bill"))).collect()
    texts = spark.createDataFrame([("a", "front\nGO one\nHEAD\ntwo\nSTOP x"), ("b", "plain"), ("c", "nothing")], "document_id string, text string")
    specs = spark.createDataFrame([("a", "GO", "STOP", "HEAD\\n"), ("c", "GO", None, None)], "document_id string, start string, end string, header string")
    got = {x.document_id: (x.clean, x.error) for x in adapters.clean_by_document(texts, specs).collect()}
    assert got == {"a": ("GO one\ntwo\n", None), "b": ("plain\n", None), "c": (None, "no start marker")}


def test_encoder(spark):
    encode = adapters.encoder(lambda: lambda texts: np.array([[len(t), 1] for t in texts]))
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "i int, content string")
    assert [x.v for x in rows.select(encode(F.col("content")).alias("v")).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    got = adapters.index_chunks(rows, encode, F.lit("Act"), F.lit("Bail"), F.lit("Part 1")).collect()
    assert [x.vector[0] for x in got] == [len("Act\nPart 1: Bail\n\nabc"), len("Act\nPart 1: Bail\n\n")]


def test_replacing_a_table_checks_its_schema(spark, tmp_path):
    path, rows = f"{tmp_path}/t", spark.createDataFrame([(1, "a")], "x int, y string")
    io.replace_table(rows, path)
    io.replace_table(rows.limit(0), path)
    other = spark.createDataFrame([(1, 2)], "x int, z int")
    with pytest.raises(ValueError, match="y string -> None, z None -> int"):
        io.replace_table(other, path)
    assert spark.read.parquet(path).columns == ["x", "y"]
    io.replace_table(other, path, recreate=True)
    assert spark.read.parquet(path).columns == ["x", "z"]


def test_upsert_keeps_the_same_row_of_a_point(spark, tmp_path):
    rows = [("p", "d", "v", "b", 1), ("p", "d", "v", "a", 2), ("q", "d", "v", "c", 3)]
    for k, order in enumerate((rows, rows[::-1])):
        io.upsert(spark.createDataFrame(order, "point_id string, document_id string, version string, content string, n int"), f"{tmp_path}/{k}")
        assert sorted((x.point_id, x.content, x.n) for x in spark.read.parquet(f"{tmp_path}/{k}").collect()) == [("p", "a", 2), ("q", "c", 3)]


def test_yaml_and_text_sources(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "q.yaml").write_text("questions:\n- {id: a, question: why}\n- {id: b}\n")
    (tmp_path / "empty.yaml").write_text("")
    assert [tuple(x) for x in io.read_yaml_rows(spark, f"{tmp_path}/q.yaml", "id string, question string", "questions").collect()] == [("a", "why"), ("b", None)]
    assert io.read_yaml_rows(spark, f"{tmp_path}/empty.yaml", "id string", "questions").count() == 0
    (tmp_path / "t.txt").write_text("é")
    assert io.read_texts(spark, f"{tmp_path}/t.txt").first().text == "é"


def test_unicode_quotes(spark):
    content = "The oﬃcial salary of the straße debtor is due on the first day of each month"
    claims = spark.createDataFrame([(1, 0, "statement", "c", "official salary of the STRASSE debtor is due"), (1, 1, "statement", "c", "official salary of the debtor is due on the")], "answer int, pos int, kind string, chunk_id string, quote string")
    got = grounding.verify(claims, spark.createDataFrame([(1, "c", content)], "answer int, chunk_id string, content string")).orderBy("pos").collect()
    assert [x.failure for x in got] == [None, "unsupported_quote"]


def test_unicode_forms_in_the_jvm(spark):
    """NFKC and case folding of all assigned characters, and of strings of marks, jamo and ligatures."""
    import random
    import unicodedata

    r = random.Random(5)
    letters = [*"aeßẞﬁＡ①Å가각각\u0301\u0323\u0307\u0327½㌔İſςǰ\u0345ᾳ"]
    rows = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rows += ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(20000)]
    made = spark.createDataFrame([(x,) for x in rows] + [(None,)], "s string").select("s", grounding.nfkc(F.col("s")).alias("n"), grounding.casefold(F.col("s")).alias("c")).collect()
    assert all(x.n == unicodedata.normalize("NFKC", x.s) and x.c == x.s.casefold() for x in made if x.s is not None)
    assert [tuple(x) for x in made if x.s is None] == [(None, None, None)]


def test_verification_runs_no_python(spark):
    claims = spark.createDataFrame([(1, 0, "statement", "c", "ＴＨＥ ﬁrst part of the long quoted sentence")], "answer int, pos int, kind string, chunk_id string, quote string")
    sources = spark.createDataFrame([(1, "c"), (1, "c")], "answer int, chunk_id string")
    passages = spark.createDataFrame([("c", "Of the first part of the long quoted sentence."), ("d", None)], "chunk_id string, content string")
    made = grounding.verify(claims, sources, passages)
    assert [x.failure for x in made.collect()] == [None]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_more_classes_than_are_broadcast_are_an_error(spark, monkeypatch):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id int, v array<double>")
    centroids = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])], "intent string, c array<double>")
    assert evaluate.classify_by_centroid(vectors, centroids, "b").first().intent == "a"
    monkeypatch.setattr(evaluate, "CLASSES", 2)
    with pytest.raises(Exception, match="more than 2 classes"):
        evaluate.classify_by_centroid(vectors, centroids, "b").collect()


def test_units_are_parsed_once(spark):
    """What the units come from is not run again for each rule, and ends are stripped by character."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    units = spark.createDataFrame([(1, 1, "section", "1", ["Part I"]), (1, 2, "section", "2", ["Part I"])], "doc int, ordinal int, unit_type string, number string, path array<string>")
    rules = spark.createDataFrame([(1, {"section": 2}, ["1", "3"], [1], ["Part I"])], "doc int, counts map<string,int>, want_numbers array<string>, depths array<int>, part_order array<string>")
    found = validate.unit_problems(units.mapInArrow(passed, units.schema), rules).collect()
    assert [tuple(x) for x in found] == [(1, "missing number", "3")] and seen.value == 2
    assert spark.createDataFrame([(" \t\x0b a b \f\r\n",)], "t string").select(text.strip(F.col("t"))).first()[0] == "a b"
