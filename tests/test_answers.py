"""Model answers from JSON, stored chunk rows, and look-ups by id."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunk, validate
from docloom.sources import lookup

GOOD = {"sufficient": True, "question_type": "polar", "verdict": "yes", "statements": [], "qualifications": [], "missing": ""}


def plain(raw):
    """What an answer's JSON says, in plain Python."""
    try:
        data = json.loads(raw)
    except (ValueError, TypeError):
        return "no JSON object"
    if not isinstance(data, dict):
        return "no JSON object"
    lacking = [k for k in validate.ANSWER_KEYS if k not in data]
    if lacking:
        return "missing " + ",".join(lacking)
    for name in ("statements", "qualifications"):
        if not isinstance(data[name], list):
            return f"{name} is no array"
        if not all(isinstance(x, dict) for x in data[name]):
            return f"a claim of {name} is no object"
    claims = lambda own: [tuple(str(x.get(k, "")).strip() for k in validate.CLAIM_KEYS) for x in own]
    return bool(data["sufficient"]), str(data["question_type"]).strip(), str(data["verdict"]).strip(), claims(data["statements"]), claims(data["qualifications"]), str(data["missing"]).strip()


def test_answers_equal_plain_python(spark):
    made = [GOOD | {"sufficient": x} for x in (False, None, 0, 0.0, -1, 2.5, "", "no", "false", [], [0], {}, {"a": 1})]
    made += [GOOD | {"statements": x} for x in ([{"text": " é “q” \n", "chunk_id": "c", "quote": "a\"b\\"}], [{}], [{"text": None, "chunk_id": True, "quote": 7}, {"quote": False, "more": 1}], "x", None, ["x"], [{}, None], {"a": 1})]
    made += [GOOD | {"qualifications": x} for x in ([{"text": 1.5}], 3, [[1]])] + [GOOD | {"missing": x, "verdict": x} for x in (None, True, 12, " a ")]
    raw = [json.dumps(x) for x in made] + [json.dumps({k: v for k, v in GOOD.items() if k not in ("verdict", "missing")}), "[1]", "null", "", "{", "no json", json.dumps(GOOD)[:-3], None]
    got = validate.answers_from_json(spark.createDataFrame(list(enumerate(raw)), "n int, raw string"), "raw").collect()
    assert len(got) == len(raw)
    for x in got:
        own = x.error if x.error else (x.sufficient, x.question_type, x.verdict, [tuple(c) for c in x.statements], [tuple(c) for c in x.qualifications], x.missing)
        assert own == plain(x.raw), x.raw


def test_chunk_rows_have_every_field(spark):
    units = spark.createDataFrame([("d", "1", "section", "2", "Two", ["Part I", "Section 2"], "body"), ("e", "1", "section", "1", "One", ["Section 1"], "text")], "document_id string, version string, unit_type string, unit_number string, unit_title string, path array<string>, text string")
    registry = spark.createDataFrame([("d", "1", "act", "The Act", "here", "en", "2020-01-01", None, True, "gazette", "u"), ("d", "0", "act", "Old", "here", "en", "1990-01-01", "2019-12-31", False, "gazette", "u")], "document_id string, version string, " + ", ".join(f"{c} {'boolean' if c == 'in_force' else 'string'}" for c in chunk.HEADER))
    got = {x.document_id: x for x in chunk.chunk_rows(units, registry, F.lit("2024-05-01")).collect()}
    assert list(got["d"].__fields__) == chunk.FIELDS and len(chunk.FIELDS) == 21
    assert tuple(got["d"]) == ("d@v1-part-i-section-2", "d", "act", "The Act", "here", "en", "1", "2020-01-01", None, True, "2024-05-01", "gazette", "u", "section", "2", "Two", ["Part I", "Section 2"], "Part I — Section 2", 1, 1, "body")
    assert got["e"].title is None and got["e"].content == "text"


def test_look_ups_open_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(f"c-{k:05d}", k) for k in range(2000)] + [(None, -1), ("c-00007", 7000)], "chunk_id string, n int")
    lookup.write_sorted(rows, path, "chunk_id", files=16)
    assert lookup.count(spark, path) == 2002
    got = lookup.look_up(spark, path, "chunk_id", ["c-00007", "c-01999", "c-01999", "zz", "c-00007x", None])
    assert sorted(map(tuple, got.collect())) == [("c-00007", 7), ("c-00007", 7000), ("c-01999", 1999)]
    assert len(got.inputFiles()) < 4 < len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert "In(chunk_id" in got._jdf.queryExecution().executedPlan().toString()
    assert lookup.look_up(spark, path, "chunk_id", ["zz"]).count() == 0 and lookup.look_up(spark, path, "chunk_id", []).count() == 0
    with pytest.raises(ValueError, match="at most"):
        lookup.look_up(spark, path, "n", list(range(lookup.MOST + 1)))
    lookup.write_sorted(rows.limit(0), f"{path}0", "chunk_id")
    assert lookup.count(spark, f"{path}0") == 0 and lookup.look_up(spark, f"{path}0", "chunk_id", ["a"]).count() == 0
