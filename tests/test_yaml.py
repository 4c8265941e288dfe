"""YAML lists as rows, broken files and entries included."""

import pytest

from docloom.sources import io


def test_files_are_suites_and_faults_are_rows(spark, tmp_path):
    (tmp_path / "product.yaml").write_text("questions:\n- {id: a, n: 1, w: 2, tags: [x, null]}\n- {id: b, n: '1', other: 9}\n- just text\n- {n: 3}\n- {id: null, tags: [1], n: true}\n")
    (tmp_path / "empty.yml").write_text("")
    (tmp_path / "none.yaml").write_text("other: []")
    (tmp_path / "list.yaml").write_text("questions: {id: a}")
    (tmp_path / "broken.yaml").write_text("questions: [{")
    (tmp_path / "bytes.yaml").write_bytes(b"\xff\xfe\x00")
    got = io.read_yaml_lists(spark, str(tmp_path), "id string, n int, w double, tags array<string>", "questions", ("id",))
    assert got.columns == ["suite", "row", "id", "n", "w", "tags", "error"]
    rows = {(x.suite, x.row): tuple(x)[2:] for x in got.collect()}
    assert rows == {
        ("product", 0): ("a", 1, 2.0, ["x", None], None),
        ("product", 1): ("b", None, None, None, "n is no int"),
        ("product", 2): (None, None, None, None, "no mapping"),
        ("product", 3): (None, 3, None, None, "id is missing"),
        ("product", 4): (None, None, None, None, "id is missing; n is no int; tags is no array<string>"),
        ("list", None): (None, None, None, None, "unreadable: ValueError"),
        ("broken", None): (None, None, None, None, "unreadable: ParserError"),
        ("bytes", None): (None, None, None, None, "unreadable: UnicodeDecodeError"),
    }
    with pytest.raises(ValueError, match="map"):
        io.read_yaml_lists(spark, str(tmp_path), "m map<string,string>", "questions")
