"""Pages of PDF files that the tests write."""

import random
import zlib

import pyarrow as pa
import pytest

from docloom.catalog import QUERIES
from docloom.sources import io, pdf


def assembled(bodies, root=1, head=b"%PDF-1.4\n"):
    """A file with a plain cross-reference table."""
    out, places = bytearray(head), []
    for k, b in enumerate(bodies):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + 1, b)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(bodies) + 1, table, len(bodies) + 1, root, len(out))


def stream(raw, more=b"", flate=False):
    raw = zlib.compress(raw) if flate else raw
    return b"<< /Length %d %s%s >>\nstream\r\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode " if flate else b"", more, raw)


def one_page(content, font=b"<< /Type /Font /Subtype /Type1 >>", more=(), contents=b"4 0 R"):
    return assembled([b"<< /Pages 2 0 R >>", b"<< /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents %s >>" % contents, stream(content), font, *more])


def texts(data):
    return list(pdf.File(data).pages())


def test_operators_and_strings():
    content = rb"""BT /F1 12 Tf 1 0 0 1 72 700 Tm (Section \(1\) \101\
B) Tj % a comment (not shown) Tj
0 -14 Td [(Hel) 20 (lo) -300 (wor\tld)] TJ T* <48 69 2> Tj (next) ' 1 2 (nested (brackets) stay) " 5 0 Td ( same line) Tj
BI /W 1 ID (not) Tj EI 1 0 0 1 72 700 Tm (top) Tj 1 0 0 1 99 700 Tm (\223q\224) Tj ET"""
    assert texts(one_page(content)) == ["Section (1) AB\nHello wor\tld\nHi \nnext\nnested (brackets) stay same line\ntop“q”"]


def test_maps_and_arrays_of_contents():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00660069> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079007A>] endbfrange endcmap"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"
    made = one_page(b"BT /F1 9 Tf <0001000200100011> Tj", font, [stream(cmap, flate=True), stream(b"<0012002000210099> Tj ET", flate=True), b"[4 0 R 7 0 R]"], b"8 0 R")
    assert texts(made) == ["fi😀ABCxyz�"]


def test_cross_reference_streams_and_packed_objects():
    packed = [b"<< /Pages 2 0 R >>", b"<< /Kids [3 0 R 3 0 R] >>", b"<< /Contents 4 0 R /Resources << /Font << /F << >> >> >> >>"]
    head, at = b"", 0
    for k, p in enumerate(packed):
        head += b"%d %d " % (k + 1, at)
        at += len(p) + 1
    out = bytearray(b"%PDF-1.5\n")
    four = len(out)
    out += b"4 0 obj\n" + stream(b"BT /F 1 Tf (page) Tj ET") + b"\nendobj\n"
    five = len(out)
    out += b"5 0 obj\n" + stream(head + b" ".join(packed), b"/Type /ObjStm /N 3 /First %d " % len(head), flate=True) + b"\nendobj\n"
    six = len(out)
    rows = [(0, 0, 0), (2, 5, 0), (2, 5, 1), (2, 5, 2), (1, four, 0), (1, five, 0), (1, six, 0)]
    plain, raw = [bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows], b""
    above = bytes(4)
    for r in plain:  # the predictor that takes the row above
        raw += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above))
        above = r
    out += b"6 0 obj\n" + stream(raw, b"/Type /XRef /W [1 2 1] /Size 7 /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >> ", flate=True) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % six
    assert texts(bytes(out)) == ["page", "page"]


def test_later_tables_win():
    old = one_page(b"BT /F1 1 Tf (old) Tj ET")
    at = len(old)
    new = old + b"\n4 0 obj\n" + stream(b"BT /F1 1 Tf (new) Tj ET") + b"\nendobj\n"
    begin = old.rindex(b"startxref")
    before = int(old[begin:].split()[1])
    new += b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Prev %d >>\nstartxref\n%d\n" % (at + 1, before, new.index(b"xref\n4 1") if b"xref\n4 1" in new else len(new))
    assert texts(new) == ["new"]


def test_round_trip_and_damage(spark):
    r = random.Random(3)
    many = [["".join(r.choice("aé中😀 \t(\\<%\n") for _ in range(r.randint(0, 80))) for _ in range(r.randint(1, 5))] for _ in range(40)]
    for pages in many:
        assert texts(pdf.to_pdf(pages)) == pages
    good = pdf.to_pdf(["first", "second\nline"])
    loop = assembled([b"<< /Pages 2 0 R >>", b"<< /Kids [2 0 R] >>"])
    files = [("a", good), ("b", good[:-40]), ("c", b""), ("d", None), ("e", good.replace(b"FlateDecode", b"OtherDecode")), ("f", loop), ("g", good[:300] + b"\x00" * 40 + good[340:]), ("h", good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 3 0 R")), ("i", assembled([b"<< /Pages 2 0 R >>", b"<< /Kids [] >>"]))]
    got = pdf.read_pages(spark.createDataFrame(files, "path string, content binary")).collect()
    assert [(x.page, x.text) for x in got if x.path == "a"] == [(1, "first"), (2, "second\nline")]
    for name in "bcdefgh":
        own = [x for x in got if x.path == name]
        assert len(own) == 1 and own[0].page is None and own[0].text is None and own[0].error, name
    assert not [x for x in got if x.path == "i"]
    with pytest.raises(pdf.Damaged):
        pdf.Values(b"(never").next()


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(pdf.to_pdf(["one", "two"]))
    (tmp_path / "y.pdf").write_bytes(b"no file")
    pages = pdf.read_pages(spark.read.format("binaryFile").load(str(tmp_path)))
    whole = io.pages_to_text(pages.where("error IS NULL"), "path", "page", "text").collect()
    assert [(x.text, x.pages) for x in whole] == [("\n--- PAGE 1 ---\n\none\n\n--- PAGE 2 ---\n\ntwo", 2)] and pages.where("error IS NOT NULL").count() == 1


def tokens(data, monkeypatch):
    """(pages, values read from the file and its streams)."""
    n, own = [0], pdf.Values.next
    with monkeypatch.context() as m:
        m.setattr(pdf.Values, "next", lambda v: (n.__setitem__(0, n[0] + 1), own(v))[1])
        return texts(data), n[0]


def test_fonts_are_read_once_a_file(monkeypatch):
    letters = "".join(map(chr, range(300, 700)))
    few, many = (tokens(pdf.to_pdf([letters] + ["x"] * n), monkeypatch) for n in (20, 40))
    assert len(many[0]) == 41 and many[0][0] == letters and many[1] - few[1] < 20 * 100


def test_heads_of_packed_objects_are_read_once(monkeypatch):
    def packed(n):
        objects = [b"<< /Pages 2 0 R >>", b"<< /Kids [%s] >>" % b" ".join(b"%d 0 R" % (4 + k) for k in range(n)), b"null", *[b"<< /Resources << >> /Contents []>>"] * n]
        head, at = b"", 0
        for k, p in enumerate(objects):
            head += b"%d %d " % (k + 1, at)
            at += len(p) + 1
        last = len(objects) + 1
        out = b"%PDF-1.5\n" + b"%d 0 obj\n" % last + stream(head + b" ".join(objects), b"/Type /ObjStm /N %d /First %d " % (len(objects), len(head))) + b"\nendobj\n"
        rows = [(0, 0, 0), *[(2, last, k) for k in range(len(objects))], (1, 9, 0)]
        raw = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in rows)
        return out + b"%d 0 obj\n" % (last + 1) + stream(raw, b"/Type /XRef /W [1 4 2] /Size %d /Root 1 0 R " % len(rows)) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % len(out)

    few, many = (tokens(packed(n), monkeypatch) for n in (50, 100))
    assert many[0] == [""] * 100 and many[1] - few[1] < 50 * 40


def test_what_follows_a_string_is_not_copied():
    copied = [0]

    class Counted(bytes):
        def __getitem__(self, k):
            got = super().__getitem__(k)
            copied[0] += len(got) if isinstance(k, slice) else 1
            return got

    assert pdf.shown(Counted(b"(a\\)b) Tj " * 500), {}) == "a)b" * 500 and copied[0] < 10_000


def test_codes_at_once_and_one_by_one():
    r = random.Random(5)
    for size in (1, 2, 3):
        code = lambda: bytes(r.randrange(4) for _ in range(size))  # noqa: E731, B023
        for values in ("xé中😀", ["ab", "", "x"], ""):
            known = {code(): r.choice(values) for _ in range(9 * bool(values))}
            made = pdf.Codes(known)
            for n in (0, 1, 30, 301):
                raw = b"".join(code() for _ in range(n)) + b"\x01" * r.randrange(2)
                assert made.text(raw) == "".join(known.get(raw[k : k + made.size], "�") for k in range(0, len(raw), made.size))


def test_few_and_low_characters():
    for pages in (["\t\n\t"], ["\x00", "\n", ""], [""], ["\n\n"], ["\t"], [], ["\U0010ffff\n\ufffe"], ["".join(map(chr, range(0x4E00, 0x9000)))]):
        assert texts(pdf.to_pdf(pages)) == pages


def test_pages_of_many_files_leave_together():
    files = [(str(k), pdf.to_pdf([f"page {k}", "second"])) for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], names=["path", "content"])
    whole, parts = list(pdf.page_batches(iter([batch, batch]))), list(pdf.page_batches(iter([batch]), 3000))
    assert len(whole) == 1 and whole[0].num_rows == 1200 and 1 < len(parts) < 60
    rows = [x for p in parts for x in p.to_pylist()]
    assert rows == [{"path": p, "page": k, "text": t, "error": None} for p, _ in files for k, t in ((1, f"page {p}"), (2, "second"))]
    assert list(pdf.page_batches(iter([]))) == []


def test_lines_are_split_once_a_document(spark):
    for _ in range(2):
        plan = QUERIES["pdf_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        written = plan[plan.index("ArrowEvalPython [pdf_of(") : plan.index("], [pythonUDF0")]
        assert "split(" not in written and plan.count("split(") == 1
