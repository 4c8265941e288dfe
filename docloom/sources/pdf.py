"""Pages of PDF files as rows: cross-reference tables and streams, Flate streams, text operators and ToUnicode maps.

Files come as (path, content), as ``binaryFile`` gives them; each is read by one
task. Fonts without a ToUnicode map are taken as Windows-1252. Encrypted files,
other filters and damaged files give a row with an error.
"""

from __future__ import annotations

import math
import re
import zlib
from binascii import unhexlify
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The format's white space, delimiters and escapes.
SPACE, DELIMITERS = rb"\x00\t\n\x0c\r ", rb"()<>\[\]{}/%"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
TOKEN = re.compile(
    rb"(?:[" + SPACE + rb"]|%[^\r\n]*)*(?:(?P<ref>\d+[" + SPACE + rb"]+\d+[" + SPACE + rb"]+R(?![^" + SPACE + DELIMITERS + rb"]))|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))"
    rb"|/(?P<name>[^" + SPACE + DELIMITERS + rb"]*)|(?P<dict><<)|(?P<hex><[0-9A-Fa-f" + SPACE + rb"]*>)|(?P<text>\()|(?P<array>\[)|(?P<end>>>|\])|(?P<word>[^" + SPACE + DELIMITERS + rb"]+|[{}]))"
)
STRING = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\s\S]))|([()])|[^\\()]+")
CHARS, HEX = re.compile(rb"(?:\s*+<(?:[0-9A-Fa-f]{2})++>\s*+<(?:[0-9A-Fa-f]{2})++>)++(?=\s*endbfchar)"), re.compile(rb"[0-9A-Fa-f]+")
ENTRY = re.compile(rb"\s*(\d{10}) \d{5} ([nf])(?=\s)")
STREAM, IMAGE = re.compile(rb"\s*stream\r?\n"), re.compile(rb"[\s\S]*?\sEI\s")
#: A gap in a TJ array of more than so many thousandths of an em is a space.
GAP = 200
#: Codes that Windows-1252 leaves open are U+FFFD.
PLAIN = {bytes([k]): bytes([k]).decode("cp1252", "replace") for k in range(256)}
#: Strings of fewer codes are looked up code by code, others as a whole.
SHORT = 24
#: Compression of written files: four times as fast as the default, for files half as large again.
LEVEL = 1
#: Pages leave in batches of about so many characters.
BATCH = 1 << 20
PAGE = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])


class Ref(NamedTuple):
    number: int


class Name(str):
    pass


class Word(str):
    pass


class Damaged(ValueError):
    pass


@lru_cache(maxsize=1024)
def _word(raw: bytes) -> Word:
    return Word(raw.decode("latin-1"))


@lru_cache(maxsize=1024)
def _name(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))


def _known(make, raw: bytes):
    """Words and names of usual length are made once; longer ones, as in damaged files, are not held."""
    return make(raw) if len(raw) <= 40 else make.__wrapped__(raw)


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """(a literal string whose bracket opens before ``at``, the place behind it)."""
    out, depth = bytearray(), 1
    for m in STRING.finditer(data, at):
        if m[1]:
            out.append(int(m[1], 8) & 255)
        elif m[2]:
            out += b"" if m[2] in (b"\r", b"\n", b"\r\n") else ESCAPES.get(m[2], m[2])
        else:
            depth += {b"(": 1, b")": -1}.get(m[3], 0)
            if not depth:
                return bytes(out), m.end()
            out += m[0]
    raise Damaged("a string does not end")


class Values:
    """The values of a stretch of a file, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def next(self):
        """A number, name, string, list, dict, reference or word; None at the end."""
        m = TOKEN.match(self.data, self.at)
        if m is None:
            return None
        self.at, kind = m.end(), m.lastgroup
        if kind == "ref":
            return Ref(int(m["ref"].split()[0]))
        if kind == "number":
            own = m["number"]
            return float(own) if b"." in own else int(own)
        if kind == "name":
            return _known(_name, m["name"])
        if kind == "hex":
            digits = m["hex"].translate(None, b"<>\x00\t\n\x0c\r ")
            return unhexlify(digits + b"0" * (len(digits) % 2))
        if kind == "text":
            out, self.at = _string(self.data, self.at)
            return out
        if kind in ("dict", "array"):
            own, close = [], ">>" if kind == "dict" else "]"
            while not isinstance(v := self.next(), Word) or v != close:
                if v is None:
                    raise Damaged("a list does not end")
                own.append(v)
            return own if kind == "array" else dict(zip(own[::2], own[1::2], strict=True))
        return _known(_word, m[kind])


class Codes:
    """The text of a font's character codes."""

    #: In the table: the code's text is not one character.
    MANY = 0x110000

    def __init__(self, texts: dict[bytes, str]):
        self.texts, self.size = texts, max(map(len, texts), default=1)
        # Where all codes have one size of 1 or 2 bytes: their characters by number, the last one for all codes above.
        self.table = None
        if self.size in (1, 2) and all(len(c) == self.size for c in texts):
            chars = {int.from_bytes(c, "big"): ord(t) if len(t) == 1 else self.MANY for c, t in texts.items()}
            self.table = np.full(max(chars, default=0) + 2, 0xFFFD, "<u4")
            self.table[list(chars)] = list(chars.values())

    def text(self, raw: bytes) -> str:
        """Codes that the font lacks are U+FFFD."""
        whole = len(raw) // self.size
        if self.table is not None and whole >= SHORT and isinstance(raw, bytes):
            made = self.table.take(np.frombuffer(raw, f">u{self.size}", whole), mode="clip")
            if made.max() < self.MANY:
                return made.tobytes().decode("utf-32-le") + "\ufffd" * (whole * self.size < len(raw))
        return "".join([self.texts.get(raw[k : k + self.size], "\ufffd") for k in range(0, len(raw), self.size)])


class File:
    """The objects of one file by number."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.seen, self.heads, self.fonts = data, {}, {}, {}, {}, {}
        start = re.findall(rb"startxref\s+(\d+)", data[-2048:])
        if not start:
            raise Damaged("no cross-reference")
        at, done = int(start[-1]), set()
        while at is not None and at not in done:
            done.add(at)
            at = self._references(at)
        if "Encrypt" in self.trailer:
            raise Damaged("encrypted")

    def _references(self, at: int) -> int | None:
        """Take in the table or stream at ``at`` (what is known stays) and return where the one before it is."""
        v = Values(self.data, at)
        if v.next() != "xref":
            own, raw = self._object(at)
            w = own["W"]
            numbers = own.get("Index", [0, own["Size"]])
            ids = [k for a, n in zip(numbers[::2], numbers[1::2], strict=True) for k in range(a, a + n)]
            for row, k in enumerate(ids):
                fields, p = [], row * sum(w)
                for size in w:
                    fields.append(int.from_bytes(raw[p : p + size], "big"))
                    p += size
                kind = fields[0] if w[0] else 1
                if kind:
                    self.places.setdefault(k, (fields[1], None) if kind == 1 else (fields[1], fields[2]))
        else:
            while isinstance(first := v.next(), int):
                for k in range(first, first + v.next()):
                    if m := ENTRY.match(self.data, v.at):
                        (place, used), v.at = m.groups(), m.end()
                        place, used = int(place), used.decode()
                    else:
                        place, _, used = v.next(), v.next(), v.next()
                    if used == "n":
                        self.places.setdefault(k, (place, None))
            own = v.next()
            if "XRefStm" in own:
                self._references(own["XRefStm"])
        self.trailer = own | self.trailer
        return own.get("Prev")

    def _object(self, at: int):
        """(value, its stream's bytes or None) of the object at a place."""
        v = Values(self.data, at)
        if not isinstance(v.next(), int) or not isinstance(v.next(), int) or v.next() != "obj":
            raise Damaged(f"no object at {at}")
        own = v.next()
        if (m := STREAM.match(self.data, v.at)) and isinstance(own, dict):
            n = self.get(own["Length"])
            return own, self._decoded(own, self.data[m.end() : m.end() + n])
        return own, None

    def _decoded(self, own: dict, raw: bytes) -> bytes:
        filters, parms = self.get(own.get("Filter", [])), self.get(own.get("DecodeParms")) or {}
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise Damaged(f"filter {f}")
            raw = zlib.decompress(raw)
        parms = (parms[0] if isinstance(parms, list) else parms) or {}
        return raw if parms.get("Predictor", 1) < 10 else _unpredicted(raw, parms.get("Columns", 1), parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)

    def get(self, v):
        """The value that a reference stands for; other values stand for themselves."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.load(v)[0]
        raise Damaged("references go round")

    def load(self, ref: Ref):
        if ref.number not in self.seen:
            at, index = self.places.get(ref.number, (None, None))
            if at is None:
                return None, None
            self.seen[ref.number] = self._object(at) if index is None else (self._packed(at, index), None)
        return self.seen[ref.number]

    def _packed(self, number: int, index: int):
        own, raw = self.load(Ref(number))
        if number not in self.heads:
            head = Values(raw)
            self.heads[number] = [head.next() for _ in range(2 * self.get(own["N"]))]
        return Values(raw, self.get(own["First"]) + self.heads[number][2 * index + 1]).next()

    def pages(self) -> Iterator[str]:
        yield from self._pages(self.get(self.get(self.trailer["Root"])["Pages"]), {}, set())

    def _pages(self, node: dict, above: dict, seen: set) -> Iterator[str]:
        own = self.get(node.get("Resources")) or above
        if "Kids" in node:
            for kid in self.get(node["Kids"]):
                if kid in seen:
                    raise Damaged("pages go round")
                yield from self._pages(self.get(kid), own, seen | {kid})
            return
        fonts = {name: self._font(f) for name, f in (self.get(own.get("Font")) or {}).items()}
        held = node.get("Contents", [])
        held = self.get(held) if isinstance(held, Ref) and isinstance(self.get(held), list) else held
        parts = []
        for r in held if isinstance(held, list) else [held]:
            parts.append(self.load(r)[1] or b"")
            self.seen.pop(r.number, None)  # contents are not held for the rest of the file
        yield shown(b"\n".join(parts), fonts)

    def _font(self, font) -> Codes:
        """A font's codes; those of an object are read once a file."""
        if not isinstance(font, Ref):
            return Codes(self._codes(font))
        if font.number not in self.fonts:
            self.fonts[font.number] = Codes(self._codes(self.get(font)))
        return self.fonts[font.number]

    def _codes(self, font: dict) -> dict[bytes, str]:
        """The text of each character code of a font."""
        if "ToUnicode" not in font:
            return PLAIN
        v, held, codes = Values(self.load(font["ToUnicode"])[1]), [], {}
        text = lambda x: x.decode("utf-16-be", "replace")
        while (x := v.next()) is not None:
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == "beginbfchar" and (m := CHARS.match(v.data, v.at)):  # plain pairs, taken at once
                own = [unhexlify(c) for c in HEX.findall(m[0])]
                codes |= {a: text(b) for a, b in zip(own[::2], own[1::2], strict=True)}
                v.at = m.end()
            elif x == "endbfchar":
                codes |= {a: text(b) for a, b in zip(held[::2], held[1::2], strict=True)}
            elif x == "endbfrange":
                for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=True):
                    low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(high - low + 1):
                        code = (low + k).to_bytes(len(a), "big")
                        codes[code] = text(to[k]) if isinstance(to, list) else text(to[:-2] + (int.from_bytes(to[-2:], "big") + k).to_bytes(2, "big"))
            held = []
        return codes


WINDOWS = Codes(PLAIN)


def _unpredicted(raw: bytes, columns: int, size: int) -> bytes:
    """Rows whose bytes are differences from the left or from above."""
    width, above, out = columns * max(1, size), bytearray(columns * max(1, size)), bytearray()
    for k in range(0, len(raw), width + 1):
        kind, row = raw[k], bytearray(raw[k + 1 : k + 1 + width])
        if kind > 2:
            raise Damaged(f"predictor {kind}")
        for i in range(len(row)):
            row[i] = row[i] + (above[i] if kind == 2 else row[i - size] if kind == 1 and i >= size else 0) & 255
        out, above = out + row, row
    return bytes(out)


def shown(content: bytes, fonts: dict[str, Codes]) -> str:
    """The text that a content stream shows, a line for each line of it."""
    v, held, out, codes, y = Values(content), [], [], WINDOWS, 0.0
    while (x := v.next()) is not None:
        if not isinstance(x, Word):
            held.append(x)
            continue
        if x == "Tf" and held:
            codes = fonts.get(held[0], WINDOWS)
        elif x == "Tj":
            out.append(codes.text(held[-1]))
        elif x == "TJ":
            for own in held[-1]:
                if isinstance(own, bytes):
                    out.append(codes.text(own))
                elif own < -GAP:
                    out.append(" ")
        elif x in ("T*", "'", '"'):
            out.append("\n")
            y = math.nan
            if x != "T*":
                out.append(codes.text(held[-1]))
        elif x in ("Td", "TD") and len(held) == 2 and held[1]:
            out.extend("\n" if out else "")
            y = math.nan
        elif x == "Tm" and len(held) == 6:
            out.extend("\n" if out and held[5] != y else "")
            y = held[5]
        elif x == "BI":  # an image in the stream is passed over
            m = IMAGE.match(content, v.at)
            v.at = m.end() if m else len(content)
        held = []
    return "".join(out)


def to_pdf(pages: list[str]) -> bytes:
    """A small PDF of these pages, a line of text for each of theirs, whatever the characters."""
    whole = "\n".join(pages)
    letters = {c: k + 1 for k, c in enumerate(sorted(set(whole) - {"\n"}))}
    if len(letters) > 0xFFFF:
        raise ValueError("too many different characters")
    coded = [f"<{k:04x}> <{c.encode('utf-16-be', 'surrogatepass').hex()}>" for c, k in letters.items()]
    cmap = "".join(f"{len(coded[i : i + 100])} beginbfchar\n" + "\n".join(coded[i : i + 100]) + "\nendbfchar\n" for i in range(0, len(coded), 100))
    streams = [f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{cmap}".encode()]
    units = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.zeros(max(map(ord, {*letters, "\n"})) + 1, ">u2")
    for c, k in letters.items():
        codes[ord(c)] = k
    digits, at = codes[units].tobytes().hex(), 0
    for p in pages:
        lines = []
        for x in p.split("\n"):
            lines.append(f"<{digits[4 * at : 4 * (at + len(x))]}> Tj")
            at += len(x) + 1
        streams.append(("BT /F 9 Tf 10 TL 0 0 Td\n" + "\nT*\n".join(lines) + "\nET").encode())
    n = len(pages)
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {n} /Kids [{' '.join(f'{5 + k} 0 R' for k in range(n))}] /Resources << /Font << /F 3 0 R >> >> >>".encode(), b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode 4 0 R >>"]
    packed = [zlib.compress(s, LEVEL) for s in streams]
    packed = [b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(s), s) for s in packed]
    bodies += [packed[0], *(f"<< /Type /Page /Parent 2 0 R /Contents {5 + n + k} 0 R >>".encode() for k in range(n)), *packed[1:]]
    out, places = bytearray(b"%PDF-1.5\n"), []
    for k, body in enumerate(bodies):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + 1, body)
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return bytes(out) + f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def read_pages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, page, text, error): a row a page from 1; a file that can't be read is one row with its error alone.

    A file without pages gives no row; a null content is an error.
    """

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(page_batches, "path string, page int, text string, error string")


def page_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Pages of files of (path, content) in batches of about ``limit`` characters; a file's pages stay in one."""
    rows, held = [], 0
    for batch in batches:
        for at, data in zip(batch.column(0), batch.column(1), strict=True):
            at, data = at.as_py(), data.as_py()
            try:
                if data is None:
                    raise Damaged("no content")
                own = [(at, k + 1, t, None) for k, t in enumerate(File(data).pages())]
            except Exception as wrong:  # noqa: BLE001  a damaged file is a row
                own = [(at, None, None, f"{type(wrong).__name__}: {wrong}")]
            rows += own
            held += 100 + sum(len(t or "") + 100 for _, _, t, _ in own)
            if held >= limit:
                yield _page_batch(rows)
                rows, held = [], 0
    if rows:
        yield _page_batch(rows)


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PAGE, strict=True)], schema=PAGE)


@F.pandas_udf(BinaryType())
def pdf_of(pages: pd.Series) -> pd.Series:
    """PDF files of lists of page texts."""
    return pages.map(lambda own: None if own is None else to_pdf(list(own)))


def paged(rows: Column, lines: int) -> Column:
    """The lines of a text as pages of so many.

    ``rows`` should be a column made before: an expression such as ``split``
    would run again for every page, so a long text's work would grow with its square.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / lines).cast("int"))
    return F.transform(starts, lambda k: F.array_join(F.slice(rows, k * lines + 1, lines), "\n"))
