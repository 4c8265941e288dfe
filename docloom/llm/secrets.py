"""Secret scans: fixed patterns, and a character convolutional network.

The network reads every candidate, a long token of key characters, what base
spans leave of one, or a match of a fixed pattern, with the characters around
it. It is trained in numpy on labelled findings of two kinds. Those made by rule
are keys, digests, tokens and passwords in settings, headers and prose against
dates, paths, versions, phone numbers, identifiers and rulers in the same
places. Those of documents are candidates of a bounded sample that no fixed
pattern marks, as harmless ones, and made secrets in such documents' own
surroundings. Scores are calibrated on findings held out of the training, and
the threshold is the highest with which the scan keeps the demanded recall
there, its candidates included.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import add_columns
from docloom.llm.common import text_of

KINDS = ("assign", "access", "hex", "neural")
FOUND = "array<struct<kind:string,start:int,stop:int,score:double>>"


def _either(word: str) -> str:
    """Letters outside brackets in either case (ASCII)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns as the scan's contract names them.
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
TOKEN = re.compile("[A-Za-z0-9+/_.=-]{16,}")
HINTS = ("password", "passwd", "secret", "token", "api")

#: Characters before and after a candidate, and of the candidate, that one window shows.
AROUND, INSIDE = 20, 48
LENGTH = 2 * AROUND + INSIDE
RECALL = 0.98
#: The first step size of the fit.
RATE = 0.008
#: Documents (about) and findings in them that the network is fitted on, at most.
DOCUMENTS, FINDINGS = 4000, 4000


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(base spans as (start, stop, kind), candidate tokens) of a text, in code points."""
    found, tokens = [], []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if b - a >= 32:
            found += [(*h.span(), "hex") for h in HEX.finditer(text, a, b)]
        tokens.append((a, b))
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))), tokens


def remains(tokens: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base spans, sorted by start, leave of the tokens (which lie in order and apart)."""
    out, k = [], 0
    covered: list[list[int]] = []
    for a, b, _ in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    for a, b in tokens:
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(covered) and covered[j][0] < b:
            if covered[j][0] > at:
                out.append((at, covered[j][0]))
            at, j = max(at, covered[j][1]), j + 1
        if at < b:
            out.append((at, b))
    return out


# Characters: 0 beyond the text, 1 not ASCII, then ASCII.
def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(c < 128, c + 2, 1).astype(np.uint8)


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, inside marks, index of the span) of windows that cover each whole span."""
    chars, marks, owner = [], [], []
    for k, (a, b) in enumerate(spans):
        for s in range(a, b, INSIDE):
            stop = min(b, s + INSIDE)
            left = text[max(0, s - AROUND) : s]
            seen = left + text[s : stop + AROUND]
            row, mark = np.zeros(LENGTH, np.uint8), np.zeros(LENGTH, np.float32)
            at = AROUND - len(left)
            row[at : at + len(seen)] = _codes(seen)
            mark[AROUND : AROUND + stop - s] = 1
            chars.append(row)
            marks.append(mark)
            owner.append(k)
    if not chars:
        return np.zeros((0, LENGTH), np.uint8), np.zeros((0, LENGTH), np.float32), np.zeros(0, np.int64)
    return np.stack(chars), np.stack(marks), np.array(owner)


class CharCNN:
    """Embedding, one convolution, maximum and mean over the candidate and its surroundings, two dense layers."""

    EMBED, WIDTH, FILTERS, HIDDEN = 10, 5, 32, 16

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        n = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        k = (self.EMBED + 1) * self.WIDTH
        self.w = {"e": n(130, self.EMBED, scale=0.3), "c": n(k, self.FILTERS, scale=(2 / k) ** 0.5), "cb": np.zeros(self.FILTERS, np.float32), "d": n(3 * self.FILTERS, self.HIDDEN, scale=(2 / (3 * self.FILTERS)) ** 0.5), "db": np.zeros(self.HIDDEN, np.float32), "o": n(self.HIDDEN, 1, scale=0.3), "ob": np.zeros(1, np.float32)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, chars, marks):
        w = self.w
        x = np.concatenate([w["e"][chars], marks[..., None]], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - self.WIDTH + 1, -1)
        h = np.maximum(cols @ w["c"] + w["cb"], 0)
        m = marks[:, self.WIDTH // 2 : LENGTH - self.WIDTH // 2, None]
        inner, outer = h * m, h * (1 - m)
        n = np.maximum(m.sum(1), 1)
        f = np.concatenate([inner.max(1), inner.sum(1) / n, outer.max(1)], axis=1)
        z = np.maximum(f @ w["d"] + w["db"], 0)
        return (z @ w["o"] + w["ob"])[:, 0], (cols, h, m, n, inner, outer, f, z)

    def backward(self, chars, kept, g):
        cols, h, m, n, inner, outer, f, z = kept
        w, k = self.w, self.FILTERS
        out = {"o": z.T @ g[:, None], "ob": g.sum(keepdims=True)}
        dz = g[:, None] @ w["o"].T * (z > 0)
        out |= {"d": f.T @ dz, "db": dz.sum(0)}
        df = dz @ w["d"].T
        dh = np.broadcast_to((df[:, None, k : 2 * k] / n[:, None]) * m, h.shape).copy()
        rows, cc = np.arange(len(h))[:, None], np.arange(k)[None]
        for part, a, b in ((inner, 0, m), (outer, 2 * k, 1 - m)):
            at = part.argmax(1)
            dh[rows, at, cc] += df[:, a : a + k] * b[rows, at, 0]
        dh *= h > 0
        flat = dh.reshape(-1, k)
        out |= {"c": cols.reshape(-1, cols.shape[2]).T @ flat, "cb": flat.sum(0)}
        dx = (flat @ w["c"].T).reshape(len(h), h.shape[1], self.WIDTH, self.EMBED + 1)[..., : self.EMBED]
        de = np.zeros_like(w["e"])
        for j in range(self.WIDTH):
            np.add.at(de, chars[:, j : j + h.shape[1]], dx[:, :, j])
        out["e"] = de
        return out

    def scores(self, chars, marks) -> np.ndarray:
        """Calibrated probabilities."""
        raw = [self.forward(chars[i : i + 2048], marks[i : i + 2048])[0] for i in range(0, len(chars), 2048)]
        return 1 / (1 + np.exp(-np.clip(self.scale * np.concatenate(raw) + self.shift, -30, 30))) if raw else np.zeros(0)


def findings_in(docs: DataFrame, text: str = "text", documents: int = DOCUMENTS, bound: int = FINDINGS) -> list[tuple[str, str, str]]:
    """(before, token, after) of candidates of a sample that no fixed pattern touches, and of places between words (an empty token).

    Documents are sampled by a hash of their text, about ``documents`` of them;
    of what they hold, the ``bound`` findings with the lowest hashes are taken.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                base, tokens = base_spans(t)
                rows += [(t[max(0, a - AROUND) : a], t[a : min(b, a + 2 * INSIDE)], t[b : b + AROUND]) for a, b in tokens if not any(c < b and a < d for c, d, _ in base)]
                at = t.find(" ", zlib.crc32(t.encode("utf-8", "surrogatepass")) % max(1, len(t)))
                if at >= 0:
                    rows.append((t[max(0, at + 1 - AROUND) : at + 1], "", t[at : at + AROUND]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(3)], names=["before", "token", "after"])

    n = docs.count()
    near = int(min(1.0, documents / max(1, n)) * (1 << 40))
    picked = docs.select(text_of(text).alias("t")).where((F.col("t") != "") & (F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < near))
    found = picked.mapInArrow(run, "before string, token string, after string").distinct()
    return [tuple(x) for x in found.orderBy(F.xxhash64("before", "token", "after"), "before", "token", "after").limit(bound).collect()]


def labelled_findings(n: int, seed: int, found: list[tuple[str, str, str]] | tuple = ()) -> list[tuple[str, int, int, int]]:
    """(text, start, stop, label); half are secrets, and half have tokens or surroundings of ``found`` if there are any."""
    r = random.Random(seed)
    harmless, places = [x for x in found if x[1]], [x for x in found if not x[1]]
    low, alnum = string.ascii_lowercase, string.ascii_letters + string.digits
    pick = lambda chars, a, b=None: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    word = lambda: "".join(r.choice(("the", "re", "ion", "an", "ei", "gen", "ou", "que", "la", "st", "ma", "nt", "er", "lo", "ti")) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    onset, vowel, coda = "b d f g h k l m n p r s t v w z sch st th ch br tr pl gr".split(), "a e i o u ei au ie ou ea y".split(), ["", "", "", "n", "r", "s", "t", "ng", "ck", "l", "m", "ft", "cht", "x", "mpf", "hrt", "ff", "nd", "rst", "lk", "ph", "ll", "tz", "bst"]
    spoken = lambda a, b: "".join(r.choice(onset) + r.choice(vowel) + r.choice(coda) for _ in range(r.randint(a, b)))
    good = [
        lambda: pick("0123456789abcdef", r.choice((32, 40, 64))),
        lambda: pick(alnum + "+/", 24, 64) + r.choice(("", "=", "==")),
        lambda: pick(string.ascii_uppercase, 4) + pick(string.ascii_uppercase + string.digits, 16),
        lambda: r.choice(("sk", "pk", "key", "tok", "ghx")) + r.choice("_-") + pick(alnum, 20, 48),
        lambda: ".".join(pick(alnum + "_-", n) for n in (20, 36, 27)),
        lambda: pick(alnum, 16, 40),
        lambda: pick(low + string.digits, 20, 40),
    ]
    bad = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}.00",
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 999)}.html",
        lambda: "www." + word() + word() + ".com/" + word() + f"/{r.randint(1, 9999)}",
        lambda: "_".join(word() for _ in range(r.randint(3, 5))) + f"_v{r.randint(1, 20)}",
        lambda: "-".join(str(r.randint(10, 9999)) for _ in range(5)),
        lambda: pick(string.digits, 16, 24),
        lambda: ".".join(str(r.randint(0, 99)) for _ in range(8)),
        lambda: r.choice("-=._") * r.randint(14, 40) + str(r.randint(0, 9)),
        lambda: word() + word() + word() + word() + word() + str(r.randint(0, 99)),
        lambda: "".join(word().capitalize() for _ in range(6)) + str(r.randint(1, 9)),
        lambda: ".".join(word() for _ in range(5)) + str(r.randint(1, 99)),
        lambda: spoken(6, 12),
        lambda: spoken(5, 10).capitalize() + r.choice(("", ".", "...")),
        lambda: spoken(5, 10).upper() + r.choice(("", ".", "...")),
        lambda: "".join(spoken(1, 3).capitalize() for _ in range(r.randint(3, 6))),
        lambda: r.choice("-_/.").join(spoken(1, 3) for _ in range(r.randint(3, 6))),
        lambda: spoken(3, 5) + "." + spoken(3, 5).capitalize(),
        lambda: "www." + spoken(2, 4) + r.choice((".com", ".org/", ".de/")) + spoken(1, 3),
        lambda: r.choice(string.ascii_letters + "-=._+/") * r.randint(16, 90),
        lambda: (spoken(1, 1) or "ha") * r.randint(8, 20),
    ]
    out = []
    for k in range(n):
        secret = k % 2 == 0
        token = r.choice(good if secret else bad)()
        before = r.choice((prose(r.randint(1, 8)) + " ", f"{word()} = ", f"{word()}: ", "key=", "auth: ", "see ", "", prose(2) + ".\n", f'"{word()}": "', "id ", "Bearer "))
        if not secret and r.random() < 0.15:  # the host of a mail address
            before = f"{prose(2)} {word()}.{r.randint(1, 99)}@"
            token = f"{word()}{r.randint(1, 9)}.{word()}{word()}.{r.choice(('com', 'org', 'net', 'de'))}"
        after = r.choice((" " + prose(r.randint(1, 8)), "", "\n" + prose(3), '",', ". " + prose(2)))
        if places and r.random() < 0.5:
            before, _, after = r.choice(places)
        if not secret and harmless and r.random() < 0.5:
            before, token, after = r.choice(harmless)
        text = before + token + after
        out.append((text, len(before), len(before) + len(token), int(secret)))
    return out


@lru_cache(maxsize=4)
def trained(recall: float = RECALL, found: tuple[tuple[str, str, str], ...] = (), n: int = 4000, epochs: int = 10, seed: int = 7) -> CharCNN:
    """A network fitted on ``n`` labelled findings; calibration and threshold come from ``n // 2`` others.

    Every other one of ``found`` serves the fit, the rest the calibration.
    ``held_out`` tells the recall there, the share of harmless findings that are
    marked, and that share among the documents' own (None without any).
    """

    def data(count, seed):
        rows = labelled_findings(count, seed, found[seed % 2 :: 2])
        made = [windows(t, [(a, b)]) for t, a, b, _ in rows]
        y = np.repeat([row[3] for row in rows], [len(m[0]) for m in made]).astype(np.float32)
        row = np.repeat(np.arange(count), [len(m[0]) for m in made])
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), y, row

    net, g = CharCNN(seed), np.random.default_rng(seed)
    chars, marks, y, _ = data(n, seed)
    m1, m2, step = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2)), None, 0
    m1, m2 = tuple(m1)
    for _ in range(epochs):
        order = g.permutation(len(y))
        for i in range(0, len(y), 128):
            at = order[i : i + 128]
            raw, kept = net.forward(chars[at], marks[at])
            grads = net.backward(chars[at], kept, ((1 / (1 + np.exp(-raw)) - y[at]) / len(at)).astype(np.float32))
            step += 1
            rate = RATE * (1 - 0.95 * step / (epochs * -(-len(y) // 128)))  # falls, so that the last batches don't sway the result
            for k, d in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                net.w[k] = (net.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    chars, marks, y, _ = data(n // 2, seed + 1)
    raw = np.concatenate([net.forward(chars[i : i + 1024], marks[i : i + 1024])[0] for i in range(0, len(y), 1024)]).astype(np.float64)
    for _ in range(300):  # calibration: a logistic line through held-out scores
        p = 1 / (1 + np.exp(-np.clip(net.scale * raw + net.shift, -30, 30)))
        net.scale -= 0.05 * float(((p - y) * raw).mean())
        net.shift -= 0.05 * float((p - y).mean())
    # The threshold is set on what the scan itself finds of the held-out secrets: lost candidates count as missed.
    rows = labelled_findings(n // 2, seed + 1, found[(seed + 1) % 2 :: 2])
    scored = candidates([r[0] for r in rows], net)
    best = np.array([certainty(own, a, b) for own, (_, a, b, secret) in zip(scored, rows, strict=True) if secret])
    net.threshold = float(np.clip(np.quantile(best, 1 - recall, method="lower"), 0, 1))
    marked = lambda own, a, b: any(c < b and a < d and (kind != "neural" or score >= net.threshold) for kind, c, d, score in own)
    wrong = [marked(own, a, b) for own, (_, a, b, secret) in zip(scored, rows, strict=True) if not secret]
    theirs = [x for x in found[(seed + 1) % 2 :: 2] if x[1]]
    false = [marked(own, len(x[0]), len(x[0]) + len(x[1])) for own, x in zip(candidates(["".join(x) for x in theirs], net), theirs, strict=True)]
    net.held_out = {"recall": float((best >= net.threshold).mean()), "false": float(np.mean(wrong)), "false_in_documents": float(np.mean(false)) if false else None}
    return net


def fitted(docs: DataFrame, text: str = "text", recall: float = RECALL) -> CharCNN:
    """The network, fitted on findings made by rule and on those of a bounded sample of ``docs``."""
    return trained(recall, tuple(findings_in(docs, text)))


def candidates(texts: list[str], net: CharCNN) -> list[list[list]]:
    """[kind, start, stop, score] of each text's base spans and of all that the network judges."""
    spans, chars, marks, owner = [], [], [], []
    for k, t in enumerate(texts):
        base, tokens = base_spans(t) if t else ([], [])
        free = remains(tokens, base)
        spans.append([[kind, a, b, 0.0] for a, b, kind in base] + [["neural", a, b, 0.0] for a, b in free])
        if spans[-1]:
            c, m, o = windows(t, [(x[1], x[2]) for x in spans[-1]])
            chars.append(c)
            marks.append(m)
            owner += [(k, i) for i in o]
    if chars:
        for (k, i), s in zip(owner, net.scores(np.concatenate(chars), np.concatenate(marks)).tolist(), strict=True):
            spans[k][i][3] = max(spans[k][i][3], s)
    return spans


def certainty(own: list[list], a: int, b: int) -> float:
    """The highest threshold at which a text's candidates cover all of a place: infinite for base spans, -1 for none."""
    best = np.full(b - a, -1.0)
    for kind, c, d, score in own:
        c, d = max(c, a) - a, min(d, b) - a
        if c < d:
            best[c:d] = np.maximum(best[c:d], score if kind == "neural" else np.inf)
    return float(best.min())


def find(texts: list[str], net: CharCNN) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, stop, score) of each text by start, then kind: all base spans, and what the network adds."""
    order = lambda x: (x[1], KINDS.index(x[0]))
    spans = candidates(texts, net)
    return [sorted((tuple(x) for x in own if x[0] != "neural" or x[3] >= net.threshold), key=order) for own in spans]


def scan(df: DataFrame, text: str = "text", found: str = "found", keep: list[str] | None = None, net: CharCNN | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``found``: kind, start, stop and score of each secret.

    Places are code points of the whole text, the end exclusive. Base spans
    always stay, whatever their score. Null and empty texts have none; spans of
    different kinds may overlap; equal texts have equal spans; an empty table
    gives an empty table. A column named as ``found`` is replaced. Without
    ``net`` the network knows findings made by rule only.
    """
    net = net or trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def make(values, net):
        rows = find(values.fill_null("").to_pylist(), net)
        return [pa.array([[dict(zip(("kind", "start", "stop", "score"), x, strict=True)) for x in own] for own in rows], kind)]

    return add_columns(df.withColumn(text, text_of(text)), text, f"`{found}` {FOUND}", make, keep, lambda: net)


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", net: CharCNN | None = None) -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mask`` (overlapping spans by one).

    Columns and their order stay, whatever their names; a text without secrets,
    null too, stays as it is. An empty table gives an empty table; repeated rows
    each get their row.
    """
    net = net or trained()

    def make(values, net):
        texts = values.to_pylist()
        out = []
        for t, own in zip(texts, find([t or "" for t in texts], net), strict=True):
            if own:
                parts, at, stop = [], 0, -1
                for _, a, b, _ in own:
                    if a >= stop:
                        parts += [t[at:a], mask]
                    stop = max(stop, b)
                    at = stop
                t = "".join([*parts, t[at:]])
            out.append(t)
        return [pa.array(out, pa.string())]

    clean = add_columns(df.withColumn(text, F.col(text).cast("string")), text, f"`{text}` string", make, None, lambda: net)
    return clean.select(*df.columns)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, their digest, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs.select("doc_id", "text"), keep=["doc_id"], net=fitted(docs))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda x: x["kind"] != "neural")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )
