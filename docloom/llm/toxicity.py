"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters with its own vector (for words of the training vocabulary) and
the means of its character n-gram vectors. The network reads overlapping windows
that cover the whole text, and a text's score is that of its most toxic window,
calibrated on labelled texts that took no part in the fitting.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import BLOCK_BYTES, add_columns
from docloom.llm.common import text_of

WORDS = re.compile(r"\w+").findall
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 48, 36
HIDDEN, WORD_DIM, CHAR_DIM, VOCABULARY = 10, 8, 8, 8000
#: Lengths of character n-grams, with the number of hashed vectors of each.
GRAMS = {3: 1 << 13, 5: 1 << 15}
#: Labelled texts of each class that the model is fitted on, at most.
SAMPLE = 2000
CHUNK = 2048


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id is in fold 1 (never held out)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)), F.lit(1))


def starts(n: int) -> range:
    """Starts of the windows over ``n`` words: one at least, the last reaches the end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


@dataclass
class Words:
    """A block of texts as distinct words, and windows of indices into them (-1: no word)."""

    distinct: list[str]
    index: np.ndarray
    per_text: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Words:
        found = [WORDS(t.lower()) if t else [] for t in texts]
        flat = [w for own in found for w in own]
        at = dict.fromkeys(flat)
        distinct = list(at)
        at = dict(zip(distinct, range(len(distinct)), strict=True))
        ids = np.fromiter(map(at.__getitem__, flat), np.int64, len(flat))
        size = np.array([len(own) for own in found], np.int64)
        begin = size.cumsum() - size
        per = np.array([len(starts(n)) for n in size.tolist()], np.int64)
        first = np.repeat(begin, per) + (np.arange(per.sum()) - np.repeat(per.cumsum() - per, per)) * STRIDE
        place = first[:, None] + np.arange(WINDOW)
        inside = place < np.repeat(begin + size, per)[:, None]
        index = np.where(inside, np.append(ids, -1)[np.minimum(place, len(ids))], -1)
        return Words(distinct, index, per)


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words with their edges marked, how many each word has)."""
    size = np.array([len(w) for w in words], np.int64) + 4
    code = np.frombuffer("".join(f"<{w}>>>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ code[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = np.arange(len(h)) + n <= np.repeat(size.cumsum(), size)[: len(h)]
    return (h % np.uint64(GRAMS[n])).astype(np.int64)[inside], size - n + 1


def means(table: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean vector of each word's n-grams."""
    return np.add.reduceat(table[at], size.cumsum() - size, axis=0) / size[:, None].astype(np.float32)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class BiGRU:
    vocabulary: dict[str, int]
    w: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    report: dict = field(default_factory=dict)

    @staticmethod
    def fresh(vocabulary: list[str], odds: np.ndarray, seed: int = 5) -> BiGRU:
        g = np.random.default_rng(seed)
        n = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM * len(GRAMS), HIDDEN
        w = {"word": n(len(vocabulary) + 1, WORD_DIM, scale=0.1)} | {f"g{k}": n(size, CHAR_DIM, scale=0.1) for k, size in GRAMS.items()}
        w["word"][0] = 0
        w["word"][1:, 0] = odds
        for side in "fb":
            w |= {f"x{side}": n(d, 3 * h, scale=d**-0.5), f"u{side}": n(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
        w |= {"a": n(2 * h, 8, scale=0.3), "v": n(8, 1, scale=0.3), "o": n(2 * h, 1, scale=0.3), "ob": np.zeros(1, np.float32)}
        return BiGRU({x: i + 1 for i, x in enumerate(vocabulary)}, w)

    def inputs(self, words: list[str]):
        ids = np.fromiter((self.vocabulary.get(x, 0) for x in words), np.int64, len(words))
        if not words:
            return ids, {}, np.zeros((0, WORD_DIM + CHAR_DIM * len(GRAMS)), np.float32)
        own = {n: grams(words, n) for n in GRAMS}
        return ids, own, np.concatenate([self.w["word"][ids], *(means(self.w[f"g{n}"], *own[n]) for n in GRAMS)], axis=1)

    def direction(self, side: str, proj: np.ndarray, index: np.ndarray, kept: list | None):
        """Hidden states (windows, places, HIDDEN); ``proj`` has a last row for no word."""
        u, h = self.w["u" + side], np.zeros((len(index), HIDDEN), np.float32)
        out = np.empty((len(index), WINDOW, HIDDEN), np.float32)
        k = HIDDEN
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            at = index[:, t]
            p, q = proj[at], h @ u
            zr = _sigmoid(p[:, : 2 * k] + q[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(p[:, 2 * k :] + r * q[:, 2 * k :])
            m = (at >= 0).astype(np.float32)[:, None]
            new = h + m * ((1 - z) * (n - h))
            if kept is not None:
                kept.append((t, h, z, r, n, q[:, 2 * k :], m))
            h = new
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        hs = []
        for side in "fb":
            proj = np.concatenate([x @ self.w["x" + side] + self.w["c" + side], np.zeros((1, 3 * HIDDEN), np.float32)])
            steps = [] if kept is not None else None
            hs.append(self.direction(side, proj, index, steps))
            if kept is not None:
                kept[side] = steps
        h = np.concatenate(hs, axis=2)
        a = np.tanh(h @ self.w["a"])
        s = np.where(index >= 0, (a @ self.w["v"])[..., 0], -1e9)
        e = np.exp(s - s.max(1, keepdims=True)) * (index >= 0)
        p = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        c = (p[..., None] * h).sum(1)
        if kept is not None:
            kept |= {"h": h, "a": a, "p": p, "c": c}
        return (c @ self.w["o"] + self.w["ob"])[:, 0]

    def backward(self, x, ids, own, index, kept, g) -> dict[str, np.ndarray]:
        w, h, a, p, c = self.w, kept["h"], kept["a"], kept["p"], kept["c"]
        out = {"o": c.T @ g[:, None], "ob": g.sum(keepdims=True)}
        dc = g[:, None] @ w["o"].T
        dp = (h * dc[:, None]).sum(2)
        ds = p * (dp - (p * dp).sum(1, keepdims=True))
        da = ds[..., None] * w["v"][:, 0] * (1 - a * a)
        out |= {"v": np.einsum("bta,bt->a", a, ds)[:, None], "a": np.einsum("bth,bta->ha", h, da)}
        dh_all = p[..., None] * dc[:, None] + da @ w["a"].T
        dx, k = np.zeros((len(x) + 1, x.shape[1]), np.float32), HIDDEN
        for side, part in (("f", dh_all[..., :k]), ("b", dh_all[..., k:])):
            u, du, dproj = w["u" + side], np.zeros_like(w["u" + side]), np.zeros((len(x) + 1, 3 * k), np.float32)
            dh = np.zeros((len(index), k), np.float32)
            for t, prev, z, r, n, qn, m in reversed(kept[side]):
                dh = dh + part[:, t]
                dm = dh * m
                dn = dm * (1 - z) * (1 - n * n)
                dz = dm * (prev - n) * z * (1 - z)
                dr = dn * qn * r * (1 - r)
                dq = np.concatenate([dz, dr, dn * r], axis=1)
                du += prev.T @ dq
                np.add.at(dproj, index[:, t], np.concatenate([dz, dr, dn], axis=1))
                dh = dh * (1 - m) + dm * z + dq @ u.T
            dproj = dproj[:-1]
            out |= {"u" + side: du, "x" + side: x.T @ dproj, "c" + side: dproj.sum(0)}
            dx[:-1] += dproj @ w["x" + side].T
        dx = dx[:-1]
        out["word"] = np.zeros_like(w["word"])
        np.add.at(out["word"], ids, dx[:, :WORD_DIM])
        out["word"][0] = 0
        for k, (n, (at, size)) in enumerate(own.items()):
            a = WORD_DIM + k * CHAR_DIM
            out[f"g{n}"] = np.zeros_like(w[f"g{n}"])
            np.add.at(out[f"g{n}"], at, np.repeat(dx[:, a : a + CHAR_DIM] / size[:, None], size, axis=0))
        return out

    def window_scores(self, block: Words) -> np.ndarray:
        x = self.inputs(block.distinct)[2]
        return np.concatenate([self.forward(x, block.index[i : i + CHUNK]) for i in range(0, len(block.index), CHUNK)])

    def text_scores(self, texts: list[str | None]) -> np.ndarray:
        """Logit of the most toxic window of each text."""
        block = Words.of(texts)
        if not len(texts):
            return np.zeros(0)
        return np.maximum.reduceat(self.window_scores(block), block.per_text.cumsum() - block.per_text).astype(np.float64)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def fit(texts: list[str], toxic: list[int], weight: tuple[float, float] = (1.0, 1.0), epochs: int = 6, seed: int = 5) -> BiGRU:
    """A network fitted on labelled texts; every fifth text only calibrates.

    Labels belong to texts, not to windows: a toxic text teaches its window with
    the highest log-odds of words and n-grams, a clean one that window and one other. ``weight``
    are the classes' weights (clean, toxic) in the calibration, so that a sample
    with evened classes still gives probabilities for the whole.
    Without both classes the score is the label that all have (0 if none).
    """
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        net = BiGRU.fresh([], np.zeros(0, np.float32))
        net.scale, net.shift = 0.0, (4.0 if len(y) and y[0] else -4.0)
        return net
    held = np.arange(len(y)) % 5 == 4
    held &= bool(held.any() and len(set(y[held])) == 2)
    fit_at = np.flatnonzero(~held)
    n = np.bincount(y[fit_at], minlength=2)

    def log_odds(c: np.ndarray) -> np.ndarray:
        odds = np.log((c[:, 1] + 0.5) / (n[1] + 1)) - np.log((c[:, 0] + 0.5) / (n[0] + 1))
        return np.clip(odds * (1 - 2 / (c.sum(1) + 2)), -3, 3).astype(np.float32)

    count: dict[str, list[int]] = {}
    parts = {k: np.zeros((size, 2)) for k, size in GRAMS.items()}
    for i in fit_at:
        words = list(dict.fromkeys(WORDS((texts[i] or "").lower())))
        for x in words:
            count.setdefault(x, [0, 0])[y[i]] += 1
        for k in GRAMS if words else ():
            parts[k][np.unique(grams(words, k)[0]), y[i]] += 1
    known = sorted((x for x, c in count.items() if sum(c) >= 3), key=lambda x: (-sum(count[x]), x))[:VOCABULARY]
    odds = log_odds(np.array([count[x] for x in known], np.float64).reshape(-1, 2))
    net, g = BiGRU.fresh(known, odds, seed), np.random.default_rng(seed)
    for k, c in parts.items():
        net.w[f"g{k}"][:, 0] = log_odds(c)
    block = Words.of([texts[i] for i in fit_at])
    ids, own, first = net.inputs(block.distinct)
    value = np.append(first[:, 0] + first[:, WORD_DIM + CHAR_DIM * (len(GRAMS) - 1)], 0.0)
    heat = np.maximum(value[block.index], 0)
    heat = heat.max(1) + 0.1 * heat.sum(1)
    ends = block.per_text.cumsum()
    pick, label = [], []
    for k, i in enumerate(fit_at):
        a, b = ends[k] - block.per_text[k], ends[k]
        pick.append(a + int(heat[a:b].argmax()))
        label.append(y[i])
        if not y[i] and b - a > 1:
            pick.append(int(g.integers(a, b)))
            label.append(0)
    pick, label = np.array(pick), np.array(label, np.float32)
    offset = {k: size.cumsum() - size for k, (_, size) in own.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = g.permutation(len(pick))
        for i in range(0, len(order), 128):
            at = order[i : i + 128]
            used, index = np.unique(block.index[pick[at]], return_inverse=True)
            index = index.reshape(len(at), WINDOW) - (used[0] < 0)
            used = used[used >= 0]
            b_ids = np.where(g.random(len(used)) < 0.15, 0, ids[used])
            b_own = {}
            for k, (at_gram, size) in own.items():
                b_size = size[used]
                b_own[k] = at_gram[np.repeat(offset[k][used] - (b_size.cumsum() - b_size), b_size) + np.arange(b_size.sum())], b_size
            x = np.concatenate([net.w["word"][b_ids], *(means(net.w[f"g{k}"], *b_own[k]) for k in GRAMS)], axis=1) if len(used) else np.zeros((0, WORD_DIM + CHAR_DIM * len(GRAMS)), np.float32)
            kept: dict = {}
            raw = net.forward(x, index, kept)
            grads = net.backward(x, b_ids, b_own, index, kept, ((_sigmoid(raw) - label[at]) / len(at)).astype(np.float32))
            step += 1
            for k, d in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                net.w[k] = (net.w[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    at = np.flatnonzero(held) if held.any() else fit_at
    raw, truth = net.text_scores([texts[i] for i in at]), y[at]
    sure = np.where(truth == 1, weight[1], weight[0])
    sure = sure / sure.sum()
    centre, spread = float((sure * raw).sum()), float(max(raw.std(), 1e-6))
    line, ridge = np.zeros(2), np.diag([1e-3, 1e-4])
    u = np.stack([(raw - centre) / spread, np.ones(len(raw))], axis=1)
    for _ in range(50):  # Newton steps of a weighted logistic line
        p = 1 / (1 + np.exp(-np.clip(u @ line, -30, 30)))
        grad = u.T @ (sure * (p - truth)) + ridge @ line
        line = line - np.linalg.solve((u * (sure * p * (1 - p))[:, None]).T @ u + ridge, grad)
    net.scale, net.shift = float(line[0] / spread), float(line[1] - line[0] * centre / spread)
    p = net.probability(raw)
    net.report = {"n": len(at), "recall": float((p[truth == 1] >= 0.5).mean()), "false": float((p[truth == 0] >= 0.5).mean())}
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", bound: int = SAMPLE) -> tuple[list[str], list[int], tuple[float, float]]:
    """(texts, labels, class weights): up to ``bound`` labelled texts of each class, lowest id hash first.

    Held-out rows (fold 0) take no part. Ids are chosen from the label table
    alone; the join then carries at most twice ``bound`` ids, so it may be
    broadcast. Each id gives one row, of its smallest label and text, before
    anything reaches the driver, so repeated rows cost nothing there. Rows with
    a null label or id are passed over.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(fold(F.col("id")) != 0)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64(F.lit("sample"), "id")
    pick = None
    for y in (0, 1):
        own = rows.where(F.col("y") == y).orderBy(key, "id").limit(bound)
        pick = own if pick is None else pick.unionByName(own)
    texts = docs.select(F.col(id_col).alias("doc"), text_of(text).alias("t")).join(F.broadcast(pick), F.col("doc") == F.col("id"))
    found = texts.groupBy("id").agg(F.min(F.struct("y", "t")).alias("r")).select("id", "r.y", "r.t").collect()
    found = sorted(found, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    got = np.bincount([r["y"] for r in found], minlength=2) if found else np.zeros(2)
    weight = tuple(float(counts.get(y, 0) / got[y]) if got[y] else 1.0 for y in (0, 1))
    return [r["t"] for r in found], [r["y"] for r in found], weight


def score(df: DataFrame, net: BiGRU, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the probability that each whole text is toxic.

    Null and empty texts score as a window without words. Only the text is read:
    equal texts have equal scores. A column named as ``out`` is replaced; an
    empty table gives an empty table.
    """

    def make(values, net):
        return [pa.array(net.probability(net.text_scores(values.to_pylist())), pa.float64())]

    return add_columns(df.withColumn(text, text_of(text)), text, f"`{out}` double", make, keep, lambda: net, 4 * BLOCK_BYTES)


def query(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, the model fitted on labelled rows outside fold 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
    scored = score(docs.select("doc_id", "text"), net, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
