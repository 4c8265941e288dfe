"""Quality classifier with hierarchical empirical Bayes.

A logistic model reads the characters and words of each document. Its evidence
is summed by path and host; each site's rate of good documents is a Beta
posterior that sparse hosts shrink toward the global rate and sparse paths
toward their host's. A document's posterior combines its own evidence with its
site's, from which its own share is taken out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import add_columns
from docloom.llm.common import fresh, materialize, text_of
from docloom.llm.toxicity import sample

#: Labelled documents of each class that the document model is fitted on, at most.
SAMPLE = 2000
#: Rows of each site in the last join are dealt over so many keys.
SALTS = 64
#: Documents under this posterior of being good are rejected.
THRESHOLD = 0.5
#: Bounds of the strength of a site prior, in documents.
STRENGTH = (2.0, 5000.0)

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SYMBOL = range(1, 8)


def _classes() -> np.ndarray:
    """A class for each code point under 0x600 (0 beyond and for the rest)."""
    table = np.zeros(0x600, np.uint8)
    for c in range(0x600):
        s = chr(c)
        table[c] = LOWER if s.islower() else UPPER if s.isupper() else DIGIT if s.isdigit() else LINE if s == "\n" else SPACE if s.isspace() else STOP if s in ".,;:?'\"()-" else SYMBOL if c < 128 and s.isprintable() else 0
    return table


CLASSES = _classes()


def features(texts: list[str]) -> np.ndarray:
    """A row a text: length, shares of character classes, word length, distinct words and lines, and their squares."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    kind = CLASSES[np.minimum(code, 0x5FF)] * (code < 0x600)
    count = np.bincount(np.repeat(np.arange(n), size) * 8 + kind, minlength=8 * n).reshape(n, 8).astype(np.float64)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.float64)
    distinct = np.array([len(set(w)) for w in words], np.float64)
    repeats = np.array([sum(map(str.__eq__, w[1:], w)) for w in words], np.float64)
    lines = [t.split("\n") for t in texts]
    line_share = np.array([len(set(x)) / len(x) for x in lines])
    total, w = np.maximum(size, 1.0), np.maximum(n_words, 1.0)
    x = np.stack([
        np.log1p(size), count[:, UPPER] / total, count[:, DIGIT] / total, count[:, LINE] / total, count[:, STOP] / total, np.sqrt(count[:, SYMBOL] / total),
        (count[:, LOWER] + count[:, UPPER]) / total, np.minimum(total / w, 30) / 10, distinct / w, np.log1p(distinct) - 0.8 * np.log1p(n_words), repeats / w, line_share,
    ], axis=1)
    return np.concatenate([x, x * x], axis=1)


@dataclass
class Logistic:
    mean: np.ndarray
    spread: np.ndarray
    line: np.ndarray

    def probability(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = ((features(texts) - self.mean) / self.spread) @ self.line[:-1] + self.line[-1]
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6)


def fit(texts: list[str], good: list[int], weight: tuple[float, float] = (1.0, 1.0), ridge: float = 2.0) -> Logistic:
    """Newton steps on the penalised likelihood; ``weight`` undoes the sample's evened classes.

    Without both classes every text scores the one that there is (good if none).
    """
    y = np.array(good, np.float64)
    if len(set(good)) < 2:
        d = features([""]).shape[1]
        return Logistic(np.zeros(d), np.ones(d), np.append(np.zeros(d), 4.0 if not len(y) or y[0] else -4.0))
    x = features(texts)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    u = np.append((x - mean) / spread, np.ones((len(x), 1)), axis=1)
    sure = np.where(y == 1, weight[1], weight[0])
    sure = sure / sure.mean()
    penalty = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    line = np.zeros(u.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(u @ line, -30, 30)))
        step = np.linalg.solve((u * (sure * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ u + penalty, u.T @ (sure * (y - p)) - penalty @ line)
        line = line + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, spread, line)


def evidence(df: DataFrame, model: Logistic, text: str = "text", out: str = "p_doc", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the document model's probability of a good text."""

    def make(values, model):
        return [pa.array(model.probability(values.fill_null("").to_pylist()), pa.float64())]

    return add_columns(df, text, f"`{out}` double", make, keep, lambda: model)


def host_of(url: Column | str) -> Column:
    """The host of a url in lower case, without port and user; null without one."""
    url = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def path_of(url: Column | str) -> Column:
    """The first step of a url's path (of ``http://a/b/c?d``: ``b``); empty at the root, null without a host."""
    url = F.col(url) if isinstance(url, str) else url
    return F.when(host_of(url).isNotNull(), F.regexp_extract(url, r"^[^:]+://[^/?#]*/([^/?#]*)", 1))


def _key(c: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("~"))


def _strength(rate: Column, prior: Column, n: Column) -> Column:
    """Moment estimate of a Beta prior's strength from rates of sites of ``n`` documents."""
    spread = F.sum(n * (rate - prior) * (rate - prior)) / F.sum(n)
    within = F.sum(prior * (1 - prior)) / F.sum(n)
    return F.sum(n * prior * (1 - prior)) / F.sum(n) / F.greatest(spread - within, F.lit(1e-9)) - 1


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """(host, path, good, n, host_rate) for each path, the global rate, and the path prior's strength.

    ``scored`` has (site_host, site_path, p_doc). Sums by path are partly summed
    before the shuffle, so a host with a third of all rows costs no more than
    another; hosts are summed from paths. Only three numbers reach the driver.
    """
    paths = materialize(scored.groupBy("site_host", "site_path").agg(F.sum("p_doc").alias("good"), F.count("*").cast("double").alias("n")), "paths")
    hosts = paths.groupBy("site_host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    total = paths.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    if not total["n"]:
        return paths.withColumn("host_rate", F.lit(0.5)), 0.5, STRENGTH[0]
    rate = total["g"] / total["n"]
    clip = lambda k: float(min(max(STRENGTH[1] if k is None else k, STRENGTH[0]), STRENGTH[1]))
    by_host = clip(hosts.agg(_strength(F.col("host_good") / F.col("host_n"), F.lit(rate), F.col("host_n"))).first()[0])
    hosts = hosts.select("site_host", ((F.col("host_good") + by_host * rate) / (F.col("host_n") + by_host)).alias("host_rate"))
    sites = paths.join(hosts, "site_host")
    by_path = clip(sites.agg(_strength(F.col("good") / F.col("n"), F.col("host_rate"), F.col("n"))).first()[0])
    return sites, rate, by_path


def classify(docs: DataFrame, model: Logistic, text: str = "text", host: Column | str = "source", path: Column | str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_doc, p_site, quality_score and kept.

    ``host`` and ``path`` name the site: columns, or expressions of the columns
    of ``docs`` (:func:`host_of` and :func:`path_of` take them from a url).
    ``p_site`` is the posterior rate of the document's path without the document
    itself; ``quality_score`` the posterior that the document is good; ``kept``
    whether it reaches ``threshold``. Null and empty texts count as texts
    without words. A null host or path is a site of its own. Repeated rows each
    count. An empty table gives an empty table; columns of these four names are
    replaced, all others stay whatever their names. The text is read twice, for
    the sites' sums and for the result. Rows meet their site by site and salt,
    so a hot site is dealt over many keys; Spark broadcasts the sites while
    their file is under its own limit.
    """
    made = ("p_doc", "p_site", "quality_score", "kept")
    site_host, site_path, body, good, n, host_rate, salt, h, q, s = fresh([*docs.columns, *made], "site_host", "site_path", "body", "good", "n", "host_rate", "salt", "h", "q", "s")
    keyed = docs.withColumns({site_host: _key(host), site_path: _key(path)}).drop(*made)
    names = [c for c in docs.columns if c.lower() not in made]
    scored = evidence(keyed.select(F.col(site_host).alias("site_host"), F.col(site_path).alias("site_path"), text_of(text).alias("body")), model, "body", keep=["site_host", "site_path"])
    sites, rate, strength = site_posteriors(scored)
    sites = materialize(sites.select(F.col("site_host").alias(h), F.col("site_path").alias(q), F.col("good").alias(good), F.col("n").alias(n), F.col("host_rate").alias(host_rate)), "sites")
    salted = sites.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = evidence(keyed.withColumn(body, text_of(text)), model, body)
    plain = [c for c, kind in docs.dtypes if c in names and not kind.startswith(("map", "variant"))]
    rows = rows.withColumn(salt, F.pmod(F.xxhash64("p_doc", *plain), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, (F.col(site_host) == F.col(h)) & (F.col(site_path) == F.col(q)) & (F.col(salt) == F.col(s)))
    logit = lambda p: F.log(p / (1 - p))
    site = (F.greatest(F.col(good) - F.col("p_doc"), F.lit(0.0)) + strength * F.col(host_rate)) / (F.col(n) - 1 + strength)
    site = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(logit(F.col("p_doc")) + logit(F.col("p_site")) - logit(F.lit(min(max(rate, 1e-6), 1 - 1e-6))))))
    return (
        joined.withColumn("p_site", site).withColumn("quality_score", score).withColumn("kept", F.col("quality_score") >= threshold)
        .select(*names, *made)
    )


def good(docs: DataFrame, model: Logistic, text: str = "text", host: Column | str = "source", path: Column | str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps; columns and their order stay, whatever their names."""
    clash = [c for c in docs.columns if c.lower() in ("p_doc", "p_site", "quality_score", "kept")]
    away = dict(zip(clash, fresh([*docs.columns, "p_doc", "p_site", "quality_score", "kept"], *clash), strict=True))
    held = classify(docs.withColumnsRenamed(away), model, text, host, path, threshold).where("kept")
    return held.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def fitted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Logistic:
    """The document model, fitted on up to ``bound`` labelled rows of each class outside fold 0."""
    return fit(*sample(docs, labels, "quality", bound=bound))


def query(spark, sf_dir: str) -> DataFrame:
    """Quality of every document: its own and its site's evidence, posterior and decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", "source", "lang", "p_doc", "p_site", "quality_score", "kept")
