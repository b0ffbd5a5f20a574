"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on hashed byte n-grams and bytes of the whole text, and on a few numbers that hold for any text (length,
repeated words), gives each document its own evidence; all weights are learned from labels. Sites have two levels, host and path. The
mean of a host is shrunk towards the mean of all documents, that of a path towards its host, each by a strength that the spread
of the level's means gives (method of moments), so that a site with few documents stays near its parent. A document's posterior
odds are its own odds times the odds of its path without it, over the odds of all documents; at the level of the host, where
it is one of many, it is not taken out.

The regression is fitted on at most FIT labelled rows, the smallest by a hash of doc_id and text; everything else uses all rows.
Nulls: a null text counts as empty; a null host or path is a site of its own; rows that share a doc_id stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, tidy

FIT = 4_000
KEEP = 0.5
GRAMS = 2_048
#: A site counts at least for so many documents of its parent, and at most: the spread of few means says little.
LEAST_STRENGTH, MOST_STRENGTH = 20.0, 1e6
WIDTH = GRAMS + 256 + 4


def gram_numbers(raw: bytes) -> np.ndarray:
    """A number below GRAMS for every three bytes in a row; digits count as one, and so do capitals."""
    b = FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 11)


FOLD = np.array([48 if 48 <= b <= 57 else 65 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def features(text: str | None) -> np.ndarray:
    """Roots of the shares of n-grams and of bytes, and four numbers of words, over one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, grams = max(1, len(words)), np.zeros(GRAMS)
    if len(raw) > 2:
        grams = np.sqrt(np.bincount(gram_numbers(raw), minlength=GRAMS) / (len(raw) - 2))
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    each = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw)))
    return np.concatenate([grams, each, [np.log1p(len(words)) / 10, len(raw) / n / 10, len(set(words)) / n, again]])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression on columns of one scale, by accelerated gradient steps."""
    # in single precision and in place: the matrix is most of what the driver holds
    n = len(x)
    mean = x.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x).astype(np.float64) / n - mean**2, 0.0))
    used = spread > 1e-4
    scale = np.where(used, np.maximum(spread, 0.1 * spread[used].mean() if used.any() else 1.0), 1.0)
    z = np.empty((n, x.shape[1] + 1), np.float32)
    np.subtract(x, mean.astype(np.float32), out=z[:, :-1])
    z[:, :-1] *= np.where(used, 1 / scale, 0.0).astype(np.float32)
    z[:, -1] = 1.0
    step = 4.0 / max(float(np.einsum("ij,ij->", z, z)) / n, 1e-9)
    w = ahead = np.zeros(z.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead.astype(np.float32), -30, 30)))
        gradient = z.T @ (p - y).astype(np.float32) / len(y) + ridge * np.r_[ahead[:-1], 0]
        before, w = w, ahead - step * gradient
        ahead = w + k / (k + 3) * (w - before)
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def _vectors(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        x = [features(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array(x, pa.binary())], ["label", "h", "x"])


def _scores(weights: list[float]):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in found:
            odds = [float(np.clip(features(t.as_py()) @ w[:-1] + w[-1], -12, 12)) for t in batch.column("text")]
            columns = [batch.column(c) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(odds, pa.float64())], ["doc_id", "host", "path", "odds"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> list[float]:
    """Weights from at most FIT labelled rows. Without both classes, all weights are 0 and every document is kept."""
    known = labels.select(F.col(key).alias("label_key"), F.col(label).cast("double").alias("label")).where("label_key is not null and label is not null")
    some = known.orderBy(F.xxhash64("label_key"), "label_key").limit(FIT)
    rows = docs.select(F.col(key).alias("label_key"), F.col(text).alias("text")).join(F.broadcast(some), "label_key").select("label", F.xxhash64("label_key", "text").alias("h"), "text")
    # a doc_id may repeat: at most FIT rows of WIDTH numbers reach the driver
    got = rows.mapInArrow(tidy(_vectors), "label double, h long, x binary").orderBy("h").limit(FIT).collect()
    y = np.array([r.label for r in got])
    if len(set(y.tolist())) < 2:
        return [0.0] * WIDTH + [1.0]
    x = np.frombuffer(b"".join([r.x for r in got]), np.float32).reshape(len(got), WIDTH)
    del got
    return fit(x, y).tolist()


def _strength(centre: Column) -> Column:
    """How many documents a level's parent counts for: the mean's variance within sites over that between sites."""
    within = centre * (1 - centre)
    between = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - centre, 2) - within) / F.greatest(F.sum("n"), F.lit(1))
    return F.least(F.greatest(F.avg(within) / F.greatest(between, F.lit(1e-6)) - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sites(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """(sites, strength of a host for its paths, mean of all) from rows (host, path, p). Sites have the sums of their rows and
    the mean of their host."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    mu = hosts.agg(((F.sum("s") + 1) / (F.sum("n") + 2)).alias("mu")).first().mu or 0.5
    strength = hosts.agg(_strength(F.lit(mu)).alias("k")).first().k or 1.0
    host_level = hosts.select(F.col("host").alias("of_host"), ((F.col("s") + strength * mu) / (F.col("n") + strength)).alias("host_mean"))
    path_level = paths.join(host_level, paths["host"].eqNullSafe(host_level["of_host"]))
    strength = path_level.agg(_strength(F.col("host_mean")).alias("k")).first().k or 1.0
    # stored, so that a host with very many documents can be split over tasks in the next join
    return stored(path_level.select("of_host", F.col("path").alias("of_path"), "n", "s", "host_mean"), "sites"), strength, mu


def _site_mean(p: Column, strength: float) -> Column:
    """The mean of a row's path without it, shrunk towards its host."""
    site = (F.col("s") - p + strength * F.col("host_mean")) / (F.col("n") - 1 + strength)
    return F.least(F.greatest(site, F.lit(1e-4)), F.lit(1 - 1e-4))


def _posterior(odds: Column, site: Column, mu: float) -> Column:
    return 1 / (1 + F.exp(-(odds + _logit(site) - float(np.log(mu / (1 - mu))))))


def posteriors(docs: DataFrame, weights: list[float], host: Column, path: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, host, path, p_document, p_site (its path's mean without it) and posterior, all from 0 to 1."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    scored = stored(rows.mapInArrow(_scores(weights), "doc_id long, host string, path string, odds double").withColumn("p", 1 / (1 + F.exp(-F.col("odds")))), "scores")
    sites, strength, mu = _sites(scored)
    together = scored.join(sites, scored["host"].eqNullSafe(sites["of_host"]) & scored["path"].eqNullSafe(sites["of_path"]))
    together = together.withColumn("p_site", _site_mean(F.col("p"), strength))
    return together.select("doc_id", "host", "path", F.col("p").alias("p_document"), "p_site", _posterior(F.col("odds"), F.col("p_site"), mu).alias("posterior"))


def _path(host: str, within: str) -> Column:
    """The path of a document is its host and its value of `within`."""
    return F.concat_ws("/", F.col(host), F.col(within))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", within: str = "lang") -> DataFrame:
    """posteriors() and kept (posterior >= KEEP)."""
    weights = train(docs, labels, text, key)
    return posteriors(docs, weights, F.col(host), _path(host, within), text, key).withColumn("kept", F.col("posterior") >= KEEP)


def _with_odds(weights: list[float]):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in found:
            odds = [float(np.clip(features(t.as_py()) @ w[:-1] + w[-1], -12, 12)) for t in batch.column("_text")]
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(odds, pa.float64())], [*rest, "odds"])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", within: str = "lang") -> DataFrame:
    """The rows of docs that classify() keeps, each judged for itself whatever its key. Texts are scored twice, for the sites
    and for the filter, and neither stored nor joined by key."""
    weights = train(docs, labels, text, key)
    sided = docs.select(F.struct("*").alias("row"), F.col(host).cast("string").alias("host"), _path(host, within).alias("path"), F.col(text).alias("_text"))
    scored = sided.select("host", "path", "_text").mapInArrow(tidy(_with_odds(weights)), "host string, path string, odds double")
    sites, strength, mu = _sites(stored(scored.select("host", "path", (1 / (1 + F.exp(-F.col("odds")))).alias("p")), "scores"))
    fields = T.StructType([sided.schema["row"], sided.schema["host"], sided.schema["path"], T.StructField("odds", T.DoubleType())])
    told = sided.mapInArrow(tidy(_with_odds(weights)), fields)
    together = told.join(sites, told["host"].eqNullSafe(sites["of_host"]) & told["path"].eqNullSafe(sites["of_path"]))
    p = 1 / (1 + F.exp(-F.col("odds")))
    return together.where(_posterior(F.col("odds"), _site_mean(p, strength), mu) >= KEEP).select("row.*")
