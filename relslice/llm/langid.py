"""Language identification by a byte convolutional network, trained here in numpy on labelled text.

A lower-cased text is cut into windows of WINDOW bytes, all of them. Bytes are embedded, filters of several widths run over
them, each filter's maximum over the window is kept, and a softmax layer gives the window's probabilities. A text's
probabilities are the means over its windows, weighted by their bytes. For use, embedding and filters are folded into tables
of byte pairs, so that a filter of width 4 costs two look-ups a byte.

Training takes labelled windows of all languages: at most SAMPLE in all, shared equally, and WINDOWS of one, drawn by a hash of
what the row holds and the place from the windows of all rows that are not held out, at most PER_ROW of a row (so that one long
text does not stand for a language) and anywhere in it. These three are the bounds of the sample; there is no other. Equal rows
are drawn together, and their copies fill up what the others leave, so the model follows from the rows alone, however a table is cut into partitions.
Nulls: a text that is null or has no letter is `und` with score 0; rows with a null language are not learned from. If there is
nothing to learn from, every text is `und`. Rows may share a doc_id or be equal; each gets its own result.

A filter by score takes its least score per language from all held-out rows: the score that all but MISSED of them reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
WINDOWS = 2_400
PER_ROW = 4
SAMPLE = 614_400
STEPS = 10_000  # into which scores are counted for least scores
MISSED = 0.002
PASSES = 6
AT_ONCE = 64
LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters counts as a blank.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def to_bytes(text: str) -> np.ndarray:
    return FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, bytes of the text in each); the last is filled up with blanks."""
    raw = to_bytes(text)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = raw
    sizes = np.full(n, WINDOW)
    sizes[-1] = max(1, len(raw) - (n - 1) * WINDOW)
    return out.reshape(n, WINDOW), sizes


def train(x: np.ndarray, y: np.ndarray, classes: int, passes: int = PASSES, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on cross-entropy; only each filter's best place gets a gradient."""
    r = np.random.default_rng(seed)
    p = {"embed": r.normal(0, 0.5, (256, EMBEDDING)), "out": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)), "bias": np.zeros(classes)}
    for w in WIDTHS:
        p[f"f{w}"] = r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step, batch = 0, 64
    for _ in range(passes):
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            b, n = x[rows].astype(np.int64), len(rows)
            e = p["embed"][b]
            pooled, kept = [], []
            for w in WIDTHS:
                places = WINDOW - w + 1
                cols = np.concatenate([e[:, j : j + places] for j in range(w)], axis=2)
                z = (cols.reshape(-1, w * EMBEDDING) @ p[f"f{w}"]).reshape(n, places, FILTERS)
                best = z.argmax(axis=1)
                pooled.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0] + p[f"b{w}"])
                kept.append((cols, best))
            h = np.concatenate(pooled, axis=1)
            a = np.maximum(h, 0)
            logits = a @ p["out"] + p["bias"]
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), y[rows]] -= 1
            q /= n
            g = {"out": a.T @ q + 1e-4 * p["out"], "bias": q.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            dh = (q @ p["out"].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                cols, best = kept[i]
                picked = cols[np.arange(n)[:, None], best]
                g[f"f{w}"] = np.einsum("nfc,nf->cf", picked, d)
                g[f"b{w}"] = d.sum(axis=0)
                back = np.einsum("nf,cf->nfc", d, p[f"f{w}"]).reshape(n, FILTERS, w, EMBEDDING)
                where = b[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
                np.add.at(g["embed"], where.reshape(-1), back.reshape(-1, EMBEDDING))
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


class Network:
    """The trained network, folded into tables for use in tasks."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.tables: list[list[tuple[int, int, np.ndarray]]] = []
        for w in WIDTHS:
            one = [(p["embed"] @ p[f"f{w}"].reshape(w, EMBEDDING, FILTERS)[j]).astype(np.float32) for j in range(w)]
            parts = []
            for j in range(0, w - 1, 2):
                parts.append((j, 2, (one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, 1, one[w - 1]))
            self.tables.append(parts)
        self.shift = np.concatenate([p[f"b{w}"] for w in WIDTHS]).astype(np.float32)
        self.out, self.bias = p["out"].astype(np.float32), p["bias"].astype(np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """windows x classes."""
        done = []
        for at in range(0, len(x), AT_ONCE):
            b = x[at : at + AT_ONCE].astype(np.int32)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            pooled = []
            for w, parts in zip(WIDTHS, self.tables):
                places = WINDOW - w + 1
                z = None
                for j, size, table in parts:
                    got = table.take((pairs if size == 2 else b)[:, j : j + places], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(z.max(axis=1))
            logits = np.maximum(np.concatenate(pooled, axis=1) + self.shift, 0) @ self.out + self.bias
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            done.append(q / q.sum(axis=1, keepdims=True))
        return np.concatenate(done)

    def texts(self, texts: list[str]) -> np.ndarray:
        """texts x classes: means over all windows of each whole text."""
        cut = [windows(t) for t in texts]
        q = self.probabilities(np.concatenate([w for w, _ in cut]))
        sizes = np.concatenate([s for _, s in cut])
        starts = np.concatenate([[0], np.cumsum([len(s) for _, s in cut])[:-1]]).astype(np.int64)
        return np.add.reduceat(q * sizes[:, None], starts, axis=0) / np.add.reduceat(sizes, starts)[:, None]


def _drawn(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (lang, text, h, share), about its share of its windows, at places that h decides; each with a rank."""
    for batch in found:
        langs, ranks, cut = [], [], []
        for lang, text, h, share in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "h", "share"))):
            every, sizes = windows(text)
            n = min(len(every), max(1, round(min(len(every), PER_ROW) * share)))
            r = np.random.default_rng(h % 2**63)
            for at in r.choice(len(every), n, replace=False).tolist():
                if sizes[at] > 32 or len(every) == 1:
                    raw = every[at].tobytes()
                    if LETTER.search(raw.decode("utf-8", "ignore")):
                        langs.append(lang)
                        ranks.append(int(r.integers(2**62)))
                        cut.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ranks, pa.int64()), pa.array(cut, pa.binary())], ["lang", "rank", "window"])


def _hash(text: str, lang: str, key: str) -> Column:
    """Of the text, its label and its key: the same wherever the row lies."""
    return F.xxhash64(F.col(text), F.col(lang).cast("string"), F.col(key).cast("string"))


def _filled(rows: list, most: int) -> list:
    """All rows, each with a count n, and their copies in rounds while there are fewer than most."""
    out, copy = list(rows), 2
    while len(out) < most and any(r.n >= copy for r in rows):
        out += [r for r in rows if r.n >= copy][: most - len(out)]
        copy += 1
    return out


def learn(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, network) from rows that are not held out. The bounded sample of windows goes to the driver."""
    size = F.least(F.ceil(F.greatest(F.octet_length(text), F.lit(1)) / WINDOW), F.lit(PER_ROW))
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), size.alias("size"), _hash(text, lang, key).alias("h"), held_out.alias("held"))
    rows = rows.where("not held and lang is not null and text is not null").drop("held")
    counts = rows.groupBy("lang").agg((F.approx_count_distinct("h", 0.02) * F.sum("size") / F.count("size")).alias("n")).collect()
    if not counts:
        return [], None
    most = max(1, min(WINDOWS, SAMPLE // len(counts)))
    shares = F.create_map(*[F.lit(x) for r in sorted(counts) for x in (r.lang, min(1.0, max(1.5 * most, most + 24) / max(r.n, 1.0)))])  # more than is kept, so that no label is missed by chance
    wanted = rows.withColumn("share", F.element_at(shares, F.col("lang")))
    # a row of few windows is looked at with the probability that one of them is drawn
    wanted = wanted.where((F.col("share") >= 1) | (F.pmod("h", F.lit(2**40)) < F.col("size") * F.col("share") * 2**40))
    drawn = wanted.select("lang", "text", "h", "share").mapInArrow(tidy(_drawn), "lang string, rank long, window binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "window"))
    every = drawn.groupBy("lang", "rank", "window").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).where(F.col("place") <= most).orderBy("lang", "place").collect()
    langs = sorted({r.lang for r in every})
    if not langs:
        return [], None
    got = []
    for _, rows_of in groupby(every, lambda r: r.lang):
        got += _filled(list(rows_of), most)
    x, y = [], []
    for i, r in enumerate(got):
        x.append(np.frombuffer(r.window, np.uint8))
        y.append(langs.index(r.lang))
        if i % 4 == 0:  # short texts are to be told as well
            x.append(np.concatenate([x[-1][: 12 + i // 4 % 60], np.full(WINDOW, 32, np.uint8)])[:WINDOW])
            y.append(y[-1])
    return langs, train(np.stack(x), np.array(y), len(langs))


class Judge:
    """Languages and scores of whole texts, about a million characters at a time."""

    def __init__(self, langs: list[str], params: dict[str, np.ndarray] | None):
        self.langs, self.network = langs, Network(params) if params else None

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        told: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if self.network and t and LETTER.search(t):
                told.append(i)
                size += len(t)
            if told and (size > 1_000_000 or i == len(texts) - 1):
                for k, row in zip(told, self.network.texts([texts[k] for k in told])):
                    best = int(row.argmax())
                    pred[k], score[k] = self.langs[best], float(min(1.0, row[best]))
                told, size = [], 0
        return pred, score


def _predict(langs: list[str], params: dict[str, np.ndarray] | None):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(langs, params)
        for batch in found:
            pred, score = judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _sure(langs: list[str], params: dict[str, np.ndarray] | None, text: str, least: dict[str, float]):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(langs, params)
        for batch in found:
            pred, score = judge(batch.column(text).to_pylist())
            yield batch.filter(pa.array([p != "und" and s >= least.get(p, 0.0) for p, s in zip(pred, score)], pa.bool_()))

    return run


def _told(langs: list[str], params: dict[str, np.ndarray] | None):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(langs, params)
        for batch in found:
            pred, score = judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang", "pred", "score"])

    return run


def least_scores(docs: DataFrame, held_out: Column, langs: list[str], params: dict[str, np.ndarray] | None, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """Per language: the score that all but MISSED of the held-out rows reach that are told right, from all of them.

    Scores are counted in steps of 1 / STEPS, so that the figure is the same however the table is cut; it lies less than a step below the exact one."""
    rows = docs.where(held_out).select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null")
    told = rows.where(F.col("lang").isin(langs) if langs else F.lit(False)).mapInArrow(tidy(_told(langs, params)), "lang string, pred string, score double").where("pred = lang")
    steps = told.groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upward, of = Window.partitionBy("lang").orderBy("step"), Window.partitionBy("lang")
    passed = steps.select("lang", "step", F.sum("n").over(upward).alias("until"), F.sum("n").over(of).alias("all")).where(F.col("until") > F.floor(F.col("all") * MISSED))
    return {r.lang: r.least / STEPS for r in passed.groupBy("lang").agg(F.min("step").alias("least")).collect()}


def keep_identified(docs: DataFrame, held_out: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose language is told with the least score of that language or more; no text is shuffled."""
    if held_out is None:
        held_out = _fifth(key)
    langs, params = learn(docs, held_out, text, lang, key)
    return docs.mapInArrow(tidy(_sure(langs, params, text, least_scores(docs, held_out, langs, params, text, lang))), docs.schema)


def _fifth(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, held_out: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. By default a fifth of the rows, by crc32 of the key, is held out."""
    if held_out is None:
        held_out = _fifth(key)
    langs, params = learn(docs, held_out, text, lang, key)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(langs, params), "doc_id long, held_out boolean, lang_pred string, score double")
