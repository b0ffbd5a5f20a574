"""Toxicity by compression distance: each window of a text is compressed with a dictionary of toxic and one of ordinary text.

The sample is labelled rows. Six bytes in a row that far more toxic than ordinary texts of the sample hold (a log-likelihood ratio of
EVIDENCE or more) mark stretches of toxic texts; they are the content of the toxic dictionary, the most common ones nearest to its
end. The ordinary dictionary is trained by zstandard on windows of ordinary texts. A window is cut at a blank after at most
WINDOW bytes and gets a prefix that both dictionaries end with, so that every frame pays for its first match alike and a match in
a dictionary shows in the length at once.

What a window saves with the toxic dictionary, and how much more than with the ordinary one, is compared with thresholds; the
shares and numbers of windows over them, with the means, give a text's score by a logistic regression. It is calibrated on texts
that their dictionaries have not seen: the sample has FOLDS parts, and each part is measured with dictionaries of the others.

Bounds: FIT labelled rows (half of them of either label, if there are as many), the smallest by a hash of key and text; GRAMS
marking sequences, STRETCHES stretches, WINDOWS windows for training. Everything else is all text: whole texts are cut and scored.
Capital letters A to Z count as small ones.

Nulls: a null text counts as empty; labels that are null or of a null key are ignored; of several labels of a key the largest
counts. A null key is not held out. Without both labels in the sample, every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality import fit

FIT = 8_000
FOLDS = 6
GRAM = 6
EVIDENCE, LEAST_TEXTS = 20.0, 3
GRAMS, STRETCHES, WINDOWS = 8_192, 50_000, 30_000
WINDOW = 62  # zstandard does not recode so few literals, so a window without a match keeps its length
ORDINARY_SIZE = 8_192
LEVEL = 3
CUTOFF = 0.3
OVER = (1, 2, 4, 6, 8)
#: Common prefix of windows, and the end of every dictionary.
PREFIX = bytes(range(1, 17))


def grams(raw: bytes) -> np.ndarray:
    """A number for each GRAM bytes in a row; equal numbers are equal bytes."""
    if len(raw) < GRAM:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    out = np.zeros(len(b) - GRAM + 1, np.int64)
    for j in range(GRAM):
        out = out << 8 | b[j : len(b) - GRAM + 1 + j]
    return out


def windows(raw: bytes) -> list[bytes]:
    """The text in pieces of at most WINDOW bytes, cut before a blank if the second half has one; at least one."""
    out, at, size = [], 0, len(raw)
    while size - at > WINDOW:
        end = raw.rfind(b" ", at + WINDOW // 2, at + WINDOW)
        end = end if end > 0 else at + WINDOW
        out.append(raw[at:end])
        at = end
    out.append(raw[at:])
    return out


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def stretches(raw: bytes, marking: np.ndarray) -> list[bytes]:
    """Maximal runs of bytes that marking sequences (sorted numbers) cover."""
    g = grams(raw)
    if not len(marking) or not len(g):
        return []
    hit = np.flatnonzero(marking[np.minimum(np.searchsorted(marking, g), len(marking) - 1)] == g)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [raw[a : b + GRAM] for a, b in zip(np.r_[hit[:1], hit[cut + 1]].tolist(), np.r_[hit[cut], hit[-1:]].tolist())]


def toxic_content(found: list[tuple[bytes, int]]) -> bytes:
    """Stretches (with the number of texts) that together hold every sequence, the most common ones last."""
    have: set[int] = set()
    kept = []
    for stretch, _ in sorted(found, key=lambda x: (-x[1], x[0])):
        own = set(grams(stretch).tolist())
        if own - have:
            have |= own
            kept.append(stretch)
    return b"\0".join(reversed(kept))


def ordinary_content(samples: list[bytes]) -> bytes:
    """What zstandard's trainer picks out of windows; with too few of them, the windows themselves."""
    try:
        return zstandard.train_dictionary(ORDINARY_SIZE, samples).as_bytes()[-ORDINARY_SIZE + 600 :]
    except zstandard.ZstdError:
        return b"".join(samples)[:ORDINARY_SIZE]


class Distance:
    """Compresses windows with both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary, self.none = self._by(toxic), self._by(ordinary), self._by(b"")
        # lengths of windows without any match; they share no byte with the prefix
        self.plain = np.array([len(self.none.compress(PREFIX + bytes(range(128, 128 + n)))) for n in range(WINDOW + 1)])

    @staticmethod
    def _by(content: bytes) -> zstandard.ZstdCompressor:
        # the end of a dictionary is found first; zeros stand in for an empty one
        words = zstandard.ZstdCompressionDict((content or bytes(16)) + PREFIX, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(words.as_bytes()), source_size=WINDOW + len(PREFIX), min_match=GRAM, write_checksum=False, write_content_size=False, write_dict_id=False)
        words.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=words)

    def measures(self, text: str | None) -> list[float]:
        """What a text is judged by, from all its windows."""
        cut = windows(folded(text))
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        lengths = np.array([(len(w), len(toxic(p)), len(ordinary(p))) for w in cut for p in (PREFIX + w,)])
        plain = self.plain[lengths[:, 0]]
        for i in np.flatnonzero(lengths[:, 1] < plain).tolist():
            plain[i] = min(plain[i], len(self.none.compress(PREFIX + cut[i])))  # what repeats within the window is no match
        saved, usual = plain - lengths[:, 1], plain - lengths[:, 2]
        more = saved - usual
        by_share = [float(np.sqrt((x >= k).mean())) for x in (saved, more) for k in OVER]
        by_number = [float(np.log1p((saved >= k).sum())) for k in OVER]
        return [*by_share, *by_number, float(np.log(len(cut))), float(saved.max()) / 8, float(saved.mean()), float(more.mean()), float(usual.mean()) / 4]


MEASURES = 2 * len(OVER) + len(OVER) + 5


class Model:
    """Dictionaries and weights; scores whole texts. Without dictionaries, every score is `share`."""

    def __init__(self, toxic: bytes = b"", ordinary: bytes = b"", weights: list[float] | None = None, share: float = 0.0):
        self.toxic, self.ordinary, self.weights, self.share = toxic, ordinary, weights, share

    def scores(self, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(self.toxic, self.ordinary) if self.weights else None
        w = np.array(self.weights or [])
        for batch in found:
            if distance:
                odds = [float(np.clip(np.array(distance.measures(t.as_py())) @ w[:-1] + w[-1], -30, 30)) for t in batch.column("text")]
                score = (1 / (1 + np.exp(-np.array(odds)))).tolist()
            else:
                score = [self.share] * len(batch)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score, pa.float64())], [*rest, "score"])


def sample(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", text: str = "text", key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(label, fold, text) of at most FIT labelled rows, stored, and how many keys of either label there are."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max(F.col(label).cast("int")).alias("label")).where(usable)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r.label in (0, 1)}
    part = [known.where(F.col("label") == y).orderBy(F.xxhash64("of"), "of").limit(FIT // 2) for y in (0, 1)]
    some = F.broadcast(part[0].union(part[1]))  # at most FIT keys
    rows = docs.select(F.col(key).alias("of"), F.col(text).alias("text")).join(some, "of")
    rows = rows.select("label", F.xxhash64("of", F.coalesce("text", F.lit(""))).alias("h"), "text").orderBy("h").limit(FIT)  # a key may repeat
    return stored(rows.select("label", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "h", "text"), "toxic-sample"), sizes


def _gram_rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the batch have each sequence, by fold and label."""
    for batch in found:
        every: dict[tuple[int, int], list[np.ndarray]] = {}
        for y, f, t in zip(batch.column("label").to_pylist(), batch.column("fold").to_pylist(), batch.column("text")):
            every.setdefault((y, f), []).append(np.unique(grams(folded(t.as_py()))))
        for (y, f), each in every.items():
            gram, n = np.unique(np.concatenate(each), return_counts=True)
            k = len(gram)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, f), pa.int32()), pa.array(gram), pa.array(n if y else np.zeros(k, np.int64)), pa.array(np.zeros(k, np.int64) if y else n)], ["fold", "gram", "toxic", "ordinary"])


def _marking(counts: DataFrame, toxic: int, ordinary: int) -> np.ndarray:
    """The sequences that toxic texts have far more often, from (gram, toxic, ordinary) numbers of texts; at most GRAMS."""
    a, b = F.col("toxic"), F.col("ordinary")
    p, q = (a + 0.5) / (toxic + 1), (b + 0.5) / (ordinary + 1)
    both = (a + b + 1) / (toxic + ordinary + 2)
    ratio = 2 * (a * F.log(p / both) + (toxic - a) * F.log((1 - p) / (1 - both)) + b * F.log(q / both) + (ordinary - b) * F.log((1 - q) / (1 - both)))
    good = counts.where((a >= LEAST_TEXTS) & (p > q)).select("gram", ratio.alias("ratio")).where(F.col("ratio") >= EVIDENCE)
    return np.sort(np.array([r.gram for r in good.orderBy(F.desc("ratio"), "gram").limit(GRAMS).collect()], np.int64))


def _marked(marking: list[np.ndarray]):
    """Stretches of toxic texts per model: model k has all folds but k, the last one has all."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows: Counter = Counter()
            for f, t in zip(batch.column("fold").to_pylist(), batch.column("text")):
                raw = folded(t.as_py())
                for k, marks in enumerate(marking):
                    if k != f:
                        rows.update((k, s) for s in set(stretches(raw, marks)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.binary()), pa.array(list(rows.values()), pa.int64())], ["model", "stretch", "n"])

    return run


def _cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for f, t in zip(batch.column("fold").to_pylist(), batch.column("text")):
            cut = windows(folded(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(cut), pa.int32()), pa.array(cut, pa.binary())], ["fold", "window"])


def _measured(contents: list[tuple[bytes, bytes]]):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold: dict[int, Distance] = {}
        for batch in found:
            folds = batch.column("fold").to_pylist()
            for f in set(folds) - set(by_fold):
                by_fold[f] = Distance(*contents[f])
            x = [by_fold[f].measures(t.as_py()) for f, t in zip(folds, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array(x, pa.list_(pa.float64()))], ["label", "h", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", text: str = "text", key: str = "doc_id") -> Model:
    """Learn from labels of keys that are usable (a condition on `of`, the key)."""
    rows, sizes = sample(docs, labels, usable, label, text, key)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    texts = {(r.label, r.fold): r.n for r in rows.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = lambda y, but=-1: sum(n for (z, f), n in texts.items() if z == y and f != but)
    if not number(0) or not number(1):
        return Model(share=share)
    counts = stored(rows.select("label", "fold", "text").mapInArrow(_gram_rows, "fold int, gram long, toxic long, ordinary long").groupBy("fold", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    summed = lambda some: some.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    marking = [_marking(summed(counts.where(F.col("fold") != k)), number(1, k), number(0, k)) for k in range(FOLDS + 1)]
    marked = rows.where("label = 1").select("fold", "text").mapInArrow(_marked(marking), "model int, stretch binary, n long").groupBy("model", "stretch").agg(F.sum("n").alias("n"))
    said: dict[int, list[tuple[bytes, int]]] = {}
    for r in marked.orderBy(F.desc("n"), "stretch").limit(STRETCHES * (FOLDS + 1)).collect():
        said.setdefault(r.model, []).append((bytes(r.stretch), r.n))
    cut = rows.where("label = 0").select("fold", "text").mapInArrow(_cut, "fold int, window binary").distinct()
    usual = [(r.fold, bytes(r.window)) for r in cut.orderBy(F.xxhash64("window", "fold"), "window", "fold").limit(WINDOWS).collect()]
    contents = [(toxic_content(said.get(k, [])), ordinary_content([w for f, w in usual if f != k])) for k in range(FOLDS + 1)]
    got = rows.select("label", "fold", "h", "text").mapInArrow(_measured(contents[:-1]), "label int, h long, x array<double>").orderBy("h", "label", "x").collect()
    y = np.array([r.label for r in got], float)
    weights = fit(np.array([r.x for r in got], np.float32), y, rounds=400)
    # the sample has another share of label 1 than the labels
    weights[-1] += np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(*contents[-1], weights.tolist())


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Per row: doc_id, held_out (its label was not learned from), score from 0 to 1, predicted (score of CUTOFF or more)."""
    model = train(docs, labels, ~held_out(F.col("of")), label, text, key)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(model.scores, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
