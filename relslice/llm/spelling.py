"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by pairs of trie nodes.

Words are counted over whole texts, then sorted twice, forwards and reversed, over ranges. Along a sorted range the nodes of a trie are
numbered as they turn up: a word shares the nodes of its common prefix with the word before it. Nodes that reach over the start
of a range take the number that the earlier range gave them; that needs the first and last word of each range only.

A pair (node of the letters before a position, node of those after it) stands for a word without that letter. Words with the same
pair differ in that letter alone. A pair of nodes that meet between two letters stands for the whole shorter word, so a word with
one letter more has it as one of its own pairs; of equal letters in a row only the first is left out, so every neighbour counts
once. Pairs are integers and decide exactly. A group holds at most one word per letter of the alphabet and one shorter word; it is
reduced to a count and its two most frequent words, and no pairs of words are listed.

Nulls: a null text has no words; a null doc_id counts as empty text in the hash. Repeated rows count as often as they occur.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LETTERS, TIMES, DIVISOR, RATIO = 5, 3, 97, 2
#: Runs of more bytes are hashed one by one.
SHORT = 64
PART = 4 << 20  # bytes of text that are cut into runs at once
HELD = 400_000  # words that a task gathers before it hands counts on

# ---- words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True  # U+00C0 to U+00FF are C3 and a following byte in UTF-8


def _crc_step() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _crc_shifts(most: int) -> np.ndarray:
    """[length, byte, value]: what a CRC with one byte set becomes as so many bytes follow."""
    step = _crc_step()
    out = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(most):
        out[n + 1] = step[out[n] & 255] ^ out[n] >> np.uint32(8)
    return out


_SHIFTS = _crc_shifts(SHORT)


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from those of their parts and the length of the second (at most SHORT)."""
    return second ^ np.bitwise_xor.reduce([_SHIFTS[length, k, first >> np.uint32(8 * k) & np.uint32(255)] for k in range(4)])


def runs(raw: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of letters of texts that lie one after the other in raw (UTF-8), lower-cased, and the text of each run."""
    letter = _LETTER[raw]
    letter[1:] |= raw[:-1] == 0xC3
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    start[heads] = letter[heads]  # runs end with their text
    at = np.flatnonzero(start)
    kept = np.cumsum(letter)
    offsets = np.concatenate([kept[at] - 1, kept[-1:]]) if len(raw) else np.zeros(1)
    values = _LOWER[raw[letter]]
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    return words, np.searchsorted(ends, at, side="right")


def _letters(word: bytes) -> int:
    return len(word) - word.count(0xC3)


def counted(words: pa.Array, text: np.ndarray, heads: np.ndarray) -> pa.Table:
    """(word, n) of runs after deletions. heads: CRC of `<doc_id>:` per text."""
    coded = words.dictionary_encode()
    known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    crc, size = np.array([zlib.crc32(w) for w in known], np.uint32), np.array([len(w) for w in known], np.int64)
    h = crc_joined(heads[text], crc[code], np.minimum(size, SHORT)[code])
    for i in np.flatnonzero((size > SHORT)[code]):
        h[i] = zlib.crc32(known[code[i]], int(heads[text[i]]))
    hit = np.flatnonzero(h % np.uint32(DIVISOR) == 0)
    n = np.bincount(code, minlength=len(known)) - np.bincount(code[hit], minlength=len(known))
    long = np.array([_letters(w) >= LETTERS for w in known], bool)
    kept = np.flatnonzero(long & (n > 0))
    changed = []
    for i in hit:
        word = known[code[i]].decode()
        if len(word) > LETTERS:
            at = int(h[i]) % len(word)
            changed.append((word[:at] + word[at + 1 :]).encode())
    both = [known[i] for i in kept] + changed
    return pa.table({"word": pa.array(both, pa.binary()), "n": np.concatenate([n[kept], np.ones(len(changed), np.int64)])})


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Rows in slices of about PART bytes."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= PART:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


def _count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables, rows = [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        every = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
        text = every["word"].cast(pa.string())
        yield from pa.table({"word": text, "n": every["n_sum"]}).to_batches(max_chunksize=10_000)

    for batch in found:
        texts = batch.column("text").cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
        for some in _parts(np.diff(ends)):
            first, last = ends[some.start], ends[some.stop]
            words, text = runs(raw[first:last], ends[some.start + 1 : some.stop + 1] - first)
            tables.append(counted(words, text, heads[some]))
            rows += len(tables[-1])
            if rows >= HELD:
                yield from summed()
                tables, rows = [], 0
    if tables:
        yield from summed()


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): words of at least LETTERS letters that occur TIMES times or more."""
    each = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


# ---- tries


def shared(a: str, b: str) -> int:
    """Letters that two words have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _number(backwards: bool):
    """Words come sorted; nodes are numbered from 1 within the task's range, the root is 0."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        last, nodes, free, row = "", [0], (part << 36) + 1, 0
        for batch in found:
            every = batch.column("word").to_pylist()
            out = []
            for word in every:
                turned = word[::-1] if backwards else word
                keep = shared(last, turned)
                new = len(turned) - keep
                nodes = nodes[: keep + 1] + list(range(free, free + new))
                free += new
                out.append(nodes)
                last = turned
            at = pa.array(range((part << 36) + row, (part << 36) + row + len(every)), pa.int64())
            row += len(every)
            yield pa.RecordBatch.from_arrays([at, batch.column("word"), batch.column("n"), pa.array([part] * len(every), pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["id", "word", "n", "part", "nodes"])

    return run


def _aliases(ends: list, backwards: bool) -> dict[int, int]:
    """Numbers of nodes that an earlier range has as well, from the first and last word of each range, in order."""
    same, last, nodes = {}, "", [0]
    for r in ends:
        first, end = ((w[::-1] if backwards else w) for w in (r.first.word, r.last.word))
        for depth in range(1, shared(last, first) + 1):
            same[r.first.nodes[depth]] = nodes[depth]
        last, nodes = end, [same.get(x, x) for x in r.last.nodes]
    return same


def _renamed(same: dict[int, int]):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            nodes = pa.array([[same.get(x, x) for x in row] for row in batch.column("nodes").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("word"), batch.column("n"), nodes], ["id", "word", "n", "nodes"])

    return run


def trie(known: DataFrame, backwards: bool = False) -> DataFrame:
    """(id, word, n, nodes): per word the numbers of the trie nodes of its prefixes (suffixes), shortest first, the root's 0
    included, and its own number, which rises in the order of sorting.

    The driver sees the first and last word of each range, so its work grows with the number of ranges."""
    order = F.reverse("word") if backwards else F.col("word")
    ranged = known.repartitionByRange(order).sortWithinPartitions(order)
    placed = stored(ranged.mapInArrow(_number(backwards), "id long, word string, n long, part long, nodes array<long>"), "trie")
    ends = placed.groupBy("part").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    tips = placed.join(ends, "part").where("id = a or id = z").groupBy("part").agg(*[f(F.struct("word", "nodes"), "id").alias(name) for f, name in ((F.min_by, "first"), (F.max_by, "last"))])
    same = _aliases(tips.orderBy("part").collect(), backwards)
    return placed.select("id", "word", "n", "nodes").mapInArrow(_renamed(same), "id long, word string, n long, nodes array<long>")


# ---- neighbours

#: How a word comes to a pair of nodes: as the whole word, without a letter, without the first of equal letters.
WHOLE, LESS, FIRST = 0, 1, 2


def pairs(ahead: DataFrame, behind: DataFrame) -> DataFrame:
    """(p, s, how, id, n): the pairs of nodes that stand for a word and for the word without one letter, from both tries."""
    both = ahead.join(behind.select("word", F.col("nodes").alias("suffixes")), "word")
    both = both.select("id", "n", "nodes", "suffixes", F.split("word", "").alias("letters"), (F.size("nodes") - 1).alias("last"))
    whole = f"transform(sequence(0, last), i -> struct(nodes[i] as p, suffixes[last - i] as s, {WHOLE} as how))"
    less = f"transform(sequence(0, last - 1), i -> struct(nodes[i] as p, suffixes[last - i - 1] as s, if(i > 0 and letters[i] = letters[i - 1], {LESS}, {FIRST}) as how))"
    return both.select(F.explode(F.expr(f"concat({whole}, {less})")).alias("e"), "id", "n").select("e.p", "e.s", "e.how", "id", "n")


#: For a group of one pair, members in order of rank: (id, how many are near, the best of them) per member and way.
NEAR = """concat(
    transform(filter(less, x -> size(less) > 1), x -> struct(x.id as id, size(less) - 1 as n, if(x.id = less[0].id, less[1], less[0]) as best)),
    transform(filter(firsts, x -> size(whole) > 0), x -> struct(x.id as id, 1 as n, whole[0] as best)),
    transform(filter(whole, x -> size(firsts) > 0), x -> struct(x.id as id, size(firsts) as n, firsts[0] as best)))"""


def neighbours(all_pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words differ by one letter, and (minus, id) of the most frequent one, minus being its negative
    count; of equal counts the first word counts. Words without neighbours are left out."""
    members = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "id", "how")))
    groups = all_pairs.groupBy("p", "s").agg(members.alias("m")).where(F.size("m") > 1)
    of = lambda rule: F.expr(f"transform(filter(m, x -> {rule}), x -> struct(x.minus as minus, x.id as id))")
    sides = groups.select(of(f"x.how <> {WHOLE}").alias("less"), of(f"x.how = {FIRST}").alias("firsts"), of(f"x.how = {WHOLE}").alias("whole"))
    each = sides.select(F.explode(F.expr(NEAR)).alias("e")).select("e.id", "e.n", "e.best")
    return each.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, most: int = 64) -> DataFrame:
    """(id, root) from (id, form): forms are followed to the last by doubling. A form is at least RATIO times as frequent as its
    word, so they never lead in a circle, and few rounds do."""
    now = stored(forms.select("id", F.col("form").alias("root")), "forms")
    for _ in range(most):
        step = now.select(F.col("id").alias("at"), F.col("root").alias("next"))
        now = stored(now.join(step, F.col("root") == F.col("at"), "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if now.where("moved").isEmpty():
            return now.select("id", "root")
        now = now.drop("moved")
    raise RuntimeError("forms lead in a circle")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    known = stored(words(docs, text, key), "words")
    ahead = stored(trie(known), "ahead")
    near = neighbours(pairs(ahead, trie(known, backwards=True))).withColumnRenamed("id", "of")
    good = -F.col("best.minus") >= RATIO * F.col("n")
    told = ahead.select("id", "word", "n").join(near, F.col("id") == F.col("of"), "left")
    told = stored(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.id")).alias("form_id"), F.when(good, -F.col("best.minus")).alias("form_n")), "near")
    far = roots(told.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = lambda at, name: told.select(F.col("id").alias(at), F.col("word").alias(name))
    followed = told.where("form_id is not null").join(far, "id").join(named("form_at", "form"), F.col("form_id") == F.col("form_at")).join(named("root_at", "root_word"), F.col("root") == F.col("root_at"))
    with_form = followed.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    without = told.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return with_form.union(without)
