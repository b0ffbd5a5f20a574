"""Public tokenizers inside tasks.

A pre-token never reaches over a single space that is followed by a non-space character, so a text may be encoded one
blank-separated piece at a time. Pieces repeat a lot: those of many texts are numbered together (Arrow's dictionary encoding),
each worker remembers the ids of a bounded number of them, and only new ones go to the tokenizers library, many at a time.
The ids of all texts are then gathered in one array operation.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 600_000  # pieces that a worker keeps; older ones are forgotten together
AT_ONCE = 1_000  # new pieces in one call of the library
LONGEST = 64  # longer pieces are encoded but not remembered
RUNS = re.compile(r" (?=\s|$)")  # a blank that does not begin a pre-token
LINES = re.compile(r"\s\s|\s$")  # line breaks that are not between other characters
ODD = re.compile("[\x1c-\x1fΣ]")  # blanks to str.split() alone, and a letter whose lower case depends on its place


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class PieceEncoder:
    """ids of whole texts; the same ids as one call of the library per text."""

    def __init__(self, path: str):
        self.library = _library(path)
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 65536 else np.dtype("<u4")
        tokens = self.library.get_vocab()
        self.words = any(t.endswith("</w>") for t in tokens)
        self.length = np.zeros(size, np.int64)  # characters of a byte-level token stand for a byte each; of a word token, its ends count
        for token, at in tokens.items():
            self.length[at] = token.endswith("</w>") if self.words else len(token)
        if self.words:
            import regex

            self.pattern = regex.compile(json.loads(self.library.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._forget()

    def _forget(self, keep: dict[str, bytes] | None = None) -> None:
        """Remember the pieces of keep alone. Piece 0 has no ids, piece 1 stands for the end of a text."""
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts, self.sizes, self.used, self.count = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 1, 2
        self.sizes[1] = 1
        if keep:
            self.known.update(zip(keep, self._add(list(keep.values()))))

    def _add(self, each: list[bytes]) -> range:
        """Numbers of new pieces with these ids."""
        raw = np.frombuffer(b"".join(each), self.dtype)
        first, n = self.count, len(each)
        for name, need in (("ids", self.used + len(raw)), ("starts", first + n), ("sizes", first + n)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
        sizes = np.fromiter(map(len, each), np.int64, n) // self.dtype.itemsize
        self.sizes[first : first + n] = sizes
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(raw)] = raw
        self.used, self.count = self.used + len(raw), first + n
        return range(first, first + n)

    def _of(self, number: int) -> bytes:
        a = self.starts[number]
        return self.ids[a : a + self.sizes[number]].tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _measure(self, piece: str) -> int:
        """Pre-tokens of a word piece, or bytes of a byte-level one."""
        if not self.words:
            return len(piece.encode())
        return 1 if piece.isalpha() else len(self.pattern.findall(unicodedata.normalize("NFC", piece)))

    def _joined(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of pieces from calls over many of them at once."""
        for at in range(0, len(pieces), AT_ONCE):
            part = pieces[at : at + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([(" " if self.words else "").join(part)], add_special_tokens=False)[0].ids, self.dtype)
            limits, reached = np.cumsum([self._measure(p) for p in part]), np.cumsum(self.length[ids])
            ends = np.searchsorted(reached, limits, side="left") + 1
            ends[limits == 0] = 0
            ends = np.maximum.accumulate(ends)
            if not len(ids) or ends[-1] != len(ids) or not np.array_equal(reached[ends - 1], limits):
                yield from self._whole(part)  # pieces that the library does not keep apart
                continue
            raw, w = ids.tobytes(), self.dtype.itemsize
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield raw[a * w : b * w]

    def _prepared(self, text: str) -> str | None:
        """The text with a blank between all pieces; None if it has to go through the library as a whole."""
        if self.words:
            return None if ODD.search(text) else text.lower()
        if "\0" in text or RUNS.search(text):
            return None
        if not LINES.search(text):
            text = text.replace("\n", " \n")
        return text if text[:1] in ("", " ") else "\0" + text

    def _written(self, key: str) -> str:
        """The piece of a key: byte-level pieces begin with a blank or a line break, unless their text begins with them."""
        return key if self.words or key[:1] == "\n" else key[1:] if key[:1] == "\0" else " " + key

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of each text followed by the end id, one text after the other. A null text counts as empty."""
        texts = [text or "" for text in texts]
        prepared = [self._prepared(text) for text in texts]
        whole = [i for i, p in enumerate(prepared) if p is None]
        told = pa.array([p or "" for p in prepared], pa.large_string())
        lists = pc.utf8_split_whitespace(told) if self.words else pc.split_pattern(told, " ")
        found = lists.flatten().dictionary_encode()
        keys, offsets = found.dictionary.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_numpy()
        numbers = list(map(self.known.get, keys))
        missing = [i for i, number in enumerate(numbers) if number is None]
        if len(self.known) + len(missing) > REMEMBERED:  # what this batch has used goes on, with all frequent pieces
            self._forget({key: self._of(number) for key, number in zip(keys, numbers) if number and number > 1})
            numbers = list(map(self.known.get, keys))
        lasting = [i for i in missing if len(keys[i]) <= LONGEST and keys[i][0] != "\0"]
        alone = [i for i in missing if keys[i][0] == "\0"]  # only a piece that begins with a blank or a break keeps its ids among others
        long = [i for i in missing if len(keys[i]) > LONGEST and keys[i][0] != "\0"]
        for i, number in zip(lasting, self._add(list(self._joined([self._written(keys[i]) for i in lasting])))):
            numbers[i] = self.known[keys[i]] = number
        self.ids[0] = end
        used, count = self.used, self.count
        passing = self._add([*self._whole([keys[i][1:] for i in alone]), *self._joined([self._written(keys[i]) for i in long]), *self._whole([texts[i] for i in whole])])
        for i, number in zip([*alone, *long], passing):
            numbers[i] = number
        pieces = np.array(numbers, np.int64)[found.indices.to_numpy()]
        # the end of each text, and before it the one piece of a text that went through the library as a whole
        at = np.concatenate([offsets[1:][whole], offsets[1:]]).astype(np.int64)
        pieces = np.insert(pieces, at, np.concatenate([np.array(passing[len(alone) + len(long) :], np.int64), np.ones(len(texts), np.int64)]))
        ends = offsets[1:] + np.cumsum(np.isin(np.arange(len(texts)), whole)) + np.arange(1, len(texts) + 1)
        sizes = self.sizes[pieces].astype(np.int64)
        until = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[pieces] - until + sizes, sizes) + np.arange(until[-1] if len(until) else 0)]
        self.used, self.count = used, count
        limits = until[ends - 1]
        return ids, np.diff(limits, prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and vocabulary."""
    return PieceEncoder(path)


def forget() -> None:
    """Drop the encoders of this worker."""
    encoder.cache_clear()
    _library.cache_clear()


def batches(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Texts in runs of about `most` characters, so that memory follows the longest text and not the batch."""
    run: list[str | None] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size > most:
            yield run
            run, size = [], 0
    if run:
        yield run
