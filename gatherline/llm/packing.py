"""Harmonic packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.llm.texts import blocks, lean, tables_of

CAPACITY = 2_048
END_ID = 1
#: Rests shorter than this are not cut further.
LEAST_CUT = 64
_WORDS_KEPT = 500_000
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Lower-case letters, and marks that neither join them nor start a contraction.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)\Z")


class _Numbers(dict):
    """Numbers words as they are looked up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Encoder:
    """Token ids of texts by a public tokenizer, each distinct word encoded once.

    The tokenizer lower-cases, drops white space and never joins what white space parts, so a Latin-1 text's
    ids are those of its words in order. Other texts, and texts that spell special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for runs of lower-case letters, which need no clean-up
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self):
        self.index = _Numbers()  # words, and the letters of words that end in marks
        self.marks: dict[str, tuple[int, int]] = {}  # where the marks' ids are
        self.ids = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.spans = np.zeros((1 << 16, 2), np.int64)

    def _put(self, ids: np.ndarray) -> int:
        at, n = self.filled, len(ids)
        if at + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids)), np.uint32)])
        self.ids[at : at + n] = ids
        self.filled += n
        return at

    def _numbers(self, words) -> np.ndarray:
        """The words' numbers, with room for their spans; a span that ends at 0 is not known yet."""
        out = np.fromiter(map(self.index.__getitem__, words), np.int64)
        more = len(self.index) - len(self.spans)
        if more > 0:
            self.spans = np.concatenate([self.spans, np.zeros((max(more, len(self.spans)), 2), np.int64)])
        return out

    def _gather(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans, one after the other, and where each span's end."""
        a, b = spans.T
        n = b - a
        ends = np.cumsum(n)
        return self.ids[np.repeat(a - (ends - n), n) + np.arange(int(n.sum()))], ends

    def _learn(self, words: list[str]) -> None:
        cores, marked, other = {}, [], []
        for w in words:
            m = _PLAIN.match(w)
            if not m:
                other.append(w)
            elif m[2]:
                cores[m[1]] = None
                marked.append((w, m[1], m[2]))
            else:
                cores[w] = None
        names = self._numbers(cores)
        missing = self.spans[names, 1] == 0
        new, names = [c for c, x in zip(cores, missing, strict=True) if x], names[missing]
        for i in range(0, len(new), 2_000):
            some = new[i : i + 2_000]
            ids = np.array(self.bare.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            at = self._put(ids)
            stops = np.flatnonzero(self.ends[ids]) + 1
            assert len(stops) == len(some)
            self.spans[names[i : i + 2_000]] = np.stack((at + np.append(0, stops[:-1]), at + stops), 1)
        if marked:
            for m in {m for _, _, m in marked}.difference(self.marks):
                self.marks[m] = (self._put(self._ids(m)), self.filled)
            letters = self.spans[self._numbers(c for _, c, _ in marked)]
            ids, ends = self._gather(np.stack((letters, [self.marks[m] for _, _, m in marked]), 1).reshape(-1, 2))
            stops = ends[1::2] + self._put(ids)
            self.spans[self._numbers(w for w, _, _ in marked)] = np.stack((np.append(self.filled - len(ids), stops[:-1]), stops), 1)
        if other:
            self.spans[self._numbers(other)] = [(self._put(self._ids(w)), self.filled) for w in other]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > _WORDS_KEPT:
            self.forget()
        usual, words = [], []
        for t in texts:
            try:
                ok = (t.isascii() or bool(t.encode("latin-1"))) and not any(x in t for x in _ODD)
            except UnicodeEncodeError:
                ok = False
            usual.append(ok)
            words.append(t.lower().split() if ok else [])
        known = len(self.index)
        at = self._numbers(chain.from_iterable(words))
        if len(self.index) > known:
            self._learn(list(islice(self.index, known, None)))
        flat, ends = self._gather(self.spans[at])
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, words)])]
        return [flat[cuts[i] : cuts[i + 1]] if usual[i] else self._ids(t) for i, t in enumerate(texts)]


def encoder(path: str) -> Encoder:
    held = tables_of("packing")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def pieces(n: int, capacity: int = CAPACITY, least: int = LEAST_CUT) -> list[tuple[int, int]]:
    """(start, length) of the pieces that a document of ``n`` tokens is cut into.

    Whole sequences first, then halves, quarters and so on of the capacity, down to ``least``: these fill
    their class's bins without a gap. What is left, shorter than ``least``, stays in one piece.
    """
    out, at, size = [], 0, capacity
    while n - at >= least and size >= least:
        while n - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    return out + [(at, n - at)] if at < n else out


class Bins:
    """Open bins of one worker. A piece of length l is of class capacity // l; a bin takes that many of a class."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, ids: np.ndarray):
        """Yields rows (piece..., ids, sequence, offset) when a bin is full."""
        k = self.capacity // len(ids)
        held = self.open.setdefault(k, [])
        held.append((piece, ids))
        if len(held) == k:
            del self.open[k]
            yield from self._close(held)

    def _close(self, held):
        at = 0
        for piece, ids in held:
            yield piece, ids, self.next, at
            at += len(ids)
        self.next += 1

    def rest(self):
        """Bins that never filled: their pieces end to end, cut where a sequence is full, and at last at powers of two."""
        queue = [x for k in sorted(self.open) for x in self.open[k]]
        self.open = {}
        left = sum(len(ids) for _, ids in queue)
        room, at = 0, 0
        for (key, start, whole), ids in queue:
            done = 0
            while done < len(ids):
                if at == room:
                    if room:
                        self.next += 1
                    room, at = (self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)), 0
                n = min(len(ids) - done, room - at)
                yield (key, start + done, whole), ids[done : done + n], self.next, at
                done, at, left = done + n, at + n, left - n
        if queue:
            self.next += 1


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's tokens are its text's ids and ``end_id``; a null text has the end id alone, and repeated rows
    are packed each. Every worker fills bins of its own, so there is no shuffle; its number is in the upper
    bits of a sequence_id. A sequence is wholly in one task's output, so a task that runs again gives whole
    sequences again. Nothing is held but the open bins and one block of texts. ``tokenizer`` names the file.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        bins = Bins(TaskContext.get().partitionId() << 36, capacity)

        def table(rows):
            cells = [(p[0], p[1], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p[2], seq, at) for p, ids, seq, at in rows]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells, strict=True)], names)

        for rows in blocks(batches):
            out = []
            for (_, k), ids in zip(rows, enc.encode([r[0] or "" for r in rows]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for start, n in pieces(len(ids), capacity, min(LEAST_CUT, capacity)):
                    out += bins.add((k, start, len(ids)), ids[start : start + n])
            yield from table(out)
        yield from table(bins.rest())

    schema = ", ".join(f"{n} long" for n in names)
    return docs.select(F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("k")).mapInArrow(lean(run, "packing"), schema)
