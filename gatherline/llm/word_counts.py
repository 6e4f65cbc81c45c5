"""Token counts: greedy longest-match word pieces by a linear automaton, without building the pieces."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.llm.texts import blocks, tables_of

MARK = "▁"
_WORDS_KEPT = 1_000_000


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]


class Automaton:
    """A trie of the pieces. Each node knows where to go on when no child fits (its failure link) and how many
    tokens are finished on the way, so a word costs one pass over its characters."""

    def __init__(self, pieces):
        self.next: list[dict[str, int]] = [{}]
        final = [False]
        for p in pieces:
            v = 0
            for ch in p:
                u = self.next[v].get(ch)
                if u is None:
                    u = self.next[v][ch] = len(self.next)
                    self.next.append({})
                    final.append(False)
                v = u
            final[v] = v > 0
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = [0]
        for u in queue:
            for ch, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and ch not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][ch], n
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of the longest-match segmentation of ``word``; -1 if there is none."""
        u, n = 0, 0
        nxt, fail, popped = self.next, self.fail, self.popped
        for ch in word:
            while ch not in nxt[u]:
                if fail[u] < 0:
                    return -1
                n += popped[u]
                u = fail[u]
            u = nxt[u][ch]
        while u:
            if fail[u] < 0:
                return -1
            n += popped[u]
            u = fail[u]
        return n

    def counts(self, words: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > _WORDS_KEPT:
            self.known = {}
        for w in set(chain.from_iterable(words)).difference(self.known):
            self.known[w] = self.count(MARK + w)
        return [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in words]


def automaton(path: str) -> Automaton:
    held = tables_of("word_counts")
    if path not in held:
        held[path] = Automaton(pieces_of(path))
    return held[path]


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row. Words are parted by white space and marked at their start;
    a word that the pieces cannot spell is one token and counts as unknown. Null and blank texts have none.
    ``vocabulary`` names the model file."""

    def run(batches):
        a = automaton(vocabulary)
        for rows in blocks(batches):
            found = a.counts([(r[0] or "").split() for r in rows])
            cells = [(r[1], len(c), int(np.abs(c).sum()), int((c < 0).sum())) for r, c in zip(rows, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells, strict=True)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("k")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
