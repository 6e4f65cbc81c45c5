"""SentencePiece encoding and decoding: Viterbi over the distinct marked words, sharing the work of common prefixes."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.llm.texts import blocks, tables_of

MARK = "▁"
_UNKNOWN_PENALTY = 10.0
_WORDS_KEPT = 500_000
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """Pieces, scores and byte pieces of a model file. A character that no piece spells becomes its UTF-8 bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[float, int]] = {}
        self.byte, self.text = {}, {}
        for i in range(m.vocab_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i)):
                self.score[p] = (m.get_score(i), i)
                self.text[i] = p.replace(MARK, " ").encode()
        self.text.update({i: bytes([b]) for b, i in self.byte.items()})
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s, _ in self.score.values()) - _UNKNOWN_PENALTY
        self.known: dict[str, bytes] = {}
        self.ends: dict = {}  # the pieces' trie from their last characters back; "" has what is a piece
        for p, got in self.score.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = got

    def segment(self, words: list[str]) -> list[list[int]]:
        """The best-scoring ids of each of the sorted ``words``.

        Going through a sorted list is a walk of its trie, depth first: the forward scores of the prefix that
        a word shares with the one before stay, and only the characters after it are scored.
        """
        best, back = [0.0], [(0, -1)]
        before = ""
        out = []
        for w in words:
            keep = 0
            for x, y in zip(before, w):  # noqa: B905
                if x != y:
                    break
                keep += 1
            del best[keep + 1 :], back[keep + 1 :]
            n, turned = len(w), w[::-1]
            for end in range(keep + 1, n + 1):
                least = top = best[end - 1] + self.unknown
                link = (end - 1, -1)
                node, start = self.ends, end
                for c in turned[n - end : n - end + self.longest]:
                    node = node.get(c)
                    if node is None:  # no piece ends so
                        break
                    start -= 1
                    got = node.get("")
                    if got is not None:
                        s = best[start] + got[0]
                        if s >= top and s > least:  # of equal ones the longest piece
                            top, link = s, (start, got[1])
                best.append(top)
                back.append(link)
            ids, at = [], len(w)
            while at:
                start, i = back[at]
                if i < 0:
                    ids += [self.byte[b] for b in reversed(w[start:at].encode("utf-8", "surrogatepass"))]
                else:
                    ids.append(i)
                at = start
            out.append(ids[::-1])
            before = w
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Spaces are marks, and each text starts with one more; a mark in the text itself is spelt in bytes."""
        split = [_MARKED.findall(part) for t in texts for part in _marked(t)]
        if len(self.known) > _WORDS_KEPT:
            self.known = {}
        new = sorted(set().union(*split).difference(self.known))
        self.known.update(zip(new, [array("I", ids).tobytes() for ids in self.segment(new)], strict=True))
        literal = array("I", [self.byte[b] for b in MARK.encode()]).tobytes()
        out, at = [], 0
        for t in texts:
            n = t.count(MARK) + 1
            spelt = [b"".join(map(self.known.__getitem__, ws)) for ws in split[at : at + n]]
            out.append(np.frombuffer(literal.join(spelt), np.uint32))
            at += n
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _marked(text: str) -> list[str]:
    """The parts of a text between its own marks; all but the first start without one, with what they hold up to a space unmarked."""
    first, *rest = text.split(MARK)
    return [MARK + first.replace(" ", MARK), *[r.replace(" ", MARK) for r in rest]]


def model(path: str) -> Pieces:
    held = tables_of("pieces")
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; a null text has null ids, an empty one the mark alone."""

    def run(batches):
        m = model(path)
        for rows in blocks(batches, 1 << 19):
            ids = [None if r[0] is None else x for r, x in zip(rows, m.encode([r[0] or "" for r in rows]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("k")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def run(batches):
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if ids is None else m.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding
    gives the text back, of every row; a null text counts as empty."""

    def run(batches):
        m = model(path)
        spelt = np.zeros(max(m.text) + 1, bool)
        spelt[list(m.byte.values())] = True
        for rows in blocks(batches, 1 << 19):
            cells = [(r[1], len(x), int(spelt[x].sum()), zlib.crc32(x.astype("<u4").tobytes()), m.decode(x.tolist()) == (r[0] or "")) for r, x in zip(rows, m.encode([r[0] or "" for r in rows]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), [pa.int64()] * 4 + [pa.bool_()], strict=True)], ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"])

    return docs.select(F.col("text").cast("string").alias("t"), F.col("doc_id").cast("long").alias("k")).mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
