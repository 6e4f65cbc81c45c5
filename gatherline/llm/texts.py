"""Text helpers shared by the operators: blocks of a bounded size, word hashes in numpy, row slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_POWERS: dict[int, np.ndarray] = {}

# ASCII white space; and everything in ASCII that is neither letter nor digit
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def blocks(batches, limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows of Arrow record batches as tuples, in lists whose first column's text stays near ``limit`` characters.

    A single longer text makes a block of its own.
    """
    for batch in batches:
        sizes = [0 if v is None else v for v in _lengths(batch.column(0))]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield _rows(batch, start, i)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield _rows(batch, start, batch.num_rows)


def _lengths(column):
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def _rows(batch, a: int, b: int) -> list[tuple]:
    part = batch.slice(a, b - a)
    return list(zip(*(c.to_pylist() for c in part.columns), strict=True))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end) of ``data``; depends on the bytes alone."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _powers(_MULT, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts])


def word_hashes(texts: list[bytes], separators: np.ndarray = WHITE, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one more entry at the end)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = separators[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # long texts in slices that end between words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step)))
        lo = int(starts[at])
        out[at:to] = range_hashes(data[lo : int(ends[to - 1])], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out, np.searchsorted(starts, firsts)


def short_batches(spark, rows: int = 1_000) -> None:
    """Fewer rows in an Arrow batch: whole texts go through Python workers, and a batch must stay small there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


_TABLES: dict[str, dict] = {}


def tables_of(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks. Workers outlive a stage, so the tables of other
    operators are dropped: only one operator's are held at a time."""
    for other in [k for k in _TABLES if k != owner]:
        del _TABLES[other]
    return _TABLES.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory of a Python worker to the machine: workers outlive tasks and would keep their largest heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


def lean(fn, owner: str = ""):
    """``fn`` over Arrow batches; it starts without the tables of other operators and gives memory back at its end."""

    def run(batches):
        tables_of(owner)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def whole_rows(docs, *leave_out: str):
    """All columns but some in one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in leave_out])


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
