"""Secret scans: candidates by pattern, then a random forest over what they look like and stand next to."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gatherline.llm import forest
from gatherline.llm.texts import blocks, lean, tables_of, whole_rows

#: Documents that a forest is fitted on, in expectation: those whose id hashes lowest.
FIT_DOCS = 20_000
#: Findings that a forest is fitted on at most.
FIT_FINDINGS = 20_000
THRESHOLD = 0.5

# fixed values: words that name a secret, words that mark a placeholder, prefixes and shapes of well-known keys
_NAMES = r"password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|bearer"
_PLACEHOLDER = re.compile(r"example|sample|placeholder|changeme|dummy|redacted|your[_-]|xxxx|\*\*\*|0000000|1234567|abcdef1|<.*>|\$\{", re.I)
_KEY_SHAPES = (
    r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"glpat-[A-Za-z0-9_-]{20}", r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{35}", r"sk_live_[A-Za-z0-9]{16,}", r"sk-[A-Za-z0-9_-]{20,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)
_KEY = re.compile("|".join(f"(?:{s})" for s in _KEY_SHAPES))
_KEY_INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{_KEY.pattern})(?![A-Za-z0-9])")
_SIGN = r"[\"']?\s?(?::|=>?|is)\s?[\"']?"
#: A whole identifier (snake, kebab, dotted or camel case) with a secret's name in it that ends at a part's end, and its value.
_NAMED = re.compile(
    rf"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]++{_SIGN})(?>[A-Za-z0-9_.-]*?(?:{_NAMES})s?(?:(?![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z]))))[A-Za-z0-9_.-]*+"
    rf"{_SIGN}(?P<value>[^\s\"',;<>]{{6,}}+)",
    re.I,
)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_~.-])[A-Za-z0-9+/_~-][A-Za-z0-9+/_~.-]{10,}+(?:={1,2}(?![A-Za-z0-9+/_~.=-]))?+")
_NEAR = re.compile(_NAMES, re.I)
#: One of these is in every lower-case text with a secret's name, unless it has letters that match s or i and are neither.
_HINTS, _LIKE_ASCII = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer"), ("\u017f", "\u0130", "\u0131")
_ALPHA = re.compile(r"[A-Za-z]{3,}")
_PARAMETER = re.compile(r"[?&=#]")  # what follows is no part of a path
_WORD_BEFORE = re.compile(r"(\S+)\s*\Z")
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "others", "changes", "letter_to_digit", "longest_run", "steps", "rare_pairs",
    "dictionary", "slashes", "dots", "path_before", "named", "name_near", "quoted", "key_shape", "all_digits", "all_hex", "placeholder", "word_after",
)


def dictionary(path: str) -> frozenset:
    """Whole lower-case words of four letters or more in a public tokenizer's vocabulary file."""
    held = tables_of("secrets")
    if path not in held:
        from tokenizers import Tokenizer

        held[path] = frozenset(t[:-4] for t in Tokenizer.from_file(path).get_vocab() if t.endswith("</w>") and len(t) >= 8 and t[:-4].isascii() and t[:-4].isalpha())
    return held[path]


def _covered(value: str, words: frozenset) -> float:
    """The share of characters in dictionary words, longest first from the left."""
    n = 0
    for run in _ALPHA.findall(value.lower()):
        at = 0
        while at < len(run):
            hit = next((k for k in range(min(16, len(run) - at), 3, -1) if run[at : at + k] in words), 0)
            n += hit
            at += hit or 1
    return n / len(value)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _describe(value: str, before: str, after: str, named: bool, words: frozenset) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    counts = Counter(value)
    changes = sum(a != b for a, b in pairwise(kinds))
    mixed = sum((a == 0) != (b == 0) and 3 not in (a, b) for a, b in pairwise(kinds))
    longest = run = 1
    steps = 0
    for a, b in pairwise(value):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
        steps += abs(ord(b) - ord(a)) <= 1
    vowels = "aeiouAEIOU"
    rare = sum(a.isalpha() and b.isalpha() and a not in vowels and b not in vowels for a, b in pairwise(value))
    last = _WORD_BEFORE.search(before)
    last = _PARAMETER.split(last[1])[-1] if last else ""
    return [
        n, -sum(c / n * math.log2(c / n) for c in counts.values()), *share, changes / n, mixed / n, longest, steps / n, rare / n,
        _covered(value, words), value.count("/") / n, value.count(".") / n, float("/" in last or "://" in last[-12:] or last.startswith("www.")), float(named),
        float(bool(_NEAR.search(before))), float(before[-1:] in "\"'`" and before != ""), float(bool(_KEY.fullmatch(value))), float(share[0] == 1),
        float(all(c in "0123456789abcdefABCDEF-" for c in value)), float(bool(_PLACEHOLDER.search(value))), float(after[:2].strip().isalpha()),
    ]


def candidates(text: str, words: frozenset) -> list[tuple[int, int, list[float]]]:
    """(start, end, features) of all that may be a secret in a whole text: values of names, then other opaque runs,
    or the well-known keys inside them."""
    low = text.lower()
    may = any(x in low for x in _HINTS) or not text.isascii() and any(x in text for x in _LIKE_ASCII)
    spans = [(*m.span("value"), True) for m in _NAMED.finditer(text)] if may else []
    taken, others = 0, []
    for m in _OPAQUE.finditer(text):
        while taken < len(spans) and spans[taken][1] <= m.start():
            taken += 1
        if taken < len(spans) and spans[taken][0] <= m.start():
            continue  # part of a named value
        keys = [k.span() for k in _KEY_INSIDE.finditer(m[0])]
        if keys:
            others += [(m.start() + a, m.start() + b, False) for a, b in keys]
        elif len(m[0]) >= 12 and any(c.isdigit() for c in m[0]):
            others.append((*m.span(), False))
    return [(a, b, _describe(text[a:b], text[max(0, a - 48) : a], text[b : b + 12], named, words)) for a, b, named in sorted(spans + others)]


def known(f: list[float]) -> int | None:
    """A label for findings that rules settle: well-known key shapes and random named values are secrets; numbers,
    placeholders, paths and words are not. None where only the forest can tell."""
    x = dict(zip(FEATURES, f, strict=True))
    if x["placeholder"] or x["dictionary"] > 0.6:
        return 0
    if x["key_shape"]:
        return 1
    if x["path_before"] or (x["digits"] + x["others"] > 0.9 and not x["named"]):
        return 0
    if x["named"] and x["entropy"] > 2.5 and x["length"] >= 8 and x["digits"] > 0:
        return 1
    if x["named"] and x["digits"] == 0 and x["changes"] < 0.15:
        return 0
    return None


def findings(docs: DataFrame, words_path: str) -> DataFrame:
    """(doc_id, start, length, features) of all candidates."""

    def run(batches):
        words = dictionary(words_path)
        for rows in blocks(batches):
            out = [(r[1], a, b - a, f) for r in rows for a, b, f in candidates(r[0] or "", words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.list_(pa.float64())], strict=True)], ["doc_id", "start", "length", "features"])

    return docs.select(F.col("text").cast("string").alias("t"), F.col("doc_id").cast("long").alias("k")).mapInArrow(run, "doc_id long, start long, length long, features array<double>")


def fit(labelled: DataFrame) -> list[np.ndarray]:
    """A forest from labelled findings (features, label 0 or 1); null labels teach nothing. At most FIT_FINDINGS
    rows, those that hash lowest, are read. With labels of one kind, or none, there are no trees."""
    rows = labelled.where("label is not null").orderBy(F.xxhash64("features", "label")).limit(FIT_FINDINGS).select("features", "label").collect()
    if len({r.label for r in rows}) < 2:
        return []
    return forest.grow(labelled.sparkSession, np.array([r.features for r in rows]), np.array([r.label for r in rows], float))


def labelled_findings(docs: DataFrame, words_path: str, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Findings that rules can label, from about ``fit_docs`` documents, as a start where no reviewed ones are at hand."""
    n = docs.count()
    draw = F.xxhash64("doc_id", F.lit("secret sample")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    found = findings(docs.where(draw < min(1.0, fit_docs / max(1, n))), words_path)

    def run(batches):
        for batch in batches:
            labels = [known(f) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.int64())], ["doc_id", "features", "label"])

    return found.select("doc_id", "features").mapInArrow(run, "doc_id long, features array<double>, label long")


def _scored(trees, found: list[list[float]]) -> np.ndarray:
    """Scores of findings by the forest, all of them. Only where there are no trees (no labels, or of one kind) the rules
    that label the sample score what they settle, and the rest a half."""
    if trees and found:
        return forest.predict(trees, np.array(found))
    return np.array([0.5 if (y := known(f)) is None else float(y) for f in found])


def scan(docs: DataFrame, words_path: str, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length (code points), named, score and is_secret of every candidate in every whole text.

    ``labelled`` are reviewed findings; without them rules label the sample that the forest is fitted on. The forest scores every candidate. Null and empty texts have none;
    repeated rows are scanned each. The forest is bounded by its trees and depth, and is broadcast.
    """
    trees = fit(labelled if labelled is not None else labelled_findings(docs.select("doc_id", "text"), words_path))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    named = FEATURES.index("named")

    def run(batches):
        for batch in batches:
            f = batch.column("features").to_pylist()
            s = _scored(shared.value, f)
            cells = [batch.column("doc_id"), batch.column("start"), batch.column("length"), pa.array([bool(x[named]) for x in f], pa.bool_()), pa.array(s, pa.float64()), pa.array(s > THRESHOLD, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "length", "named", "score", "is_secret"])

    return findings(docs, words_path).mapInArrow(run, "doc_id long, start long, length long, named boolean, score double, is_secret boolean")


def redact(docs: DataFrame, words_path: str, labelled: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each confirmed secret replaced by ``mark``; every row and column stays, n_chars follows the text."""
    trees = fit(labelled if labelled is not None else labelled_findings(docs.select("doc_id", "text"), words_path))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    source = docs.select(F.col("text").cast("string").alias("text"), whole_rows(docs, "text", "n_chars").alias("rest_"))

    def run(batches):
        words = dictionary(words_path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [(i, a, b, f) for i, t in enumerate(texts) for a, b, f in candidates(t or "", words)]
            parts, ends = {}, {}
            for (i, a, b, _), s in zip(found, _scored(shared.value, [f for *_, f in found]), strict=True):  # a batch's findings at once
                if s > THRESHOLD:
                    parts.setdefault(i, []).extend((texts[i][ends.get(i, 0) : a], mark))
                    ends[i] = b
            for i, p in parts.items():
                texts[i] = "".join([*p, texts[i][ends[i] :]])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["rest_", "text"])

    out = source.mapInArrow(lean(run, "secrets"), StructType([source.schema["rest_"], StructField("text", StringType())]))
    cells = {c: F.col(f"rest_.`{c}`") for c in others} | {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[cells[c].alias(c) for c in docs.columns])
