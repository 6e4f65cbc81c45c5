"""Plain versions of the operators, for small inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def repeats(rows, width):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every window."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, words=4):
    from xxhash import xxh64_intdigest

    parts = [w for w in _ascii_lower(text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hs = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_classes(rows, distance=4):
    fps = {d: simhash(t) for d, t in rows}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= distance]
    root = components(ids, links)
    return {d: (f"{fps[d]:016x}", root[d]) for d in ids}


def whole_ids(texts, path):
    from tokenizers import Tokenizer

    return [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed_right(rows, pieces, ids, capacity=2048):
    """Checks every rule of a packing; gives the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for d, own in ids.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own[at : at + p.length]))
            at += p.length
        assert at == len(own)
    pad = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return pad / total
