"""Plain-Python versions of the operators, row by row, for tests."""

import math
import struct
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import xxhash

from tilefabric.llm import mixing, quality


def spark_hash(*values):
    """Spark's xxhash64: ("i", int), ("l", long) or ("s", text), each with the hash before it as its seed."""
    h = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def feistel(x, n, key):
    n = max(n, 1)
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(v):
        hi, lo = divmod(v, b)
        for r in range(4):
            if r % 2 == 0:
                hi = (hi + spark_hash(("l", lo), key, ("i", r)) % a) % a
            else:
                lo = (lo + spark_hash(("l", hi), key, ("i", r)) % b) % b
        return hi * b + lo

    x = once(x)
    while x >= n:
        x = once(x)
    return x


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def mix(rows, block=mixing.BLOCK, seed=17):
    """For each of ``rows`` (doc_id, text, source): its words, and for each pass the ranges of them that are taken."""
    docs, streams = [], defaultdict(list)
    for k, (doc, text, source) in enumerate(rows):
        words = (text or "").encode().split()
        docs.append(words)
        streams[source].append(((doc is not None, doc or 0), spark_hash(("s", text or "")), len(words), k))
    size = {s: sum(r[2] for r in rs) for s, rs in streams.items()}
    target, out = targets(size), [defaultdict(list) for _ in rows]
    for s, rs in streams.items():
        if not size[s]:
            continue
        passes, blocks = int(target[s] // size[s]), -(-size[s] // block)
        rest = min(math.floor((target[s] - passes * size[s]) / block + 0.5), blocks)
        name = ("s", s or ""), ("i", int(s is None))
        drawn = defaultdict(set)
        for j in range(passes * blocks + rest):
            key = ("l", spark_hash(*name, ("l", j // blocks), ("i", seed)))
            drawn[feistel(j % blocks, blocks, key)].add(j // blocks)
        at = 0
        for _, _, n, k in sorted(rs):
            for b in range(at // block, (at + n - 1) // block + 1 if n else 0):
                lo, hi = max(at, b * block) - at, min(at + n, (b + 1) * block) - at
                for p in drawn[b]:
                    out[k][p].append((lo, hi))
            at += n
    return size, target, docs, out


def score(m, text):
    """The classifier's forward pass for one text, passage by passage."""
    if not isinstance(m, quality.Model):
        return m
    raw = (text or "").encode()
    cut = [raw[a : a + quality.PASSAGE] for a in range(0, max(1, len(raw)), quality.PASSAGE)]
    hidden = [np.tanh(features(p) @ m.e + m.b) for p in cut]
    gate = [float(m.w @ (np.tanh(h @ m.v) * (1 / (1 + np.exp(-(h @ m.u)))))) for h in hidden]
    weight = [math.exp(g - max(gate)) for g in gate]
    z = sum(w * h for w, h in zip(weight, hidden, strict=True)) / sum(weight)
    return 1 / (1 + math.exp(-float(np.clip(z @ m.c + m.d[0], -30, 30))))


@cache
def character_class(byte):
    if byte in quality.SINGLES:
        return quality.SINGLES.index(byte)
    for k, group in enumerate(quality.GROUPS):
        if byte in group:
            return len(quality.SINGLES) + k
    return quality.CLASSES - (1 if byte >= 128 else 2)


def features(p):
    """Roots of the shares of class pairs, length, and the shares of words that repeat, are new, and their number."""
    x = np.zeros(quality.CLASSES * quality.CLASSES + 4)
    for a, b in zip(p, p[1:]):
        x[character_class(a) * quality.CLASSES + character_class(b)] += 1
    x[:-4] = np.sqrt(x[:-4] / max(1, len(p) - 1))
    words = p.split()
    again = sum(a == b for a, b in zip(words, words[1:]))
    x[-4:] = len(p) / quality.PASSAGE, again / max(1, len(words)), len(set(words)) / max(1, len(words)), 8 * len(words) / quality.PASSAGE
    return x


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def token_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def cut_pieces(doc, text, capacity=2_048):
    ids = np.array([*token_ids(text), 0], "<u4")
    cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
    return Counter((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))


def spectrum(text):
    """Buckets of the byte n-grams of 1 to 4 bytes."""
    raw = b" ".join([b"", *text.encode().lower().split(), b""]) if text else b""
    raw = raw if text[:1].isspace() else raw[1:]
    raw = raw if text[-1:].isspace() else raw[:-1]
    out = set(raw)
    for n in range(1, 4):
        for k in range(len(raw) - n):
            gram = int.from_bytes(raw[k : k + n + 1], "big")
            out.add(((gram + n) * 2_654_435_761) % 2**32 >> 16)
    return out
