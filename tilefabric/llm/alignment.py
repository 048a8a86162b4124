"""Cross-tokenizer alignment by diagonal run skipping.

A text has two sequences of tokens over the same bytes, A and B, each with its
array of byte offsets at which tokens end. Where both end, a group closes. The
walk keeps the index shift between the two arrays: as long as one token stands
against one, the arrays agree at that shift, so exponential probing compares
slices of 1, 2, 4, ... ends and then halves back to the first difference; the
whole run is jumped. An irregular group is resolved on the spot, by advancing
whichever token ends first, and its surplus of tokens is the new shift. Each
step within a group is a link: a pair of tokens whose bytes overlap.

Spark's side counts, for every pair of ids, the documents that hold it linked,
and the highest count of each A id, over the whole corpus. The pairs that hold
a two-hundred-thousandth of all rows or more (so that many at most) go back to
the documents by broadcast, only the tail is shuffled.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give
back byte by byte, have no tokens, zeros and '' for the digest; repeated rows
(equal doc_id too) are documents of their own, each with its row; further
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefabric.tables import written

from .shared import heavy_join, portions, with_own_id, with_text_id
from .tokens import encoding, token_ids

#: Characters of texts that are encoded together.
AT_ONCE = 1 << 20
#: Pairs of this share of all rows are broadcast.
SHARE = 200_000
#: A pair of ids as one long: A's id times this, and B's.
BASE = 1 << 32
CUT = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


@cache
def pieces_model(name: str = "piece_bpe_32k.model"):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


@cache
def bytes_a() -> list[bytes]:
    """The bytes of each A token."""
    return [encoding().decode_single_token_bytes(i) for i in range(encoding().n_vocab)]


@cache
def bytes_b() -> list[bytes]:
    """The bytes of each B token: a byte token's own, or its piece with spaces for U+2581."""
    model = pieces_model()
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    return [bytes([int(s[3:5], 16)]) if model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]


@cache
def lengths(side: str) -> np.ndarray:
    return np.array([len(x) for x in (bytes_a() if side == "a" else bytes_b())], np.int64)


def run_length(ea: list[int], eb: list[int], i: int, j: int) -> int:
    """How many ends from ``ea[i]`` and ``eb[j]`` on agree."""
    at, step = i, 1
    shift = j - i
    while (s := ea[at : at + step]) and s == eb[at + shift : at + shift + step]:
        at += len(s)
        step *= 2
    while step > 1:
        step //= 2
        if (s := ea[at : at + step]) and s == eb[at + shift : at + shift + step]:
            at += len(s)
    return at - i


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens of A and of B close a group, and the links as two arrays of token numbers.

    Both arrays rise and end at the same offset.
    """
    ea, eb = ends_a.tolist(), ends_b.tolist()
    n = len(ea)
    plain_a, plain_b = bytearray(b"\x01") * n, bytearray(b"\x01") * len(eb)
    close_a, close_b, from_a, from_b = [], [], [], []
    i = j = 0
    while True:
        run = run_length(ea, eb, i, j)
        i, j = i + run, j + run
        if i == n:
            break
        a, b, x, y = i, j, ea[i], eb[j]
        while True:
            from_a.append(i)
            from_b.append(j)
            if x < y:
                i += 1
                x = ea[i]
            elif y < x:
                j += 1
                y = eb[j]
            else:
                break
        close_a.append(i)
        close_b.append(j)
        i, j = i + 1, j + 1
        plain_a[a:i], plain_b[b:j] = bytes(i - a), bytes(j - b)
    one_a, one_b = np.frombuffer(plain_a, bool), np.frombuffer(plain_b, bool)
    shut_a, shut_b = one_a.copy(), one_b.copy()
    shut_a[close_a], shut_b[close_b] = True, True
    links = [np.concatenate([np.flatnonzero(one), np.array(rest, np.int64)]) for one, rest in ((one_a, from_a), (one_b, from_b))]
    return shut_a, shut_b, *links


@cache
def marked_ids(size: int, marks: str) -> np.ndarray:
    """The decimal ids, each with the first mark after it, then all again with the second."""
    return np.array([f"{i}{m}" for m in marks for i in range(size)], object)


def groups_text(a: np.ndarray, b: np.ndarray, shut_a: np.ndarray, shut_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: a group's A tokens stand after all B tokens of the groups before it, its B tokens after all its A tokens."""
    last_a, last_b = np.flatnonzero(shut_a), np.flatnonzero(shut_b)
    in_a, in_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
    before = np.concatenate([[0], last_b + 1])
    out = np.empty(len(a) + len(b), object)
    va, vb = len(lengths("a")), len(lengths("b"))
    out[np.arange(len(a)) + before[in_a]] = marked_ids(va, ",|")[a + va * shut_a]
    out[np.arange(len(b)) + last_a[in_b] + 1] = marked_ids(vb, ",;")[b + vb * shut_b]
    return "".join(out.tolist())[:-1]


def described(text: str, a: np.ndarray, b: np.ndarray) -> tuple:
    """(n_a, n_b, n_groups, n_links, digest, pairs of ids, how often) of one text and its two sequences of ids."""
    none = (0, 0, 0, 0, "", [], [])
    whole = b" " + text.encode()
    if not text or b"".join([bytes_a()[i] for i in a.tolist()]) != whole or b"".join([bytes_b()[i] for i in b.tolist()]) != whole:
        return none
    shut_a, shut_b, i, j = align(np.cumsum(lengths("a")[a]), np.cumsum(lengths("b")[b]))
    pairs, times = np.unique(a[i] * BASE + b[j], return_counts=True)
    digest = hashlib.sha256(groups_text(a, b, shut_a, shut_b).encode()).hexdigest()
    return len(a), len(b), int(shut_a.sum()), len(i), digest, pairs, times


def both_ids(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids of A (for the text after a space) and of B (which puts the space there itself)."""
    b = pieces_model().encode(texts, num_threads=1)
    return [(token_ids(" " + t).astype(np.int64), np.array(x, np.int64)) for t, x in zip(texts, b, strict=True)]


def describe(encode: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]] = both_ids):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for at, to in portions(np.array([len(t) for t in texts]), AT_ONCE):
                some = texts[at:to]
                rows = [(doc, *described(t, a, b)) for doc, t, (a, b) in zip(pdf["doc_id"].iloc[at:to], some, encode(some), strict=True)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CUT.split(", ")])

    return run


def align_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document of ``docs`` (doc_id, text)."""
    texts = with_text_id(docs, F.coalesce("text", F.lit("")).alias("text"))
    cut = written(texts.mapInPandas(describe(), CUT).withColumn("rid", F.monotonically_increasing_id()))
    pairs = cut.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    pairs = written(pairs.withColumn("a", F.shiftright("pair", 32)))
    most = F.broadcast(pairs.groupBy("a").agg(F.max("n").alias("most")))  # a row for each entry of A's vocabulary at most
    counts = pairs.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    total = cut.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
    links = cut.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("rid", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    sums = heavy_join(links, counts, ["pair"], total, SHARE).groupBy("rid").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = cut.drop("pairs", "times").join(sums, "rid", "left")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return with_own_id(out, docs)


def op13(docs: DataFrame) -> DataFrame:
    return align_documents(docs)
