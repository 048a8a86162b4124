"""Hard negatives, nearest neighbours and tokenizer alignment against brute force."""

import hashlib
import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefabric.llm import alignment, hard_negatives, neighbours

VECTORS = "vec_id long, embedding array<float>, label int, score double, id string, len int"
BIG = 2**60 + 1


def awkward(rng, n, d):
    """Clusters, exact and near copies, ties, and every row that must take no part."""
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(6, size=n)] + rng.normal(size=(n, d)) * 0.7
    x[n // 2 : n // 2 + 40] = x[3]
    x[n // 2 + 40 : n // 2 + 60] = x[3] + rng.normal(size=(20, d)) * 0.01
    rows = [(k, [float(c) for c in np.float32(v)], int(rng.integers(0, 4)), 0.5, "x", 1) for k, v in enumerate(x)]
    bad = float("nan"), float("inf"), None
    rows += [(10_000 + 100 * k, [1.0] * (d - 1) + [b], 1, None, None, None) for k, b in enumerate(bad)]
    rows += [(20_000, None, 1, None, None, None), (20_100, [1.0] * d, None, None, None, None), (20_200, [0.0] * d, 2, None, None, None), (20_300, [], 1, None, None, None), (20_400, [], 2, None, None, None)]
    rows += [(None, rows[5][1], 1, None, None, None), (BIG, rows[5][1], 2, None, None, None), (BIG - 1, rows[5][1], 1, None, None, None)]
    rows += [(30_000, [1.0, 2.0, 3.0], 1, None, None, None), (30_050, [1.0, 2.0, 3.5], 2, None, None, None), (30_051, [1.0, 1.5, 3.5], 1, None, None, None)]
    return rows + [rows[0], rows[0], rows[100]]


def finite(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def last(i):
    return (i is None, i or 0)


def mined(rows, top=5):
    good = []
    for i, v, label, *_ in rows:
        if label is not None and finite(v):
            good.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * c) for c in v]))
    out = []
    for k, (i, label, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scored = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), last(j), j, m) for q, (j, m, w) in enumerate(good) if q != k and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for s, _, p, _ in [s for s in scored if s[3] == label][:top]:
            inside = [t for t in scored if t[3] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:top]
            out += [(i, p, r + 1, t[2], -s, -t[0]) for r, t in enumerate(inside)]
    return out


def columns(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize(("block", "part"), [(8_192, 4_096), (64, 3)])
def test_hard_negatives(spark, monkeypatch, block, part):
    rows = awkward(np.random.default_rng(1), 700, 12)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label, block=block, part=part)
    want = mined(rows)
    assert columns(got, *MINED) == Counter(want) and len(want) > 100
    assert columns(hard_negatives.op11(df), *MINED) == Counter(want)


def test_hard_negatives_of_awkward_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.op11(empty).collect() == []
    assert hard_negatives.op11(spark.createDataFrame([(0, [1.0], 1, 0.0, "", 1)], VECTORS)).collect() == []
    huge = [(100 * k, [3e38 / (k + 1), -1e30, 1e-40], k % 2 + 1, 0.0, "", 1) for k in range(12)] + [(1 + k, [2.0**20 + k, 7.0, 0.0], k % 2 + 1, 0.0, "", 1) for k in range(10)]
    df = spark.createDataFrame(huge, VECTORS)
    # Components are those that Spark's floats hold.
    exact = [(i, [float(np.float32(c)) for c in v], *rest) for i, v, *rest in huge]
    assert columns(hard_negatives.op11(df), *MINED) == Counter(mined(exact))


def test_the_scan_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4_000, 3))
    lists, read = hard_negatives.Lists(x.tolist()), []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype != bool:
                read.append(len(at))
            return super().__getitem__(at)

    lists.kinds[np.float32] = lists.x.astype(np.float32).view(Counted)
    anchor = lists.x[7]
    scores = (lists.x @ anchor).astype(np.int64)
    fits = np.arange(4_000) != 7
    ((rows, got),) = hard_negatives.scan(lists, anchor, fits, [(-(2**63), 2**63 - 1)], 5)
    kth = np.sort(scores[fits])[-5]
    assert set(rows.tolist()) == set(np.flatnonzero(fits & (scores >= kth)).tolist()) and (got == scores[rows]).all()
    assert sum(read) < 2_000
    low, high = int(np.quantile(scores, 0.98)), int(np.quantile(scores, 0.99))
    ((rows, got),) = hard_negatives.scan(lists, anchor, fits, [(low, high)], 5)
    inside = np.sort(scores[fits & (scores >= low) & (scores <= high)])
    assert sorted(got.tolist())[-5:] == inside[-5:].tolist()


def cosine_top(rows, top=5):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if finite(v) and any(c != 0 for c in v)]
    sizes = {len(v) for _, v in good}
    out = {}
    for d in sizes:
        own = [(i, v) for i, v in good if len(v) == d]
        x = np.array([v for _, v in own])
        for k, (i, v) in enumerate(own):
            if i is None or i % 50:
                continue
            s = neighbours.cosines(v, x)
            order = sorted((q for q in range(len(own)) if q != k), key=lambda q: (-s[q], last(own[q][0])))[:top]
            out.setdefault(i, []).append([(own[q][0], s[q]) for q in order])
    return out


def test_neighbours_are_exact_without_codebooks(spark):
    rows = awkward(np.random.default_rng(2), 600, 8)
    got = {}
    for r in neighbours.op12(spark.createDataFrame(rows, VECTORS).repartition(4)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = cosine_top(rows)
    assert set(got) == set(want)
    for q, lists in want.items():
        assert Counter((k + 1, i, s) for one in lists for k, (i, s) in enumerate(one)) == Counter(got[q])


@pytest.mark.parametrize("shape", ["noise", "clusters", "copies"])
def test_neighbours_recall(spark, shape):
    rng = np.random.default_rng(3)
    n, d = 6_000, 24
    x = rng.normal(size=(n, d))
    if shape == "clusters":
        x = rng.normal(size=(200, d))[rng.integers(200, size=n)] + x * 0.15
    elif shape == "copies":
        x[: n // 3] = x[0] + x[: n // 3] * 0.02  # a third of all rows in one cell
    rows = [(k, [float(c) for c in np.float32(v)], 0, 0.0, "", 1) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in neighbours.neighbours(df, F.col("vec_id") % 50 == 0, many=1_000, sample=2_000, reach=300, block=1_000, part=50).collect()}
    want = {(q, i): s for q, lists in cosine_top(rows).items() for i, s in lists[0]}
    assert len(got) == len(want) and all(got[k] == want[k] for k in got.keys() & want.keys())
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)


def test_cells_come_by_summed_distance_and_clusters_end_the_walk():
    rng = np.random.default_rng(5)
    d1, d2 = rng.random(9), rng.random(13)
    cells = list(neighbours.in_order(d1, d2))
    sums = (d1[:, None] + d2).ravel()
    assert sorted(cells) == list(range(117)) and (np.diff(sums[cells]) >= 0).all()


def test_neighbours_of_awkward_tables(spark):
    assert neighbours.op12(spark.createDataFrame([], VECTORS)).collect() == []
    assert neighbours.op12(spark.createDataFrame([(0, [1.0], 1, 0.0, "", 1)], VECTORS)).collect() == []
    few = [(0, [3e38, 1e38], 1, 0.0, "", 1), (1, [1e-40, 0.0], 1, 0.0, "", 1), (2, [1e-3, 1.0], 1, 0.0, "", 1)]
    got = neighbours.op12(spark.createDataFrame(few, VECTORS)).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2)]


def byte_table():
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def aligned(docs):
    table, vocab, model = byte_table(), {i: s for s, i in brute.tokenizer().get_vocab().items()}, alignment.pieces_model()
    found, counts = [], Counter()
    for doc, text in docs:
        found.append((doc, None))
        if not text:
            continue
        a, b = brute.tokenizer().encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        bytes_a = [bytes(table[c] for c in vocab[i]) for i in a]
        names = [model.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(s[3:5], 16)]) if model.is_byte(i) else s.replace("▁", " ").encode() for i, s in zip(b, names)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            continue
        at_a, at_b = ([k for k, x in enumerate(side) for _ in x] for side in (bytes_a, bytes_b))
        links = sorted(set(zip(at_a, at_b)))
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups = [([], []) for _ in cuts]
        for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
            for i, g in zip(ids, np.searchsorted(cuts, ends)):
                groups[g][side].append(str(i))
        text_of = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(set(pairs))
        found[-1] = (doc, (len(a), len(b), len(cuts), pairs, hashlib.sha256(text_of.encode()).hexdigest()))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc, x in found:
        if x is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs, digest = x
            out.append((doc, n_a, n_b, groups, len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return out


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeäöüßéçñ中文🙂1234.,") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))) for k in range(60)]
    docs += [(100 + k, docs[4][1]) for k in range(30)]
    docs += [(200, None), (201, ""), (202, " "), (203, "  two  spaces \n\n\ttab"), (204, "<s> </s> <unk> <0x41> <|endoftext|> [INST]"), (205, "▁low▁line"), (206, "nul\x00byte"), (207, "é ﬁ ﷺ ​"), (BIG, "big id"), (None, "no id"), (None, "no id"), docs[3]]
    docs += [(300, " ".join(rng.choice(words) for _ in range(30_000))), (301, "x" * 50_000)]
    df = spark.createDataFrame([(d, t, "p", 7) for d, t in docs], "doc_id long, text string, pair string, rid int").repartition(4)
    assert columns(alignment.op13(df), *ALIGNED) == Counter(aligned(docs))
    assert alignment.op13(df.limit(0)).collect() == []


def test_runs_are_jumped_and_groups_close_where_both_end():
    rng = np.random.default_rng(7)
    for _ in range(300):
        end = int(rng.integers(1, 400))
        share = rng.random(3)
        both = rng.random(end) < share[0]
        a, b = (np.flatnonzero(both | (rng.random(end) < s)) + 1 for s in share[1:] * 0.5)
        a, b = (np.union1d(x, [end]) for x in (a, b))
        shut_a, shut_b, i, j = alignment.align(a, b)
        common = np.intersect1d(a, b)
        assert a[shut_a].tolist() == b[shut_b].tolist() == common.tolist()
        starts_a, starts_b = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
        overlap = (starts_a[:, None] < b) & (starts_b < a[:, None])
        assert sorted(zip(i.tolist(), j.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(overlap))))


def test_rare_pairs_go_the_other_way_round(spark, monkeypatch):
    docs = [(k, f"word{k} and the same") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = columns(alignment.op13(df), *ALIGNED)
    monkeypatch.setattr(alignment, "SHARE", 10)  # nearly all pairs are shuffled
    assert columns(alignment.op13(df), *ALIGNED) == want == Counter(aligned(docs))
