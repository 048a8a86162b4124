"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages: consecutive windows of ``PASSAGE`` bytes that
cover its whole text. A passage is encoded by how often each pair of neighbouring
character classes occurs in it, through a learned tanh layer. Learned gated
attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages; the
weighted mean is scored by a logistic layer. Labels belong to documents; which
passages matter is learned. Training (numpy, Adam, fixed seed) uses a bounded
sample of labelled rows, each with every passage: ``SAMPLE`` rows, those of the
smallest hashes (rows that repeat a doc_id are each one), or fewer where they
would hold more than ``SAMPLED`` passages. Passages are kept as their
features other than zero and made dense ``DENSE`` at a time. Scoring uses every
passage too.

Defined cases: null and empty text is a bag of one empty passage and is scored
too; without both labels to learn from, every score is the share of label 1 (1
if there are no labels); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .shared import portions, unused

PASSAGE, SAMPLE, HIDDEN, GATE = 512, 2_000, 24, 12
EPOCHS, BAGS, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 5
THRESHOLD = 0.3
#: Passages of the whole training sample (one document's at least), and of those that are dense at once.
SAMPLED, DENSE = 200_000, 1_024
#: Bytes of text that are scored at a time.
BYTES = 1 << 20
#: Character classes: one each for these bytes, then groups.
SINGLES = b" \n.,!?;:|#%&$*\"'-_/()<>{}[]@=+~^\\"
GROUPS = (b"eationsrhldu", b"bcfgjkmpqvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\t\r\x0b\x0c")
CLASSES = len(SINGLES) + len(GROUPS) + 2
CLASS_OF = np.full(256, CLASSES - 1, np.int64)  # the last: bytes of characters beyond ASCII; before it: other control bytes
CLASS_OF[:128] = CLASSES - 2
for _k, _group in enumerate([*(SINGLES[i : i + 1] for i in range(len(SINGLES))), *GROUPS]):
    CLASS_OF[list(_group)] = _k
FEATURES = CLASSES * CLASSES + 4
POWERS = np.random.default_rng(9).integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bags(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, FEATURES) and the number of passages of each text; ``data``: the texts' bytes, one after another."""
    many = np.maximum(1, -(-lengths // PASSAGE))
    total = int(many.sum())
    starts = np.repeat(np.cumsum(lengths) - lengths, many)
    begin = starts + PASSAGE * (np.arange(total) - np.repeat(np.cumsum(many) - many, many))
    size = np.minimum(PASSAGE, np.repeat(lengths, many) - (begin - starts))
    of = np.repeat(np.arange(total), size)
    c = CLASS_OF[data]
    pair = of[:-1] == of[1:]
    pairs = CLASSES * CLASSES
    x = np.bincount((of[:-1] * pairs + c[:-1] * CLASSES + c[1:])[pair], minlength=total * pairs).reshape(total, -1)
    x = np.sqrt(x / np.maximum(1, size - 1)[:, None])
    return np.concatenate([x, size[:, None] / PASSAGE, repeats(data, of, total)], axis=1, dtype=np.float32), many


def repeats(data: np.ndarray, of: np.ndarray, total: int) -> np.ndarray:
    """(passages, 3): the share of words that repeat the one before, that are new in the passage, and words by bytes."""
    black = (data > 32) | ((data < 9) | (data > 13)) & (data < 32)
    starts = np.flatnonzero(black & np.concatenate([[True], ~black[:-1] | (of[1:] != of[:-1])])) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros((total, 3))
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    word = np.add.reduceat(np.where(black, data.astype(np.uint64) * POWERS[place % 64], np.uint64(0)), starts)
    where = of[starts]
    words = np.bincount(where, minlength=total)
    again = np.bincount(where[1:][(word[1:] == word[:-1]) & (where[1:] == where[:-1])], minlength=total)
    order = np.lexsort((word, where))
    w, o = word[order], where[order]
    new = np.bincount(o[np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])], minlength=total)
    return np.stack([again / np.maximum(1, words), new / np.maximum(1, words), 8 * words / PASSAGE], axis=1)


@dataclass
class Model:
    e: np.ndarray  # (FEATURES, HIDDEN) encoder, its bias b
    b: np.ndarray
    v: np.ndarray  # (HIDDEN, GATE)
    u: np.ndarray
    w: np.ndarray  # (GATE,)
    c: np.ndarray  # (HIDDEN,) and bias d
    d: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.e + self.b)

    def forward(self, h: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
        """From the encoded passages ``h`` of bags of ``many`` passages to the bags' scores ``y``."""
        first, bag = np.cumsum(many) - many, np.repeat(np.arange(len(many)), many)
        p, q = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        a = (p * q) @ self.w
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"bag": bag, "first": first, "p": p, "q": q, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))}


def encoded(m: Model, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages and their number in each text; one long text goes piece by piece, as its features are many times its size."""
    if len(lengths) > 1 or len(data) <= BYTES:
        x, many = bags(data, lengths)
        return m.encode(x), many
    cuts = [data[a : a + BYTES] for a in range(0, len(data), BYTES)]  # BYTES is a multiple of PASSAGE
    return np.concatenate([m.encode(bags(c, np.array([len(c)]))[0]) for c in cuts]), np.array([-(-len(data) // PASSAGE)])


@dataclass
class Sparse:
    """Rows of FEATURES steps of 1/255, held as the places and values of those other than zero."""

    ends: np.ndarray  # of each row, in place and value
    place: np.ndarray
    value: np.ndarray

    def __getitem__(self, rows: slice) -> np.ndarray:
        a, b = rows.start, rows.stop
        begin = self.ends[a - 1] if a else 0
        counts = np.diff(self.ends[a:b], prepend=begin)
        out = np.zeros((b - a, FEATURES), np.uint8)
        out[np.repeat(np.arange(b - a), counts), self.place[begin : self.ends[b - 1]]] = self.value[begin : self.ends[b - 1]]
        return out


def fit(x: np.ndarray | Sparse, many: np.ndarray, y: np.ndarray) -> Model:
    """Gradient descent on the log loss of the documents' labels; ``x`` is in steps of 1/255."""
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: rng.normal(size=shape, scale=1 / np.sqrt(shape[0])).astype(np.float64)
    m = Model(3 * draw(FEATURES, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1))
    names, first = list(vars(m)), np.cumsum(many) - many
    mean, rms, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-3
        for at in range(0, len(order), BAGS):
            some = order[at : at + BAGS]
            spans = [(a, min(a + DENSE, first[i] + many[i])) for i in some for a in range(first[i], first[i] + many[i], DENSE)]
            cuts = list(portions(np.array([b - a for a, b in spans]), DENSE))
            dense = lambda s, t: np.concatenate([x[a:b] for a, b in spans[s:t]]) / 255  # noqa: B023, E731
            once = [dense(*c) for c in cuts] if len(cuts) == 1 else None
            h = np.concatenate([m.encode(xs) for xs in once or (dense(*c) for c in cuts)])
            f = m.forward(h, many[some])
            bag, p, q, a = (f[k] for k in ("bag", "p", "q", "a"))
            dy = (f["y"] - y[some]) / len(some)
            dz = dy[:, None] * m.c
            da = (h * dz[bag]).sum(axis=1)
            ds = a * (da - np.add.reduceat(a * da, f["first"])[bag])
            dp, dq = ds[:, None] * m.w * q * (1 - p * p), ds[:, None] * m.w * p * q * (1 - q)
            dh = (a[:, None] * dz[bag] + dp @ m.v.T + dq @ m.u.T) * (1 - h * h)
            ge, at_h = np.zeros_like(m.e), 0
            for xs in once or (dense(*c) for c in cuts):
                ge += xs.T @ dh[at_h : at_h + len(xs)]
                at_h += len(xs)
            grad = {"e": ge, "b": dh.sum(axis=0), "v": h.T @ dp, "u": h.T @ dq, "w": (p * q).T @ ds, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}
            step += 1
            for k in names:
                g = grad[k] + DECAY * getattr(m, k)
                mean[k], rms[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * rms[k] + 0.001 * g * g
                setattr(m, k, getattr(m, k) - rate * mean[k] / (1 - 0.9**step) / (np.sqrt(rms[k] / (1 - 0.999**step)) + 1e-8))
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """Fits on a sample of the labelled documents whose fold is not 0; of a single label, its value is all there is to learn."""
    marks = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_y"))
    n = marks.count()
    chosen = marks.where((F.xxhash64("doc_id", F.lit(5)).cast("double") / 2.0**64 + 0.5) * n < 1.05 * sample).orderBy(F.xxhash64("doc_id", F.lit(5))).limit(sample)
    text = F.coalesce("text", F.lit("")).cast("binary")

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                raw = np.frombuffer(b["text"][row].as_buffer(), np.uint8)
                counts, places, values = [], [], []
                for a in range(0, max(1, len(raw)), DENSE * PASSAGE):
                    piece = raw[a : a + DENSE * PASSAGE]
                    x = np.rint(255 * np.clip(bags(piece, np.array([len(piece)]))[0], 0, 1)).astype(np.uint8)
                    of, place = np.nonzero(x)
                    counts.append(np.bincount(of, minlength=len(x)).astype("<u2"))
                    places.append(place.astype("<u2"))
                    values.append(x[of, place])
                held = {"counts": counts, "places": places, "values": values}
                sparse = {k: pa.array([np.concatenate(v).tobytes()], pa.binary()) for k, v in held.items()}
                yield pa.RecordBatch.from_pydict({"h": b["h"].slice(row, 1), "y": b["_y"].slice(row, 1), "many": pa.array([sum(map(len, counts))], pa.int64()), **sparse})

    # Rows that repeat a doc_id are each a bag; the sample's few ids are broadcast, the texts are not moved.
    picked = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    picked = picked.select(F.xxhash64("doc_id", "text").alias("h"), "_y", "text")
    # The bound on passages is applied to lengths, a row for each distinct bag; only texts within it get features.
    many = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).cast("long")
    bags_of = picked.groupBy("h", "_y").agg(F.count("*").alias("times"), F.min(many).alias("many")).orderBy("h", "_y").limit(sample)
    taken, before, left = {}, 0, sample
    for r in bags_of.collect() if n else ():
        for _ in range(min(r["times"], left)):
            if before + min(r["many"], SAMPLED) <= SAMPLED:
                taken[r["h"], r["_y"]] = taken.get((r["h"], r["_y"]), 0) + 1
            before, left = before + r["many"], left - 1
    rows = []
    if taken:
        wanted = F.broadcast(docs.sparkSession.createDataFrame(list(taken), "h long, _y int"))
        once = picked.join(wanted, ["h", "_y"]).groupBy("h", "_y").agg(F.first("text").alias("text"))
        found = once.mapInArrow(run, "h long, y int, many long, counts binary, places binary, values binary").collect()
        rows = [r for r in sorted(found, key=lambda r: (r["h"], r["y"])) for _ in range(taken[r["h"], r["y"]])]
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 1.0
    joined = lambda k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind)
    x = Sparse(np.cumsum(joined("counts", "<u2"), dtype=np.int64), joined("places", "<u2"), joined("values", np.uint8))
    return fit(x, np.array([r["many"] for r in rows]), y)


def scored(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """``docs`` with the score of every document as column ``name``; only the texts go through Python."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        if isinstance(m, Model):
            m = Model(**{k: v.astype(np.float32) for k, v in vars(m).items()})
        for t in texts:
            lengths, out = np.asarray(pc.binary_length(t)).astype(np.int64), np.full(len(t), 0.0 if isinstance(m, Model) else m)
            for at, to in portions(lengths, BYTES) if isinstance(m, Model) else ():
                raw = np.frombuffer(b"".join(t.slice(at, to - at).to_pylist()), np.uint8)
                out[at:to] = m.forward(*encoded(m, raw, lengths[at:to]))["y"]
            yield pa.array(out)

    return docs.withColumn(name, score(F.coalesce("text", F.lit("")).cast("binary")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier, trained on ``labels``, does not reject."""
    (name,) = unused(docs, "_own_score")
    return scored(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
