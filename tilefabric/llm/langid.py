"""Language identification with string kernels.

A text's spectrum is the set of its byte n-grams of 1 to 4 bytes (lower-cased,
white space runs as one space), each held by its bucket of ``BUCKETS``; the
kernel of two texts is the share of n-grams both have: |A and B| / sqrt(|A| |B|).
A bounded sample of labelled texts is the training set: ``PER_LANGUAGE`` of each
language, fewer where that is over ``SAMPLE`` texts, one of each language always
(an unbiased draw by the hash of id and text; rows that repeat both count once). ``LANDMARKS`` of them, or one of each language where
there are more languages, are Nystroem landmarks: K(x, landmarks) times the inverse square root of
K(landmarks, landmarks) gives features, on which one-versus-rest kernel ridge
regression is solved. The model is folded to one matrix over the landmarks, and
texts are scored by matrix products, batch by batch, over whole texts.

Defined cases: null text or text without a letter is ``und`` with score 0; no
labelled text at all: every prediction is ``und``; repeated rows score alike;
more than ``LANGUAGES`` languages are an error, as the driver solves for all of
them at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.tables import written

from .shared import small, with_own_id, with_text_id

#: Bounds of the training sample and the model; buckets of n-grams; ridge.
PER_LANGUAGE, SAMPLE, LANDMARKS, BUCKETS, RIDGE = 300, 19_200, 192, 1 << 16, 1e-2
#: Languages at most: a bitmap of 8 KB and a row and column of the kernel matrix each on the driver.
LANGUAGES = 2_000
FOLDS, BATCH = 5, 256
SPACE, LATIN = re.compile(rb"[\x20\x09-\x0D]+"), re.compile(rb"[A-Za-z]")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def spectrum(text: bytes, flags: np.ndarray) -> np.ndarray:
    """The buckets of the text's n-grams, ascending. ``flags``: BUCKETS zeros, handed back as zeros."""
    b = np.frombuffer(SPACE.sub(b" ", text.lower()), np.uint8).astype(np.uint32)
    flags[b] = True
    gram = b
    for n in range(1, min(4, len(b))):
        gram = (gram[:-1] << np.uint32(8)) | b[n:]
        flags[((gram + np.uint32(n)) * np.uint32(2_654_435_761)) >> np.uint32(16)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def has_letter(text: bytes) -> bool:
    return bool(LATIN.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # (landmarks, BUCKETS) presence / sqrt(size), only the buckets in use
    column: np.ndarray  # bucket -> column of landmarks, or -1
    weights: np.ndarray  # (landmarks, languages)

    def scores(self, spectra: list[np.ndarray]) -> np.ndarray:
        presence = np.zeros((len(spectra), self.landmarks.shape[1]), np.float32)
        for row, s in zip(presence, spectra, strict=True):
            at = self.column[s]
            row[at[at >= 0]] = 1.0
        size = np.sqrt(np.maximum(1, [len(s) for s in spectra]))[:, None]
        return (presence @ self.landmarks.T) / size @ self.weights


def fit(languages: list[str], labels: np.ndarray, spectra: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``labels``: index into ``languages`` of each spectrum; landmarks are spread evenly over the languages."""
    seen, turn = np.zeros(len(languages), np.int64), np.zeros(len(labels), np.int64)
    for i, x in enumerate(labels):
        turn[i], seen[x] = seen[x], seen[x] + 1
    chosen = np.argsort(turn, kind="stable")[: max(landmarks, len(languages))]
    used = np.unique(np.concatenate([spectra[i] for i in chosen]))
    column = np.full(BUCKETS, -1, np.int64)
    column[used] = np.arange(len(used))
    marks = np.zeros((len(chosen), len(used)), np.float32)
    for row, i in zip(marks, chosen, strict=True):
        row[column[spectra[i]]] = 1 / np.sqrt(max(1, len(spectra[i])))
    model = Model(languages, marks, column, np.eye(len(chosen)))
    k = np.concatenate([model.scores(spectra[a : a + BATCH]) for a in range(0, len(spectra), BATCH)])
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * values.max()
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    features = k @ nystroem
    goal = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / np.bincount(labels, minlength=len(languages))[labels]  # languages count alike
    left = (features * share[:, None]).T
    alpha = np.linalg.solve(left @ features + ridge * np.eye(features.shape[1]) / len(languages), left @ goal)
    model.weights = nystroem @ alpha
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Fits on documents whose fold is not 0; their spectra come to the driver as bitmaps of 8 KB each.

    The driver holds max(``sample``, languages) bitmaps and a row for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0) & F.col("text").isNotNull())
    spot = F.xxhash64("doc_id", "text", F.lit(4))
    counts = written(known.groupBy("lang").agg(F.approx_count_distinct(spot, 0.02).alias("_of"), F.min(spot).alias("_least")))  # a row for each language
    languages = counts.count()
    if not languages:
        return None
    if languages > LANGUAGES:
        raise ValueError(f"{languages} values of lang; at most {LANGUAGES} can be learnt")
    each = max(1, min(per_language, sample // languages))
    draw = (spot.cast("double") / 2.0**64 + 0.5) * F.col("_of")
    some = known.join(small(counts), "lang").withColumn("_draw", draw).where((F.col("_draw") < 2 * each + 50) | (spot == F.col("_least")))
    some = some.select("lang", "_draw", F.col("text").alias("_text")).groupBy("lang", "_draw").agg(F.min("_text").alias("text"))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_draw"))).where(F.col("_n") <= each)

    def run(batches):
        flags = np.zeros(BUCKETS, bool)
        for pdf in batches:
            maps = []
            for t in pdf["text"]:
                bits = np.zeros(BUCKETS, bool)
                bits[spectrum(t, flags)] = True
                maps.append(np.packbits(bits).tobytes())
            yield pd.DataFrame({"lang": pdf["lang"], "n": pdf["_n"], "bits": maps})

    rows = some.select("lang", "_n", F.col("text").cast("binary").alias("text")).mapInPandas(run, "lang string, n int, bits binary").collect()
    rows.sort(key=lambda r: (r["n"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    spectra = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))) for r in rows]
    number = {x: k for k, x in enumerate(languages)}
    return fit(languages, np.array([number[r["lang"]] for r in rows]), spectra)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; the score is the best margin, moved to 0..1."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, flags = shipped.value, np.zeros(BUCKETS, bool)
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                pred, score = np.full(len(part), "und", object), np.zeros(len(part))
                texts = part["text"].tolist()
                on = [i for i, t in enumerate(texts) if m and t is not None and has_letter(t)]
                if on:
                    s = m.scores([spectrum(texts[i], flags) for i in on])
                    pred[on] = np.array(m.languages, object)[s.argmax(axis=1)]
                    score[on] = np.clip((s.max(axis=1) + 1) / 2, 0, 1)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": pred, "score": score})

    rows = with_text_id(docs, F.col("text").cast("binary").alias("text"))
    return with_own_id(rows.mapInPandas(run, "doc_id string, lang_pred string, score double"), docs)


def op4(docs: DataFrame) -> DataFrame:
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
