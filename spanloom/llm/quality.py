"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts are bags of hashed terms: words, byte n-grams (1 to 3, where punctuation
and case count) and a few shape terms (how often words and lines repeat, how
long words are, how much is capital or not a letter), all binned.  Labelled
texts give idf weights and, by a truncated SVD, a projection to ``RANK`` axes.
Labelled vectors are broadcast (``labelled.MAX_ROWS`` x RANK floats whatever
the data); each document takes exact cosine products with all of them, a block
of documents at a time, and its ``NEIGHBOURS`` nearest vote with their
similarity to the power of ``SHARPNESS`` as weight (negative ones count as none).

Cases: null and empty texts are a text without terms and take the share of
label 1; without labels the score is 0; equal texts score alike; ties between
neighbours go to the first labelled row in hash order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .common import ALNUM_WORDS, free_name, mix, prefix_hash, settle, slices, span_hash, text_buffers, word_spans

TERMS, RANK, NEIGHBOURS, SHARPNESS, SEED = 1 << 13, 48, 15, 4, 11
THRESHOLD, MOD, HELD_OUT = 0.3, 5, 0
SHAPES = 8 * 16  # ids behind the hashed terms


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return c[at[1:]] - c[at[:-1]]


def shape_terms(raw, offs, h, starts, ends, rows) -> np.ndarray:
    """(rows x 8) binned shape values of each text, 16 bins each."""
    n = len(offs) - 1
    size, n_words = np.diff(offs).astype(float), np.diff(rows).astype(float)
    row = np.repeat(np.arange(n), np.diff(rows))
    key = mix(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first, back, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    distinct = np.bincount(row[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row[first], counts)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[same], minlength=n)
    upper = _row_sums((raw >= 65) & (raw <= 90), offs)
    letters = np.maximum(1, _row_sums(ALNUM_WORDS[raw] != 0, offs))
    other = _row_sums((raw > 32) & (ALNUM_WORDS[raw] == 0), offs)
    lines = _row_sums(raw == 10, offs)
    w, s = np.maximum(n_words, 1), np.maximum(size, 1)
    values = np.stack([
        np.minimum(15, np.log2(1 + n_words)),
        15 * distinct / w,
        np.minimum(15, 60 * repeats / w),
        np.minimum(15, 30 * top / w),
        15 * upper / letters,
        np.minimum(15, 45 * other / s),
        np.minimum(15, _row_sums(ends - starts, rows) / w),
        np.minimum(15, 15 * lines / np.maximum(1, n_words / 4)),
    ], 1)
    return np.clip(values, 0, 15).astype(np.int64)


def term_counts(raw: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(term ids, row offsets) in several runs; shape terms come last, 8 a text."""
    low = ALNUM_WORDS[raw]
    starts, ends, rows = word_spans(low != 0, offs)
    h = span_hash(prefix_hash(low), starts, ends)
    mask, out = np.uint64(TERMS - 1), [((h & np.uint64(TERMS - 1)).astype(np.int64), rows)]
    n = len(raw)
    wide = raw.astype(np.uint64)
    row_end = np.repeat(offs[1:], np.diff(offs))
    for k in (1, 2, 3):
        g = wide[: max(0, n - k + 1)].copy()
        for d in range(1, k):
            g = (g << np.uint64(8)) | wide[d : n - k + 1 + d]
        i = np.flatnonzero(np.arange(len(g)) + k <= row_end[: len(g)])
        out.append(((mix(g[i] + np.uint64(k << 32)) & mask).astype(np.int64), np.searchsorted(i, offs)))
    shapes = shape_terms(raw, offs, h, starts, ends, rows) + TERMS + 16 * np.arange(8)
    out.append((shapes.ravel(), np.arange(len(offs)) * 8))
    return out


def bags(raw: np.ndarray, offs: np.ndarray):
    """Per text: (term ids, weights 1 + log(count)); shape terms weigh SHAPE_WEIGHT."""
    runs = term_counts(raw, offs)
    for r in range(len(offs) - 1):
        ids = np.concatenate([x[at[r] : at[r + 1]] for x, at in runs[:-1]])
        n = np.bincount(ids, minlength=TERMS)
        u = np.flatnonzero(n)
        shape = runs[-1][0][8 * r : 8 * r + 8]
        yield np.concatenate((u, shape)), np.concatenate((1 + np.log(n[u]), np.full(8, np.inf)))


class Model:
    SHAPE_WEIGHT = 0.25  # share of a text's length that each shape term has

    def __init__(self, idf, basis, vectors, labels, share):
        self.idf, self.basis, self.vectors, self.labels, self.share = idf, basis, vectors, labels, share

    @staticmethod
    def weighted(ids, w, idf):
        shape = np.isinf(w)
        v = np.where(shape, 0, w) * idf[ids]
        norm = np.sqrt((v * v).sum()) or 1.0
        return np.where(shape, Model.SHAPE_WEIGHT, v / norm).astype(np.float32)

    def project(self, raw, offs) -> np.ndarray:
        out = np.zeros((len(offs) - 1, self.basis.shape[1]), np.float32)
        for r, (ids, w) in enumerate(bags(raw, offs)):
            if offs[r + 1] > offs[r]:
                out[r] = self.weighted(ids, w, self.idf) @ self.basis[ids]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def scores(self, raw, offs, block: int = 512) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(offs) - 1, self.share)
        x, out, vectors = self.project(raw, offs), np.empty(len(offs) - 1), self.vectors.T.astype(np.float64)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x), block):
            # rounded, so that a text's place in a block doesn't show
            sim = np.round(x[i : i + block].astype(np.float64) @ vectors, 9)
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, near, 1), 0) ** SHARPNESS
            total = w.sum(1)
            out[i : i + block] = np.where(total > 0, (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1), self.share)
        return np.round(np.clip(out, 0, 1), 9)


def train(rows: list[tuple[str, int]], share: float = 0.0) -> Model:
    y = np.array([r[1] for r in rows], np.float64)
    size = TERMS + SHAPES
    if not len(y):
        return Model(np.ones(size, np.float32), np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), y, share)
    found = []
    for text, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        found.append(next(bags(raw, np.array([0, len(raw)]))))
    df = np.zeros(size)
    for ids, _ in found:
        df[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 1
    # randomized subspace iteration on the rows x terms matrix, a block of rows at a time
    rank = min(RANK, len(rows))
    weights = [Model.weighted(ids, w, idf) for ids, w in found]
    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.normal(size=(size, min(rank + 8, len(rows)))))[0].astype(np.float32)
    for _ in range(4):
        nxt = np.zeros((size, basis.shape[1]))
        for b in range(0, len(rows), 256):
            dense = np.zeros((min(256, len(rows) - b), size), np.float32)
            for r in range(len(dense)):
                dense[r, found[b + r][0]] = weights[b + r]
            nxt += dense.T @ (dense @ basis)
        basis, values, _ = np.linalg.svd(nxt, full_matrices=False)
        basis = basis.astype(np.float32)
    basis = np.ascontiguousarray(basis[:, :rank])
    vectors = np.stack([w @ basis[ids] for (ids, _), w in zip(found, weights)])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Model(idf, basis, vectors.astype(np.float32), y, share)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return train(*labelled.sample(docs, labels, label, MOD, HELD_OUT))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1) behind its own."""
    settle(docs.sparkSession)
    # MAX_ROWS x RANK and TERMS x RANK floats, whatever the data
    held = docs.sparkSession.sparkContext.broadcast((model.idf, model.basis, model.vectors, model.labels, model.share))
    at, out = docs.columns.index(text_col), free_name(docs.columns, name)

    def run(batches):
        import pyarrow as pa

        m = Model(*held.value)
        for b in batches:
            raw, offs = text_buffers(b.column(at))
            parts = [m.scores(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(out)).schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    out = with_scores(docs, model).drop("text")
    return out.select("doc_id", (labelled.remainder("doc_id", MOD) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
