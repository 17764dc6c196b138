"""Toxicity by averaged subword-bag embeddings and a linear softmax.

A text is the bag of its words and of their character n-grams (3 to 6 bytes,
with word ends marked), hashed into ``BUCKETS`` rows of an embedding table; the
mean of the rows goes through a linear softmax.  Table and softmax are trained
jointly in numpy (Adagrad, mini-batches), so a misspelling never seen before
shares most of its n-gram vectors with the words it comes from.

Since everything after the table is linear, a trained model folds into one
number per bucket: scoring a text is a mean over its n-grams.

Fitting uses a bounded sample (``labelled.sample``); scoring reads whole texts.

Cases: null and empty texts, and texts without words, score the model's prior;
without labels of both kinds the score is the share of label 1 (0 if there is
none); equal texts score alike.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .common import ALNUM_WORDS, free_name, prefix_hash, ragged, settle, slices, span_hash, text_buffers, word_spans

BUCKETS, DIM, GRAMS = 1 << 19, 6, (3, 4, 5, 6)
EPOCHS, BATCH, RATE, SEED, MIN_DF, MIN_STEPS, IDF_POWER = 12, 64, 2.0, 7, 3, 300, 2
THRESHOLD, MOD, HELD_OUT = 0.3, 4, 2
#: a bucket of a row's bag, as it is written
BAG = np.dtype([("id", np.int32), ("w", np.float32)])


def subwords(raw: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket ids, row offsets into them) for words and each n-gram length."""
    low = ALNUM_WORDS[raw]
    starts, ends, rows = word_spans(low != 0, offs)
    size = ends - starts
    if not len(size):
        return [(np.zeros(0, np.int64), np.zeros(len(offs), np.int64))]
    at = np.concatenate(([0], np.cumsum(size + 2)))
    marked = np.empty(at[-1], np.uint8)
    marked[at[:-1]], marked[at[1:] - 1] = 60, 62
    marked[ragged(at[:-1] + 1, size)] = low[ragged(starts, size)]
    c, rb = prefix_hash(marked), at[rows]
    mask = np.uint64(BUCKETS - 1)
    out = [((span_hash(c, at[:-1], at[1:]) & mask).astype(np.int64), rows)]
    for n in GRAMS:
        fit = size + 2 >= n
        i = ragged(at[:-1][fit], (size + 3 - n)[fit])
        out.append(((span_hash(c, i, i + n) & mask).astype(np.int64), np.searchsorted(i, rb)))
    return out


class Model:
    """Folded model: weight of each bucket, and the bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def scores(self, raw, offs) -> np.ndarray:
        total, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for ids, rows in subwords(raw, offs):
            s = np.concatenate(([0.0], np.cumsum(self.weight[ids], dtype=np.float64)))
            total += s[rows[1:]] - s[rows[:-1]]
            count += np.diff(rows)
        # rounded, so that a text's place in a slice doesn't show
        return np.round(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50))), 9)


def train(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """Joint training of embeddings and softmax on (text, label) rows.

    Buckets of fewer than MIN_DF rows stay zero; ``share`` is the share of
    label 1 that scores shall assume (default: that of the rows).
    """
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(BUCKETS), np.log(p / (1 - p)))
    with tempfile.TemporaryFile() as file:
        return _train(file, rows, y, share)


def _bags(file, rows: list[tuple[str, int]]) -> tuple[Callable[[int], tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Reader of each row's (bucket ids, shares), and the rows of each bucket.

    Bags are several times as large as their texts, so they stay in ``file`` and a mini-batch reads its own.
    """
    ends, df = [0], np.zeros(BUCKETS, np.int32)
    for text, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = np.concatenate([x for x, _ in subwords(raw, np.array([0, len(raw)]))])
        u, n = np.unique(ids, return_counts=True)
        bag = np.empty(len(u), BAG)
        bag["id"], bag["w"] = u, n / max(1, len(ids))
        df[u] += 1
        file.write(bag.tobytes())
        ends.append(ends[-1] + len(u))
    file.flush()

    def bag_of(i: int) -> tuple[np.ndarray, np.ndarray]:
        file.seek(ends[i] * BAG.itemsize)
        bag = np.frombuffer(file.read((ends[i + 1] - ends[i]) * BAG.itemsize), BAG)
        return np.ascontiguousarray(bag["id"]), np.ascontiguousarray(bag["w"])

    return bag_of, df


def _train(file, rows: list[tuple[str, int]], y: np.ndarray, share: float | None) -> Model:
    bag_of, df = _bags(file, rows)
    least = min(MIN_DF, max(1, len(rows) // 50))
    rare = (np.log(len(rows) / np.maximum(df, 1)) ** IDF_POWER).astype(np.float32)  # common subwords say little

    def weighed(i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, w = bag_of(i)
        k = df[ids] >= least
        return ids[k], w[k] * rare[ids[k]]

    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-2, np.float32)
    soft += rng.normal(0, 0.5, soft.shape).astype(np.float32)
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // len(rows)))  # small samples need as many steps
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            bags = {x: bag for x in order[k : k + BATCH] if len((bag := weighed(x))[0])}
            part = list(bags)
            if not part:
                continue
            ids, w = np.concatenate([bags[x][0] for x in part]), np.concatenate([bags[x][1] for x in part])
            at = np.concatenate(([0], np.cumsum([len(bags[x][0]) for x in part])))
            h = np.add.reduceat(emb[ids] * w[:, None], at[:-1])
            z = h @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1  # gradient of the loss
            back = p @ soft.T
            d_soft, d_bias = h.T @ p / len(part), p.mean(0)
            g_soft += d_soft**2
            g_bias += d_bias**2
            soft -= 0.2 * rate * d_soft / np.sqrt(g_soft)
            bias -= 0.2 * rate * d_bias / np.sqrt(g_bias)
            u, inv = np.unique(ids, return_inverse=True)
            grad = np.repeat(back, np.diff(at), axis=0) * w[:, None]
            g = np.stack([np.bincount(inv, grad[:, c], len(u)) for c in range(DIM)], 1).astype(np.float32)
            g_emb[u] += (g**2).sum(1)
            emb[u] -= rate * g / np.sqrt(g_emb[u])[:, None]
    diff = soft[:, 1] - soft[:, 0]
    emb[df < least] = 0
    odds = lambda p: np.log(p / (1 - p))
    shift = odds(min(max(share, 1e-6), 1 - 1e-6)) - odds(y.mean()) if share is not None else 0.0
    return Model((emb @ diff) * rare, bias[1] - bias[0] + shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    return train(*labelled.sample(docs, labels, label, MOD, HELD_OUT))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1) behind its own."""
    settle(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # BUCKETS floats, whatever the data
    at, out = docs.columns.index(text_col), free_name(docs.columns, name)

    def run(batches):
        import pyarrow as pa

        m = Model(*held.value)
        for b in batches:
            raw, offs = text_buffers(b.column(at))
            parts = [m.scores(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(out)).schema)


def verdict(score: Column | str) -> Column:
    return F.when((F.col(score) if isinstance(score, str) else score) >= THRESHOLD, 1).otherwise(0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = with_scores(docs, model).drop("text")
    return out.select("doc_id", (labelled.remainder("doc_id", MOD) == HELD_OUT).alias("held_out"), "score", verdict(F.col("score")).alias("predicted"))
