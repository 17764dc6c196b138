"""Benchmark decontamination by winnowing.

Words are runs of digits, ASCII letters (A-Z lower-cased) and all non-ASCII
code points.  Of every ``SPAN`` (8) consecutive words the smallest of the
``SPAN - K + 1`` hashes of K (4) words is kept, in documents and items alike, so
any shared span of 8 words shares a kept hash.  Document fingerprints are joined
with item fingerprints; each hit is extended to the left and right by comparing
the words themselves, and counts only if it covers a window: 8 consecutive item
words, or a whole item of fewer words (those are looked up by the hash of all
their words, at every position).

The benchmark is the stated query set: it is sent to the executors in blocks of
at most ``BLOCK_BYTES`` of text, documents stream past each block, nothing is
shuffled and nothing about documents reaches the driver.

Cases: a null or empty text has no words, no hits and no items; an item without
words never occurs; items are told apart by id, so repeated rows of one id count
once, and repeated documents each; ids of null are kept as rows (items with a null
id are named by the empty string); ties between equal hashes take the leftmost,
alike on both sides; names that are taken get underscores.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, free_name, materialize, mix, prefix_hash, settle, slices, span_hash, text_buffers, word_spans

SPAN, K = 8, 4
MIN_ITEMS = 2
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {i: i + 32 for i in range(65, 91)}
RESULT = "doc_id {id}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row offsets into the words)."""
    low = ALNUM_WORDS[raw]
    starts, ends, rows = word_spans(low != 0, offs)
    return span_hash(prefix_hash(low), starts, ends), rows


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (rows are told apart by the caller)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mix(out + np.uint64(k))


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost smallest hash of every ``window`` consecutive ones."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for d in range(1, window):
        less = g[d : d + n] < best
        best[less] = g[d : d + n][less]
        at[less] = np.flatnonzero(less) + d
    return np.unique(at)


class Benchmark:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.names, self.words, pairs = [], [], {}
        short: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for name, text in items:
            w = words_of(text)
            if not w:
                continue
            x = len(self.words)
            self.names.append("" if name is None else str(name))
            self.words.append(w)
            raw = np.frombuffer(text.encode(), np.uint8)
            h, _ = word_hashes(raw, np.array([0, len(raw)]))
            if len(w) < SPAN:
                short.setdefault(len(w), {}).setdefault(int(gram_hashes(h, len(w))[0]), []).append((x, 0))
            else:
                g = gram_hashes(h, K)
                for p in winnow(g, SPAN - K + 1).tolist():
                    pairs.setdefault(int(g[p]), []).append((x, p))
        self.tables = {0: pairs} | short
        self.keys = {n: np.sort(np.fromiter(t, np.uint64, len(t))) for n, t in self.tables.items()}

    def _hits(self, g: np.ndarray, n: int) -> np.ndarray:
        """Indexes of ``g`` whose hash an item has: the fingerprint join."""
        keys = self.keys[n]
        if not len(keys) or not len(g):
            return np.zeros(0, np.int64)
        at = np.searchsorted(keys, g)
        return np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == g)

    def scan(self, raw: np.ndarray, offs: np.ndarray):
        """(words of each row, {row: (spans, item indexes)}) of a slice of documents."""
        h, rows = word_hashes(raw, offs)
        g = gram_hashes(h, K)
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        # kept hashes of a slice: winnowing may look across rows, which only adds positions
        at = winnow(g, SPAN - K + 1)
        for n in self.tables:
            if n == 0:
                pos = at[self._hits(g[at], 0)]
                hashes = g[pos]
            else:
                gn = gram_hashes(h, n)
                pos = self._hits(gn, n)
                hashes = gn[pos]
            row = np.searchsorted(rows, pos, side="right") - 1
            for r, p, x in zip(row.tolist(), (pos - rows[row]).tolist(), hashes.tolist()):
                found.setdefault(r, []).append((n, p, x, 0))
        out = {}
        for r, hits in found.items():
            text = raw[offs[r] : offs[r + 1]].tobytes().decode()
            if (got := self._extend(words_of(text), hits))[1]:
                out[r] = got
        return np.diff(rows), out

    def _extend(self, doc: list[str], hits):
        """Hit word spans and items of one document: each hit grown word by word."""
        spans, items, done = set(), set(), {}
        for n, p, x, _ in hits:
            for item, q in self.tables[n][x]:
                reach = done.get((item, p - q), -1)
                if p < reach:  # inside a span that this alignment has grown already
                    continue
                w = self.words[item]
                a, b = 0, 0
                while a < p and a < q and doc[p - a - 1] == w[q - a - 1]:
                    a += 1
                while p + b < len(doc) and q + b < len(w) and doc[p + b] == w[q + b]:
                    b += 1
                if b == 0:  # equal hashes of other words
                    continue
                done[(item, p - q)] = p + b
                if a + b >= min(SPAN, len(w)):
                    spans.add((p - a, p + b))
                    items.add(item)
        return spans, items


def _merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks of items, each of bounded text, one at a time on the driver."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` and, behind its columns, ``hit_words`` long, ``hit_spans`` array<struct<start,end>> of word positions and ``hit_items`` array<string>.

    All columns of ``docs`` stay; one pass over the documents for each block of the benchmark.
    """
    settle(docs.sparkSession)
    base = docs.columns
    words, spans, items = (free_name(base, c) for c in ("hit_words", "hit_spans", "hit_items"))
    out = docs.select("*", F.lit(0).cast("long").alias(words), F.array().cast("array<struct<start:int,end:int>>").alias(spans), F.array().cast("array<string>").alias(items))
    blocks = list(_blocks(benchmark, item_col, item_text)) or [[]]
    at = base.index(text_col)
    for k, items in enumerate(blocks):
        if k:
            out = materialize(out, "hits")  # one block of items at a time in memory
        out = out.mapInArrow(_scanner(items, at), out.schema)
    return out


def _scanner(items, at):
    held: list[Benchmark] = []

    def run(batches):
        import pyarrow as pa

        if not held:
            held.append(Benchmark(items))
        bench = held[0]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            raw, offs = text_buffers(b.column(at))
            n_words, spans, names = [], b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for i, j in slices(offs):
                n, found = bench.scan(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n_words.append(n)
                for r, (s, x) in found.items():
                    old = [(v["start"], v["end"]) for v in spans[i + r]]
                    spans[i + r] = [{"start": a, "end": e} for a, e in _merge([*old, *s])]
                    names[i + r] = sorted({*names[i + r], *(bench.names[y] for y in x)})
            n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            cols = [*[b.column(c) for c in range(b.num_columns - 3)], pa.array(n_words.astype(np.int64)), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return run


def n_hit(spans="hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_items") >= MIN_ITEMS).alias("contaminated"),
    )


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
d AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w FROM dw),
bw AS (SELECT item_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark),
b AS (SELECT item_id, list_filter(w, lambda x: x <> '') AS w FROM bw),
bg AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[p:p + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, dg.n, item_id FROM dg JOIN bg USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""
