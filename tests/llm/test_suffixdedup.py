"""Bytes removed equal those of a search through every window."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import suffixdedup

from .conftest import prose


def brute(rows, n=50):
    first: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - n + 1):
            first.setdefault(data[i][p : p + n], i)
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.op4_suffix_dedup(spark, sf_dir).collect()} == want
    assert sum(x[1] > 0 for x in want.values()) > 8


@pytest.mark.parametrize("seed", range(2))
def test_windows_of_hot_grams_meet_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(suffixdedup, "HOT", 5)
    rng = random.Random(seed)
    line = prose(rng, 14)
    rows = [(rng.randrange(10**6), f"{prose(rng, rng.randint(1, 20))} {line} {prose(rng, 9)}") for _ in range(40)] + [(k, line * 2) for k in (7, 8, 9)]
    docs = spark.createDataFrame(list(dict(rows).items()), "doc_id long, text string").repartition(3)
    assert got(suffixdedup.dedup_spans(docs)) == brute(list(dict(rows).items()))


@pytest.mark.parametrize("segment", [64, 200, 1000])
def test_long_texts_go_segment_by_segment(monkeypatch, segment):
    rng = random.Random(8)
    texts = [prose(rng, 300).encode(), b"", b"a" * 49, b"ab" * 400, prose(rng, 9).encode()]
    raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))

    def windows():
        gram, row, j0, n = suffixdedup.minimizers(raw, offs)
        return sorted((int(r), int(p), int(g)) for g, r, j, k in zip(gram, row, j0, n) for p in range(j, j + k))

    want = windows()
    assert len(want) == sum(max(0, len(t) - 49) for t in texts)
    monkeypatch.setattr(suffixdedup, "SEGMENT", segment)
    assert windows() == want


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_repeats_and_small_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 700)
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(8, 60)) for _ in range(6)] + ["ab" * 60, "é" * 60, "x" * 200, "x" * 49 + "y"]
    rows = [(rng.randrange(10**6), " ".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng, 12) for _ in range(rng.randint(1, 7)))) for _ in range(50)]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(suffixdedup.dedup_spans(docs)) == brute(rows)


def test_odd_rows_and_clashing_columns(spark):
    t = prose(random.Random(4), 30)
    rows = [(3, t, 1), (None, t, 2), (5, None, 3), (6, "", 4), (7, t[:49], 5), (8, t, 6), (8, t, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    out = {r.n_bytes: (r.n_bytes_, r.n_removed, len(r.kept)) for r in suffixdedup.dedup_spans(docs, as_text=True).collect()}
    n = len(t)
    assert out == {1: (n, 0, n), 2: (n, 0, n), 3: (0, 0, 0), 4: (0, 0, 0), 5: (49, 0, 49), 6: (n, n, 0), 7: (n, n, 0)}
    assert suffixdedup.dedup_spans(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=60), min_size=1, max_size=6), st.integers(2, 12))
def test_prefix_classes_by_backward_extension(parts, length):
    text = np.frombuffer("\x7f".join(parts).encode() + b"\xff", np.uint8)
    sa, boundary = suffixdedup.prefix_classes(text, length)
    data = text.tobytes()
    keys = [data[i : i + length] for i in sa]
    for k in range(1, len(keys)):
        a, b = keys[k - 1], keys[k]
        if len(a) == len(b) == length:
            assert bool(boundary[k]) == (a != b)


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    seen = []
    real = suffixdedup.materialize
    monkeypatch.setattr(suffixdedup, "materialize", lambda df, name, *a, **b: seen.append((name, (out := real(df, name, *a, **b)).inputFiles())) or out)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false")):
            spark.conf.set(k, v)
        rows = [(i, f"text of its own {i % 60} and nothing else " * 3) for i in range(120)]
        out = suffixdedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(20))
        assert out.where("n_bytes = n_removed").count() >= 60
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = dict(seen)
    assert 0 < len(files["firsts"]) <= spark.sparkContext.defaultParallelism and len(files["copies"]) <= spark.sparkContext.defaultParallelism
