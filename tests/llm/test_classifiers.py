"""Classifiers: held-out accuracy, hold-outs never read, odd tables."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from spanloom.llm import labelled, quality, toxicity
from spanloom.llm.common import prefix_hash, span_hash

from .conftest import prose

INSULTS = ["stupid", "idiot", "moron", "scum", "filthy", "loser"]


def toxic_rows(n, seed=1, slur=lambda rng: rng.choice(INSULTS)):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = prose(rng, 30).split()
        if k % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), slur(rng))
        out.append((" ".join(w), int(k % 3 == 0)))
    return out


def score(model, texts):
    data = [t.encode() for t in texts]
    return model.scores(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))


def test_toxicity_generalizes_to_misspellings():
    model = toxicity.train(toxic_rows(600))
    bent = {"stupid": "stupidd", "idiot": "idiiot", "moron": "moronn", "scum": "scumm", "filthy": "filthyy", "loser": "loserr"}
    test = toxic_rows(150, 2, lambda rng: bent[rng.choice(INSULTS)])
    hit = (score(model, [t for t, _ in test]) >= toxicity.THRESHOLD) == np.array([y for _, y in test], bool)
    assert hit.mean() > 0.93
    assert 0 <= score(model, [""])[0] <= 1


def test_quality_separates_prose_from_junk():
    rng = random.Random(3)
    rows = [(prose(rng, 60), 1) if k % 2 else (" ".join([rng.choice(["BUY", "NOW!!!", "click", "$$$", "free"])] * 30), 0) for k in range(300)]
    model = quality.train(rows[:200], 0.5)
    s = score(model, [t for t, _ in rows[200:]])
    assert ((s >= quality.THRESHOLD) == np.array([y for _, y in rows[200:]], bool)).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_or_one_kind(module):
    assert 0 <= score(module.train([]), ["a b", ""])[0] <= 0.01
    assert score(module.train([("a b c", 1), ("d e f", 1)]), ["a b"])[0] > 0.5


@pytest.mark.parametrize("query, mod, out", [(toxicity.op5_toxicity, 4, 2), (quality.op9_quality, 5, 0)])
def test_queries(spark, sf_dir, query, mod, out):
    rows = query(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    text = {r.doc_id: r.text for r in docs}
    seen = {}
    for r in rows:
        assert seen.setdefault(text[r.doc_id], r.score) == r.score


def test_sample_never_holds_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (5, None), (999, 1), (7, 0)], "doc_id long, toxic int")
    rows, share = labelled.sample(docs, labels, "toxic", 4, 2, max_rows=60)
    ids = [int(t.split()[1]) for t, _ in rows]
    assert 0 < len(rows) <= 60 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    assert all(y == i % 2 for i, (_, y) in zip(ids, rows)) and 0.4 < share < 0.6
    small, _ = labelled.sample(docs, labels, "toxic", 4, 2, max_bytes=50)
    assert sum(len(t) for t, _ in small) <= 50


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "x", 0.1)], "doc_id long, text string, score double")
    for module in (toxicity, quality):
        model = module.fit(docs, spark.createDataFrame([], "doc_id long, toxic int, quality int"))
        out = module.with_scores(docs, model)
        assert out.columns == ["doc_id", "text", "score", "score_"] and out.count() == 2
        assert module.with_scores(docs.limit(0), model).count() == 0


def test_toxicity_query_equals_plain_averages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))

    def bucket(b):
        raw = np.frombuffer(b, np.uint8)
        return int(span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0]) % toxicity.BUCKETS

    def plain(text):
        found = []
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            m = b"<" + w.encode() + b">"
            found += [m] + [m[i : i + n] for n in toxicity.GRAMS for i in range(len(m) - n + 1)]
        mean = sum(float(model.weight[bucket(b)]) for b in found) / max(1, len(found))
        return 1 / (1 + math.exp(-(mean + model.bias)))

    got = {r.doc_id: r.score for r in toxicity.op5_toxicity(spark, sf_dir).collect()}
    for r in docs.collect():
        if len(r.text or "") < 900:
            assert abs(got[r.doc_id] - plain(r.text)) < 1e-6, r


def test_quality_query_equals_sorting_all_cosines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality.op9_quality(spark, sf_dir).collect()}
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        x = model.project(raw, np.array([0, len(raw)]))[0]
        sims = sorted(((round(float(np.dot(x.astype(float), v.astype(float))), 9), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
        if len(sims) > quality.NEIGHBOURS and sims[quality.NEIGHBOURS - 1][0] - sims[quality.NEIGHBOURS][0] < 1e-6:
            continue  # neighbours that tie at the end of the list
        near = [(max(s, 0) ** quality.SHARPNESS, y) for s, y in sims[: quality.NEIGHBOURS]]
        total = sum(w for w, _ in near)
        assert abs(got[r.doc_id] - (sum(w * y for w, y in near) / total if total else model.share)) < 1e-6, r


def test_training_holds_no_bags_of_all_rows(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "MIN_STEPS", 1)
    monkeypatch.setattr(toxicity, "BATCH", 4)
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(20_000)]
    rows = [(" ".join(words[x] for x in rng.integers(0, len(words), 1250)), i % 2) for i in range(400)]
    tracemalloc.start()
    toxicity.train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # the bags are over 100 MB
