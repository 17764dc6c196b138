"""Winnowing finds exactly the windows that a plain search finds."""

import hashlib
import re

import pytest

from spanloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, t in items:
            v = words(t)
            n = min(8, len(v))
            for q in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[q : q + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(names), digest, len(names) >= 2)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op1_decontamination(spark, sf_dir).collect()}
    assert got == brute(docs, items)
    assert any(x[4] for x in got.values()) and not all(x[4] for x in got.values())


@pytest.mark.parametrize("doc, item", [("a b c d e f g h", "a b c d e f g h"), ("a " * 40, "a " * 9), ("x a b c y", "b c"), ("b", "b"), ("é ß É", "é ß"), ("a b c d e f g", "a b c d e f g h")])
def test_short_and_repeated_words(doc, item):
    bench = decontam.Benchmark([(1, item)])
    import numpy as np

    raw = np.frombuffer(doc.encode(), np.uint8)
    n, found = bench.scan(raw, np.array([0, len(raw)]))
    want = brute([(0, doc)], [(1, item)])[0]
    spans = decontam._merge(found[0][0]) if 0 in found else []
    assert (int(n[0]), sum(b - a for a, b in spans), len(found[0][1]) if 0 in found else 0) == want[:3]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, item_id string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontam.find_hits(docs, none).first()
    assert row.hit_words == 2 and row.hit_items == [] and row.item_id == "x"
    assert decontam.find_hits(docs.limit(0), none).count() == 0
    assert decontam.find_hits(docs.withColumnRenamed("item_id", "hit_words"), none).columns == ["doc_id", "text", "hit_words", "hit_words_", "hit_spans", "hit_items"]


def test_blocks_of_the_benchmark_add_up(spark, sf_dir, monkeypatch):
    whole = {r.doc_id: r for r in decontam.op1_decontamination(spark, sf_dir).collect()}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    assert {r.doc_id: r for r in decontam.op1_decontamination(spark, sf_dir).collect()} == whole


def test_repeated_items_count_once_and_names_may_clash(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, hit_words int")
    items = spark.createDataFrame([(5, text), (5, text), (5, "w3 w4 w5")], "item_id long, text string")
    r = decontam.find_hits(docs, items).first()
    assert r.asDict() == {"doc_id": 1, "text": text, "hit_words": 7, "hit_words_": 20, "hit_spans": r.hit_spans, "hit_items": ["5"]}
