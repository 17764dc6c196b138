"""Near-duplicate classes equal those of all pairs compared."""

import random
import re

import numpy as np
import pytest

from spanloom.llm import neardup

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(docs)
    assert got(neardup.op6_near_duplicates(spark, sf_dir).collect()) == want
    assert sum(not k for _, _, k in want.values()) > 5


def chains(seed, n=90):
    """Copies of copies: neighbours are linked, ends are not."""
    rng = random.Random(seed)
    rows, w = [], prose(rng, 120).split()
    for k in range(n):
        if k % 30 == 0:
            w = prose(rng, rng.choice([60, 120, 200])).split()
        w = w.copy()
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append((rng.randrange(10**9), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_families(spark, seed):
    rows = chains(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(neardup.link_components(docs).collect()) == brute(rows)


def test_leaders_in_shares_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_PER_MEMBER", 0)
    rows = chains(5, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.link_components(docs).collect()) == brute(rows)


def test_many_pairs_of_random_overlap_around_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        w = prose(rng, 100).split()
        cut = rng.randint(4, 14)  # similarity from above to below 0.85
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[cut:] + ["tail"] * 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.link_components(docs).collect()) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e f g h " * 900), (None, "a b"), (8, "\x00 \x01 x y z w")]
    docs = spark.createDataFrame([(*r, r[0], "x") for r in rows], "doc_id long, text string, kept long, bands string")
    out = got(neardup.link_components(docs).collect())
    assert out[5] == (1, 4, False) and out[4] == (1, 4, True) and out[None] == (1, None, True)
    assert [out[k] for k in (1, 2, 3)] == [(0, k, True) for k in (1, 2, 3)]
    assert neardup.link_components(docs.limit(0)).count() == 0


def test_sketch_coordinates_all_fill_and_agree_like_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 400).astype(np.uint64)
    for share in (0.5, 0.85):
        k = int(len(a) * 2 * share / (1 + share))
        b = np.concatenate((a[:k], rng.integers(1, 2**63, len(a) - k).astype(np.uint64)))
        true = k / (2 * len(a) - k)
        both = np.concatenate((a, b))
        sk = neardup.sketches(both, np.array([0, len(a), len(both)]), 180)
        assert (sk != np.iinfo(np.uint64).max).all()
        assert abs((sk[0] == sk[1]).mean() - true) < 0.12
    one = neardup.sketches(a[:1], np.array([0, 1]), 180)
    assert (one != np.iinfo(np.uint64).max).all()


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        rows += [(10 * k + 1, thue_morse(n) + " one two three four"), (10 * k + 2, thue_morse(n, "b", "a") + " one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.link_components(docs).collect()) == brute(rows)


def test_long_texts_go_window_by_window(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 400), "x" * 900 + " y", "", "a b", " \n" * 300 + "tail" * 50, prose(rng, 3)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    whole = neardup.shingle_hashes(raw, offs, b"k")
    for size in (7, 64, 500):
        monkeypatch.setitem(neardup.word_keys.__globals__, "SLICE_BYTES", size)
        for x, y in zip(whole, neardup.shingle_hashes(raw, offs, b"k")):
            assert (x == y).all()
    assert np.diff(whole[1]).tolist() == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_bands_follow_the_threshold(percent):
    n = neardup.bands_for(percent)
    assert (1 - min(0.999999, (percent / 100) ** neardup.ROWS)) ** n <= neardup.MISS * 1.001


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    """Each round writes tables of a few numbers a row; their files don't follow the partitions of a shuffle."""
    from spanloom.llm import common

    seen = []
    real = common.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name, *a, **b: seen.append((name, len((out := real(df, name, *a, **b)).inputFiles()))) or out)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(80)] + [(100 + k, f"{k} {k} {k} {k} {k} x") for k in range(40)]
    try:
        for k, v in zip(held, ("40", "false")):
            spark.conf.set(k, v)
        out = got(neardup.link_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert out == brute(rows)
    small = [n for name, n in seen if name not in ("sketches", "sets")]
    assert len(small) >= 4 and max(small) <= spark.sparkContext.defaultParallelism
