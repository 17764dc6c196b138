"""The corpus pipeline: every stage on its own input, against plain computation."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import bpe, toxicity

from . import test_decontam, test_neardup, test_suffixdedup


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        texts = [(i, r.text) for i, r in before.items()]
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            for i, t in texts:
                raw = np.frombuffer((t or "").encode(), np.uint8)
                assert (i in after) == (model.scores(raw, np.array([0, len(raw)]))[0] < toxicity.THRESHOLD)
        elif name == "minhash_near_dedup":
            assert after.keys() == {i for i, x in test_neardup.brute(texts).items() if x[2]}
        elif name == "suffix_array_dedup":
            want = test_suffixdedup.brute(texts)
            assert after.keys() == before.keys()
            for i, r in after.items():
                if r.text is not None:
                    assert len(r.text.encode()) <= want[i][0] - want[i][1]
                    assert r.n_chars == len(r.text)
                    if r.text.isascii():
                        assert hashlib.sha256(r.text.encode()).hexdigest() == want[i][3] or not before[i].text.isascii()
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert after.keys() == {i for i, x in test_decontam.brute(texts, items).items() if not x[4]}
    library = Tokenizer.from_file(bpe.vocab_path())
    rows = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert rows == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_near_copies_from_80_percent_on_are_dropped(spark):
    words = [f"w{k}" for k in range(104)]  # 100 shingles
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    # 90 of 110 shingles (0.818) are shared with the first, then 85 of 115 (0.739)
    rows = [(1, " ".join(words)), (2, changed(30, 60)), (3, changed(20, 50, 80))]
    sets = {i: test_neardup.shingles(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= alike(1, 2) < 0.85 and alike(1, 3) < 0.8 and alike(2, 3) < 0.8
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_run_and_odd_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 20
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 3").withColumn("score", corpus_pipeline.F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2


def test_temporary_tables_start_no_process_for_each_file(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from spanloom.llm import suffixdedup
    from spanloom.llm.common import drop, materialize

    out = materialize(spark.range(0, 100, 1, 4), "plain")
    folder = Path(urlparse(out._written_to).path)
    blocks = suffixdedup._bucketed(spark.range(0, 100, 1, 4).withColumnRenamed("id", "block"), 3)
    files = [Path(urlparse(f).path) for f in blocks.inputFiles()]
    assert out.count() == blocks.count() == 100 and len(list(folder.glob("*.parquet"))) == 4 and files
    # a .crc is written only by the file system that starts chmod for it and for its file
    assert not [*folder.glob(".*.crc"), *(x for f in files for x in f.parent.glob(".*.crc"))]
    drop(out)
    assert not folder.exists()
