"""Token ids equal the tokenizers library's, in memory and read back from files."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import bpe, tokenfile

PATH = bpe.vocab_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_query_equals_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = ids_of(library, text)
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ODD = st.text(st.sampled_from(list("ab Z9'’.,-\n\t\r é漢 　\U0001f600<|endoftext|>stdmlverl")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6))
def test_chunk_encoder_equals_library(texts):
    enc, lib = bpe.held(bpe.ChunkEncoder, PATH), bpe.held(bpe.Encoder, PATH).tok
    data = [t.encode() for t in texts]
    raw, offs = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, at = enc.encode(raw, offs)
    for k, t in enumerate(texts):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert enc.enc.decode(ids[at[k] : at[k + 1]]) == lib.decode(want, skip_special_tokens=False).encode()


def test_chunks_are_reused_and_joins_repaired(library):
    rng = random.Random(2)
    passage = " ".join(rng.choice(["alpha", "beta,", "gamma's", "delta\n", "42"]) for _ in range(3000))
    texts = [passage, "x " + passage, passage + passage]
    enc = bpe.ChunkEncoder(PATH)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, _ = enc.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == ids_of(library, t)
    assert enc.reused > enc.seen / 2


def test_memo_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_MEMO_IDS", 10)
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    enc = bpe.ChunkEncoder(PATH)
    for t in ["the quick brown fox " * 50, "a lazy dog's day " * 30] * 2:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert enc.encode(raw, np.array([0, len(raw)]))[0].tolist() == ids_of(library, t)


def test_token_file_round_trip(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = tokenfile.op2_token_file(spark, sf_dir).orderBy("doc_id").collect()
    assert len(got) == len(docs)
    start = 0
    for d, g in zip(docs, got):
        ids = [*ids_of(library, d.text), 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_one_document_is_read_by_its_frame(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards, dictionary = tokenfile.write_token_file(docs.unionByName(docs.where("doc_id = 205")))
    text = docs.where("doc_id = 205").first().text
    assert tokenfile.read_document(shards, dictionary, 205) == [[*ids_of(library, text), 0]] * 2
    assert tokenfile.read_document(shards, dictionary, -5) == []


def test_token_file_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read_token_file(*tokenfile.write_token_file(empty)).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "x", 3)], "doc_id long, text string, start int")
    rows = tokenfile.read_token_file(*tokenfile.write_token_file(odd)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 1), (2, 1), (2, 2)]
    assert sorted(r.start for r in rows) == [0, 1, 2]


def test_damaged_dictionary_is_refused(spark):
    bad = spark.createDataFrame([("00", bytearray(b"x"))], "dict_hash string, bytes binary")
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.dictionary_bytes(bad)


def test_clashing_columns_and_ids(spark):
    docs = spark.createDataFrame([(1, "hi there", 5)], "doc_id long, text string, n_tokens long")
    row = bpe.encode_documents(docs, with_ids=True).first()
    assert row.decoded == "hi there" and row.n_tokens == len(row.ids)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomial_hashes_confuse_get_their_own_ids(library, n):
    one = "".join("b" if bin(k).count("1") % 2 else "a" for k in range(n))
    texts = [one, one.translate({97: 98, 98: 97}), one + " x", one.translate({97: 98, 98: 97}) + " x"]
    raw, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for enc in (bpe.Encoder(PATH), bpe.ChunkEncoder(PATH)):
        ids, at = enc.encode(raw, offs)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(library, t) for t in texts]


def test_kept_columns_stand_beside_the_ids(spark, library):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang, r.n_tokens, r.ids) for r in bpe.encode_documents(docs, keep=("lang",), with_ids=True).collect()}
    assert out == {1: ("x", 2, ids_of(library, "a b")), 2: (None, 0, [])}
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode_documents(docs.withColumn("n_tokens", docs.doc_id), keep=("n_tokens",))
