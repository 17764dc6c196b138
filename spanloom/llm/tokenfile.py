"""Token-id files: zstandard with a shared dictionary, one frame per document.

A token file is a table of shards in the shared store, written by Spark's own
committer (a lost task is written again, half-written files are never seen):

* ``dictionary``: hash and bytes of one zstandard dictionary, trained on a
  bounded sample of serialized id arrays (``DICT_DOCS`` documents at most,
  documented; the dictionary changes sizes only, never what is read back).
* ``shards``: ``part, seq, dict_hash, payload``, the offset index
  (``doc_ids, starts, offsets``: document, ids before it in its part, where its
  frame begins) and ``n_tokens``.  One document is read by decompressing one
  frame: see ``read_document``.

Documents stand in ascending id order (nulls first, ties by hash of the text);
a part is a range of ids, and ``part_tokens`` gives each part's total, from
which a document's global start follows.  Ids are unsigned 16-bit while the
vocabulary allows it, else 32-bit.

Cases: a null or empty text has only the end id; an empty table gives no
shards; repeated ids are separate documents.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, held, vocab_path
from .common import materialize, settle, slices, text_buffers

DICT_BYTES, DICT_DOCS, DICT_IDS = 32 << 10, 1000, 512
SHARD_BYTES = 4 << 20
END_ID = 0
SHARD_SCHEMA = "part int, seq int, dict_hash string, width int, payload binary, doc_ids array<long>, starts array<long>, offsets array<long>, n_tokens array<long>"


def _width(n_vocab: int) -> int:
    return 2 if n_vocab <= 1 << 16 else 4


def _ids_of(column, path):
    """Rows' id arrays, each with the end id, of a string column."""
    enc = held(Encoder, path)
    raw, offs = text_buffers(column)
    for i, j in slices(offs, 4 << 20):
        ids, io = enc.encode(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for r in range(j - i):
            yield np.append(ids[io[r] : io[r + 1]], np.uint32(END_ID))


def train_dictionary(docs: DataFrame, path: str, width: int, text_col: str = "text") -> bytes:
    """Dictionary from the first ids of at most DICT_DOCS documents, by hash order of a thin sample."""
    import pyarrow as pa
    import zstandard as zstd

    dtype = f"<u{width}"

    def heads(batches):
        import pyarrow.compute as pc

        for b in batches:
            out = [x[:DICT_IDS].astype(dtype).tobytes() for x in _ids_of(pc.utf8_slice_codeunits(b.column(0), 0, 4 * DICT_IDS), path)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    n = docs.count()
    picked = docs.select(text_col).where(F.col(text_col).isNotNull())
    if n > 2 * DICT_DOCS:
        picked = picked.where(F.abs(F.xxhash64(text_col)) % F.lit(n) < F.lit(2 * DICT_DOCS))
    sample = [bytes(r.ids) for r in picked.orderBy(F.xxhash64(text_col), text_col).limit(DICT_DOCS).repartition(8).mapInArrow(heads, "ids binary").collect()]
    try:
        return zstd.train_dictionary(DICT_BYTES, sample, k=256, d=8).as_bytes()
    except zstd.ZstdError:  # too few or too small samples: a raw-content dictionary
        return b"".join(sample)[:DICT_BYTES]


def write_token_file(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary) tables of a new token file."""
    spark, path = docs.sparkSession, vocab or vocab_path()
    settle(spark)
    from tokenizers import Tokenizer

    width = _width(Tokenizer.from_file(path).get_vocab_size())
    words = train_dictionary(docs, path, width, text_col)
    digest = hashlib.sha256(words).hexdigest()
    dictionary = materialize(spark.createDataFrame([(digest, bytearray(words))], "dict_hash string, bytes binary").coalesce(1), "token-dictionary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        import zstandard as zstd
        from pyspark import TaskContext

        part, seq, total = TaskContext.get().partitionId(), 0, 0
        comp = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(words) if words else None, write_content_size=True)
        frames, ids, starts, offsets, counts, size = [], [], [], [0], [], 0

        def shard():
            row = [[part], [seq], [digest], [width], [b"".join(frames)], [ids], [starts], [offsets], [counts]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), _ids_of(b.column(1), path)):
                f = comp.compress(x.astype(f"<u{width}").tobytes())
                frames.append(f)
                ids.append(doc_id)
                starts.append(total)
                counts.append(len(x))
                total, size = total + len(x), size + len(f)
                offsets.append(size)
                if size >= SHARD_BYTES:
                    yield shard()
                    frames, ids, starts, offsets, counts, size, seq = [], [], [], [0], [], 0, seq + 1
        if ids:
            yield shard()

    shards = materialize(ordered.mapInArrow(write, SHARD_SCHEMA), "token-shards", compression="uncompressed")
    return shards, dictionary


def part_starts(shards: DataFrame) -> DataFrame:
    """(part, base): ids of all parts before it.  One number per write task passes the driver."""
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    rows, base = [], 0
    for part, n in totals:
        rows.append((part, base))
        base += n
    return shards.sparkSession.createDataFrame(rows, "part int, base long")


def _reader(words: bytes):
    import zstandard as zstd

    return zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words) if words else None)


def dictionary_bytes(dictionary: DataFrame) -> dict[str, bytes]:
    """hash -> bytes (one row of at most DICT_BYTES per file); the hash is verified."""
    out = {r.dict_hash: bytes(r.bytes) for r in dictionary.collect()}
    for h, w in out.items():
        if hashlib.sha256(w).hexdigest() != h:
            raise ValueError(f"dictionary {h} is damaged")
    return out


def read_token_file(shards: DataFrame, dictionary: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    known = dictionary_bytes(dictionary)
    based = shards.join(F.broadcast(part_starts(shards)), "part")  # one row per write task

    def read(batches):
        import pyarrow as pa

        readers = {h: _reader(w) for h, w in known.items()}
        for b in batches:
            t = b.to_pydict()
            for x in range(b.num_rows):
                d, view, dtype = readers[t["dict_hash"][x]], memoryview(t["payload"][x]), f"<u{t['width'][x]}"
                ids = [np.frombuffer(d.decompress(view[i:j]), dtype).astype("<u4") for i, j in zip(t["offsets"][x], t["offsets"][x][1:])]
                cols = [pa.array(t["doc_ids"][x], pa.int64()), pa.array(np.array(t["starts"][x], np.int64) + t["base"][x]), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return based.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_document(shards: DataFrame, dictionary: DataFrame, doc_id: int) -> list[list[int]]:
    """Ids of every document of that id, by its shard's offset index: one frame is decompressed each."""
    known = {h: _reader(w) for h, w in dictionary_bytes(dictionary).items()}
    at = F.posexplode("doc_ids").alias("i", "d")
    hits = shards.where(F.array_contains("doc_ids", doc_id)).select("*", at).where(F.col("d") == doc_id)
    rows = hits.selectExpr("dict_hash", "width", "part", "seq", "i", "substring(payload, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int)) AS frame").orderBy("part", "seq", "i").collect()
    return [np.frombuffer(known[r.dict_hash].decompress(bytes(r.frame)), f"<u{r.width}").tolist() for r in rows]


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, dictionary = write_token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_file(shards, dictionary)
