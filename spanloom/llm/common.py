"""Shared pieces of the training-data operators.

* ``shared_dir`` / ``materialize`` / ``drop``: lineage is cut by writing a table
  to the folder the session names in ``spark.checkpoint.dir`` (set here only where
  it is unset and the master is this process, as in tests), so a lost executor
  never loses it; tables that nothing reads any more are deleted.
* ``settle``: batch sizes for rows that hold whole texts.
* ``word_keys``: identity of words.  Equal words are found by their bytes, and
  each gets 64 bits of a keyed cryptographic hash; the key is drawn anew for
  every run, so no text can be made whose words or shingles collide.
* numpy kernels over the raw bytes of an Arrow string column: word spans,
  word hashes, n-gram hashes.  All work on slices of a few MB, so memory does
  not follow the size of an Arrow batch.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: rows are whole texts here: some KB each, some of them MB
WIDE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: temporary tables in a local folder: Hadoop's usual file system starts a ``chmod`` for every file and for the .crc beside it, and until that
#: runs the child counts as a second process with all of the executor's memory; Parquet's pages have checksums of their own
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: rows of a few numbers that one task writes, where their number is known
FILE_ROWS = 100_000
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C55 | 1)
_POW: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- lineage
def settle(spark) -> None:
    """Smaller reader and Arrow batches, unless the session has sizes of its own."""
    for key, value in WIDE_ROWS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark) -> str:
    """Folder that the driver and all executors see."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def plain_files(spark, writer):
    """``writer`` without a process for each file, unless local files have a file system of their own."""
    return writer if spark.conf.get("fs.file.impl", spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl")) else writer.options(**PLAIN_FILES)


def materialize(df, name: str, most: int | None = None, **options):
    """Write ``df`` once to the shared folder and return the table read back.

    ``most``: it has so many rows at most.  Tasks that write then follow this
    number, not the partitions of a shuffle (each partition is worked on by itself still, one after the other).
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most // FILE_ROWS)))
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    writer = plain_files(spark, df.write)
    for k, v in options.items():
        writer = writer.option(k.replace("__", "."), v)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def free_name(taken, want: str) -> str:
    """``want``, or ``want`` with underscores until no column of ``taken`` has it."""
    low = {c.lower() for c in taken}
    while want.lower() in low:
        want += "_"
    return want


# ---------------------------------------------------------------- Arrow text
def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "p" in _POW and len(_POW["p"]) >= n:
        return _POW["p"], _POW["i"]
    size = max(n, SLICE_BYTES + 1)
    p, inv = np.full(size, BASE, _U), np.full(size, _U(pow(int(BASE), -1, 1 << 64)), _U)
    p[0] = inv[0] = 1
    np.cumprod(p, dtype=_U, out=p)
    np.cumprod(inv, dtype=_U, out=inv)
    if size <= 4 * SLICE_BYTES:  # a very long text's are not kept
        _POW["p"], _POW["i"] = p, inv
    return p, inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] the polynomial sum of values[i:j]; see ``span_hash``."""
    p, _ = powers(len(values) + 1)
    c = np.empty(len(values) + 1, _U)
    c[0] = 0
    np.cumsum(values.astype(_U) * p[: len(values)], dtype=_U, out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of the sequence behind ``c``, wherever it stands."""
    _, inv = powers(len(c))
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0x632BE59BD9B4E019))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: op1: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_WORDS = LOWER.copy()
for _i in range(256):
    if not (48 <= _i < 58 or 65 <= _i < 91 or 97 <= _i < 123 or _i >= 128):
        ALNUM_WORDS[_i] = 0
#: op6: words are [^\x20\x09-\x0D]+ after lower-casing A-Z; byte 0 is a word byte, so it is told apart by the mask
SPACE_MASK = np.zeros(256, bool)
SPACE_MASK[[32, 9, 10, 11, 12, 13]] = True


def word_spans(is_word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of word runs, never across rows, and each row's first word.

    ``offs`` are row offsets into ``is_word`` (first 0, last its length).
    """
    n = len(is_word)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    b = offs[:-1][offs[:-1] < n]
    first[b] |= is_word[b]
    e = offs[1:][offs[1:] > 0] - 1
    last[e] |= is_word[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """concatenate(arange(s, s + n) for s, n in zip(starts, lengths))."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


# ---------------------------------------------------------------- identity of words
MAX_KNOWN = 200_000
_KNOWN: dict[bytes, dict[bytes, bytes]] = {}


def binary_array(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Arrow strings of bytes that stand in ``data`` one after the other."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def keyed(words: pa.Array, key: bytes) -> np.ndarray:
    """64 bits for each binary string: equal for equal strings, and by a hash with a secret key for others."""
    if not len(words):
        return np.zeros(0, _U)
    d = words.dictionary_encode()
    if key not in _KNOWN or len(_KNOWN[key]) > MAX_KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = {}
    known, out = _KNOWN[key], []
    for w in d.dictionary.to_pylist():
        h = known.get(w)
        if h is None:
            h = hashlib.blake2b(w, digest_size=8, key=key).digest()
            if len(w) <= 64:
                known[w] = h
        out.append(h)
    return np.frombuffer(b"".join(out), _U)[d.indices.to_numpy()]


def word_keys(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, row offsets into them); long texts go through window by window.

    ``is_word`` marks the bytes of words by value, ``fold`` maps them to lower case.
    """
    keys, starts, a, n = [], [], 0, len(raw)
    while a < n:
        b = min(n, a + SLICE_BYTES)
        if b < n:  # windows end where a word can't go on
            gap = np.flatnonzero(~is_word[raw[a:b]])
            if len(gap):
                b = a + int(gap[-1]) + 1
            else:
                more = np.flatnonzero(~is_word[raw[b:]])
                b = b + int(more[0]) + 1 if len(more) else n
        part = raw[a:b]
        mask = is_word[part]
        inner = offs[np.searchsorted(offs, a, side="right") : np.searchsorted(offs, b)] - a
        s, e, _ = word_spans(mask, np.concatenate(([0], inner, [b - a])))
        keys.append(keyed(binary_array(fold[part[mask]], e - s), key))
        starts.append(s + a)
        a = b
    if not keys:
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    return np.concatenate(keys), np.searchsorted(np.concatenate(starts), offs)
