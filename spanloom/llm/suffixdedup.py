"""Suffix-array dedup: remove bytes covered by strings that an earlier document holds.

A byte goes if some ``LENGTH``-byte (50) string over it also starts in a
document with a smaller id.  Strings are judged on the input, never across
documents.

1. Documents are packed into blocks of about 1 MB (one row each), and the blocks
   are dealt once into a bucketed table in the shared folder: every later step reads
   them where they lie, and only small answers travel to them.  Whole texts that an
   earlier document equals are settled by digest, in a block first, then across blocks.
2. Each 50-byte window picks its smallest 20-byte gram hash, so equal windows
   pick equal grams.  Grams of all documents meet by hash, once a block with the
   number of rows that hold them; those of one document only are done with.
3. For shared grams, the bytes around each occurrence (all its windows) meet by
   gram, equal pieces once per block and once per bucket.  Pieces that differ
   are put one after the other, their suffixes sorted, and the Burrows-Wheeler
   transform taken.  Starting from the empty string, all intervals are extended
   backwards at once through the inverse of the LF mapping: in round l exactly
   the boundaries with common prefix l appear, and round 50 is the last.  What
   no boundary parts is one class of equal windows; its smallest document wins.
   Windows of a gram that ``HOT`` rows and more hold meet one by one, by the hash of
   all their bytes, so no group of pieces grows with the corpus: what many documents
   share is one window a block, and their different neighbours spread over all tasks.
4. The classes' smallest documents go back to the blocks, which cut.

What crosses the network between steps are packed arrays, a row per block and
bucket that it has something for; buckets follow the size of the input.  What a
block is sent back (a bit a gram, a number a window) is never more than its own share.

Cases: null texts are empty; a null id is neither earlier nor later than any
(nothing of it goes, and it takes nothing from others); rows of one id do not
cut each other; texts under 50 bytes stay whole; long texts go through segment by
segment; names that are taken get underscores.  Cutting can split a UTF-8
sequence: ``kept`` is binary, and text made of it drops broken sequences.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, drop, free_name, materialize, plain_files, prefix_hash, ragged, settle, shared_dir, slices, span_hash, text_buffers

LENGTH, GRAM = 50, 20
SPREAD = LENGTH - GRAM + 1
BLOCK_BYTES, BUCKET_BYTES, SORT_BYTES, PART_BYTES, SEGMENT = 1 << 20, 24 << 20, 1 << 20, 64 << 20, 1 << 19
#: rows that hold a gram, from which its windows meet one by one
HOT = 8192
_POS = np.uint64((1 << 26) - 1)
NONE = np.iinfo(np.int64).max


# ---------------------------------------------------------------- kernels
def minimizers(raw: np.ndarray, offs: np.ndarray):
    """(gram hash, row, first window, number of windows) of each run of windows that pick one gram."""
    out = [], [], [], []
    for i, j in slices(offs, SEGMENT):
        a, b = int(offs[i]), int(offs[j])
        for lo in range(a, max(a + 1, b - LENGTH + 1), SEGMENT) if j == i + 1 else (a,):  # windows of a long text, segment by segment
            hi = min(b, lo + SEGMENT + LENGTH - 1) if j == i + 1 else b
            inner = np.clip(offs[i : j + 1], lo, hi) - lo
            for x, part in zip(out, _minimizers(raw[lo:hi], inner)):
                x.append(part)
            out[1][-1] += i
            out[2][-1] += lo
    if not out[0]:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in out)


def _minimizers(raw, offs):
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    at = np.arange(n - GRAM + 1)
    h = span_hash(prefix_hash(raw), at, at + GRAM)
    w = (h & ~_POS) | at.astype(np.uint64)
    for d in (1, 2, 4, 8):
        w = np.minimum(w[:-d], w[d:])
    w = np.minimum(w[: -(SPREAD - 16)], w[SPREAD - 16 :])  # smallest of 31 grams: one per window
    size = np.diff(offs)
    long = size >= LENGTH
    first, last = offs[:-1][long], offs[1:][long] - LENGTH  # windows of each row
    valid = np.zeros(n - LENGTH + 2, np.int8)
    np.add.at(valid, first, 1)
    np.add.at(valid, last + 1, -1)
    change = np.ones(len(w), bool)
    change[1:] = w[1:] != w[:-1]
    change[first] = True
    j0 = np.flatnonzero(change & (np.cumsum(valid[:-1]) > 0))
    row = np.searchsorted(offs, j0, side="right") - 1
    end = np.minimum(np.append(j0[1:], n), offs[row + 1] - LENGTH + 1)
    return h[(w[j0] & _POS).astype(np.int64)], row, j0, end - j0


def window_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the window at each of ``starts`` (ascending within a row's runs), some MB of text at a time."""
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), 1 << 16):
        part = starts[k : k + (1 << 16)]
        data = raw[ragged(part, np.full(len(part), LENGTH))]
        at = np.arange(len(part)) * LENGTH
        out[k : k + len(part)] = span_hash(prefix_hash(data), at, at + LENGTH)
    return out


def suffix_order(text: np.ndarray, depth: int = 64) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes (prefix doubling from 8 bytes)."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, 255, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    k = 8
    while True:
        sa = np.argsort(key)
        s = key[sa]
        head = np.empty(n, bool)
        head[:1] = True
        head[1:] = s[1:] != s[:-1]
        if k >= depth or head.all():
            return sa
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(head)
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] if k < n else 0
        key = (rank.astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64)
        k *= 2


def prefix_classes(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, boundary): boundary[i] is set where suffixes i-1 and i share fewer than ``length`` bytes.

    Breadth-first: all intervals of strings of l bytes are extended by one byte
    to the left through the Burrows-Wheeler transform, so the common prefixes
    come in increasing order; only positions still open are looked at.
    """
    n = len(text)
    sa = suffix_order(text, max(64, length + 1))
    bwt = text[sa - 1]  # the byte before each suffix (the last byte before the first)
    psi = np.argsort(bwt, kind="stable")  # inverse of the LF mapping: one byte off the front
    first = text[sa]
    boundary = np.zeros(n, bool)
    boundary[0] = True
    boundary[1:] = first[1:] != first[:-1]  # common prefix 0
    open_at = np.flatnonzero(~boundary)
    for _ in range(1, length):
        if not len(open_at):
            break
        interval = np.cumsum(boundary, dtype=np.int32)
        new = interval[psi[open_at - 1]] != interval[psi[open_at]]
        if not new.any():
            break  # intervals that no extension parts never part
        boundary[open_at[new]] = True
        open_at = open_at[~new]
    return sa, boundary


def smallest_holders(pieces: tuple[np.ndarray, np.ndarray], docs: np.ndarray) -> np.ndarray:
    """For each window of each piece, flattened: the smallest document of an equal window."""
    data, size = pieces
    n = len(size)
    text = np.full(len(data) + n, 255, np.uint8)  # 255 parts the pieces; UTF-8 never holds it
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    text[ragged(start, size)] = data
    windows = size - LENGTH + 1
    at = ragged(start, windows)
    sa, boundary = prefix_classes(text)
    holder = np.full(len(text), NONE, np.int64)
    holder[at] = np.repeat(docs, windows)
    head = np.flatnonzero(boundary)
    least = np.minimum.reduceat(holder[sa], head)
    by_suffix = np.empty(len(text), np.int64)
    by_suffix[sa] = np.repeat(least, np.diff(np.append(head, len(text))))
    return by_suffix[at]


# ---------------------------------------------------------------- blocks
def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _table(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as r:
        return r.read_next_batch()


SLOTS = "array<struct<slots:array<int>,id:long,d1:long,d2:long>>"


def pack_blocks(docs: DataFrame, id_at: int, text_at: int) -> DataFrame:
    """block, slots (of each different text of 50 bytes and more: rows with its smallest id, id, digest), local (rows of later copies), rows (Arrow)."""

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        item = pa.struct([("slots", pa.list_(pa.int32())), ("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
        for b in batches:
            raw, offs = text_buffers(b.column(text_at))
            ids = b.column(id_at).to_pylist()
            for i, j in slices(offs, BLOCK_BYTES):
                seen: dict[bytes, list[int]] = {}
                for r in range(i, j):
                    if offs[r + 1] - offs[r] >= LENGTH and ids[r] is not None:
                        seen.setdefault(hashlib.blake2b(raw[offs[r] : offs[r + 1]], digest_size=16).digest(), []).append(r)
                slots, local = [], []
                for digest, rows in seen.items():
                    d, least = np.frombuffer(digest, np.int64), min(ids[r] for r in rows)
                    slots.append({"slots": [r - i for r in rows if ids[r] == least], "id": least, "d1": int(d[0]), "d2": int(d[1])})
                    local += [r - i for r in rows if ids[r] > least]
                cols = [pa.array([seq], pa.int64()), pa.array([slots], pa.list_(item)), pa.array([local], pa.list_(pa.int32())), pa.array([_ipc(b.slice(i, j - i))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "slots", "local", "rows"])
                seq += 1

    return docs.mapInArrow(run, f"block long, slots {SLOTS}, local array<int>, rows binary")


def _bucketed(blocks: DataFrame, parts: int) -> DataFrame:
    """``blocks`` as a table of ``parts`` buckets in the shared folder; joins by block leave it where it lies."""
    spark, name = blocks.sparkSession, f"spanloom_blocks_{uuid.uuid4().hex}"
    writer = blocks.repartition(parts, "block").write.format("parquet").option("compression", "uncompressed").bucketBy(parts, "block")
    plain_files(spark, writer).option("path", f"{shared_dir(spark)}/spanloom/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files stay, and ``out`` knows them
    return out


def _texts(payload, dups, id_at, text_at):
    """(batch, bytes, offsets, ids, whether a row takes part)."""
    b = _table(payload)
    raw, offs = text_buffers(b.column(text_at))
    ids = b.column(id_at)
    part = ids.is_valid().to_numpy(zero_copy_only=False).copy()
    part[np.array(dups or [], np.int64)] = False
    return b, raw, offs, ids.fill_null(NONE).cast(pa.int64()).to_numpy(), part


def _block_grams(raw, offs, part, buckets):
    """Runs of windows of the rows that take part, each run's place in the list of distinct grams, and that list: gram, bucket (ascending), rows."""
    gram, row, j0, n = minimizers(raw, offs)
    use = part[row]
    gram, row, j0, n = gram[use], row[use], j0[use], n[use]
    distinct, back = np.unique(gram, return_inverse=True)
    _, first = np.unique(back * (int(row.max()) + 1 if len(row) else 1) + row, return_index=True)  # one of each gram and row
    rows = np.bincount(back[first], minlength=len(distinct))
    bucket = (distinct >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return gram, row, j0, n, place[back], distinct[order], bucket[order], rows[order]


def _batch(names, types, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``: the bytes that stay, or as text without broken sequences."""
    spark = docs.sparkSession
    settle(spark)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    total, count = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)), F.count("*")).first()
    buckets = max(64, 2 * spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES))
    blocks = _bucketed(pack_blocks(docs, id_at, text_at), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES)))

    # 1. whole texts that an earlier document equals
    entries = blocks.select("block", F.explode("slots").alias("x")).select("block", "x.*")
    firsts = entries.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("d1", "d2", "first")
    firsts = materialize(firsts, "firsts", count)  # written, so that Spark can split the join where one text's copies crowd
    copies = entries.join(firsts, ["d1", "d2"]).where("id > first").select("block", F.explode("slots").alias("slot"))
    dups = materialize(copies.groupBy("block").agg(F.collect_list("slot").alias("dups")), "copies", count)  # at most a block's rows
    drop(firsts)
    none = F.array().cast("array<int>")
    base = blocks.join(dups.hint("shuffle_hash"), "block", "left").select("block", "rows", F.concat("local", F.coalesce("dups", none)).alias("dups"))

    # 2. grams of several documents
    def grams(batches):
        for b in batches:
            for block, payload, dup in zip(*[c.to_pylist() for c in b.columns]):
                _, raw, offs, _, part = _texts(payload, dup, id_at, text_at)
                *_, gram, bucket, rows = _block_grams(raw, offs, part, buckets)
                entry = np.empty((len(gram), 6), np.uint8)
                entry[:, :5] = gram.view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits beside the bucket: only a filter
                entry[:, 5] = np.minimum(rows, 255)
                which, at = np.unique(bucket, return_index=True)
                ends = np.append(at[1:], len(bucket))
                yield _batch(["bucket", "block", "grams"], [pa.int32(), pa.int64(), pa.binary()], [(int(k), block, entry[a:e].tobytes()) for k, a, e in zip(which, at, ends)])

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table["grams"].to_pylist()]
        entry = np.concatenate(parts)
        wide = np.zeros((len(entry), 8), np.uint8)
        wide[:, :5] = entry[:, :5]
        g, back = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        rows = np.bincount(back, entry[:, 5], len(g))[back]
        ends = np.cumsum([len(p) for p in parts])
        pack = lambda mask: [np.packbits(mask[e - len(p) : e]).tobytes() if mask[e - len(p) : e].any() else b"" for p, e in zip(parts, ends)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "shared": pa.array(pack(rows >= 2), pa.binary()), "hot": pa.array(pack(rows >= HOT), pa.binary())})

    met = base.mapInArrow(grams, "bucket int, block long, grams binary").groupBy("bucket").applyInArrow(meet, "block long, bucket int, shared binary, hot binary")
    # one entry for each bucket that the block has grams for, two bits a gram: never more than a block's own share
    replies = met.where("length(shared) > 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("replies"))

    # 3. pieces around shared grams
    spread = 4 * buckets

    def pieces(batches):
        names = ["bucket", "block", "grams", "docs", "size", "data"]
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        for b in batches:
            for block, payload, dup, reply in zip(*[c.to_pylist() for c in b.columns]):
                if not reply:
                    continue
                _, raw, offs, ids, part = _texts(payload, dup, id_at, text_at)
                gram, row, j0, n, place, _, bucket, _ = _block_grams(raw, offs, part, buckets)
                hit, hot = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
                for r in reply:
                    a, e = np.searchsorted(bucket, (r["bucket"], r["bucket"] + 1))
                    for mask, bits in ((hit, r["shared"]), (hot, r["hot"])):
                        if bits:
                            mask[a:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(e - a)).astype(bool)
                single = hot[place] & hit[place]
                use = hit[place] & ~single
                j1 = ragged(j0[single], n[single])
                row = np.concatenate((row[use], np.repeat(row[single], n[single])))
                gram, n0 = gram[use], n[use]
                j0, n = np.concatenate((j0[use], j1)), np.concatenate((n0, np.ones(len(j1), np.int64)))
                if not len(j0):
                    continue
                size = n + LENGTH - 1
                d = binary_array(raw[ragged(j0, size)], size).dictionary_encode()  # equal pieces, by their bytes
                back = d.indices.to_numpy().astype(np.int64)
                _, first = np.unique(back, return_index=True)
                least = np.full(len(first), NONE, np.int64)
                np.minimum.at(least, back, ids[row])
                gram = np.concatenate((gram, window_hashes(raw, j1)))[first]
                home = (gram >> np.uint64(20)).astype(np.int64) % spread
                order = np.argsort(home, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                first, least, home, gram = first[order], least[order], home[order], gram[order]
                # what the last step needs of this block: windows of each run, and its piece
                state = np.stack([row, j0, n, place[back]]).astype(np.int32)
                out = [(-1, block, b"", n[first].astype(np.int32).tobytes(), b"", state.tobytes())]
                which, a = np.unique(home, return_index=True)
                for k, s, e in zip(which, a, np.append(a[1:], len(home))):
                    f = first[s:e]
                    out.append((int(k), block, gram[s:e].tobytes(), least[s:e].tobytes(), size[f].astype(np.int32).tobytes(), raw[ragged(j0[f], size[f])].tobytes()))
                yield _batch(names, types, out)

    schema = "bucket int, block long, grams binary, docs binary, size binary, data binary"
    cut = materialize(base.join(replies.hint("shuffle_hash"), "block", "left").select("block", "rows", "dups", "replies").mapInArrow(pieces, schema), "pieces", compression="zstd")
    state = cut.where("bucket < 0").select("block", F.col("docs").alias("windows"), F.col("data").alias("state"))

    def classes(table: pa.Table) -> pa.Table:
        import zstandard as zstd

        cols = {k: table[k].to_pylist() for k in ("grams", "docs", "size", "data")}
        counts = [len(x) // 8 for x in cols["grams"]]
        gram = np.concatenate([np.frombuffer(x, np.uint64) for x in cols["grams"]])
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in cols["docs"]])
        size = np.concatenate([np.frombuffer(x, np.int32) for x in cols["size"]]).astype(np.int64)
        data = np.frombuffer(b"".join(cols["data"]), np.uint8)
        least = bucket_classes(gram, doc, size, data)
        at = np.concatenate(([0], np.cumsum(size - LENGTH + 1)))
        ends = np.cumsum(counts)
        comp = zstd.ZstdCompressor(level=1)
        out = [comp.compress(least[at[e - c] : at[e]].tobytes()) for c, e in zip(counts, ends)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "least": pa.array(out, pa.binary())})

    found = cut.where("bucket >= 0").groupBy("bucket").applyInArrow(classes, "block long, bucket int, least binary")
    answers = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "least"))).alias("answers"))

    # 4. cut
    extra, taken = [], list(docs.columns)
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.StringType() if as_text else T.BinaryType())):
        extra.append(T.StructField(free_name(taken, name), kind))
        taken.append(extra[-1].name)

    def finish(batches):
        import zstandard as zstd

        de = zstd.ZstdDecompressor()
        for b in batches:
            for payload, dup, windows, st, answer in zip(*[c.to_pylist() for c in b.columns]):
                t, raw, offs, ids, _ = _texts(payload, dup, id_at, text_at)
                removed = np.zeros(len(raw) + 1, bool)
                if answer:
                    least = np.concatenate([np.frombuffer(de.decompress(x["least"]), np.int64) for x in answer])
                    per = np.frombuffer(windows, np.int32)
                    at = np.concatenate(([0], np.cumsum(per, dtype=np.int64)))
                    row, j0, n, piece = np.frombuffer(st, np.int32).reshape(4, -1).astype(np.int64)
                    later = least[ragged(at[piece], n)] < np.repeat(ids[row], n)
                    starts = ragged(j0, n)[later]
                    hits = np.zeros(len(raw) + 1, np.int32)
                    hits[starts] = 1
                    seen = np.cumsum(hits)
                    seen[LENGTH:] -= seen[:-LENGTH].copy()
                    removed = seen > 0
                for r in dup or ():
                    removed[offs[r] : offs[r + 1]] = True
                removed = removed[: len(raw)]
                edge = removed.copy()
                edge[1:] &= ~removed[:-1]
                inner = offs[:-1][offs[:-1] < len(raw)]
                edge[inner] = removed[inner]
                sums = lambda m: (c := np.concatenate(([0], np.cumsum(m))))[offs[1:]] - c[offs[:-1]]
                gone = sums(removed)
                stay = raw[~removed]
                ko = np.concatenate(([0], np.cumsum(np.diff(offs) - gone)))
                kept = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(ko.astype(np.int32).tobytes()), pa.py_buffer(stay.tobytes())])
                if as_text:
                    kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(np.diff(offs)), pa.array(gone.astype(np.int64)), pa.array(sums(edge).astype(np.int64)), kept], names=[*t.schema.names, *[f.name for f in extra]])

    last = base.join(state.hint("shuffle_hash"), "block", "left").join(answers.hint("shuffle_hash"), "block", "left").select("rows", "dups", "windows", "state", "answers")
    return last.mapInArrow(finish, T.StructType([*docs.schema.fields, *extra]))


def bucket_classes(gram: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Smallest document of each window of each piece of a bucket, flattened in the order given."""
    at = np.concatenate(([0], np.cumsum(size)))
    back = binary_array(data, size).dictionary_encode().indices.to_numpy().astype(np.int64)  # equal pieces are one
    _, first = np.unique(back, return_index=True)
    least = np.full(len(first), NONE, np.int64)
    np.minimum.at(least, back, doc)
    windows = size[first] - LENGTH + 1
    wo = np.concatenate(([0], np.cumsum(windows)))
    out = np.repeat(least, windows)  # a gram with one piece: all its windows have that piece's holders
    order = np.argsort(gram[first], kind="stable")
    g = gram[first][order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    count = np.diff(np.append(head, len(g)))
    several = np.repeat(count > 1, count)
    todo = order[several]
    weight = np.concatenate(([0], np.cumsum(size[first][todo] + 1)))
    group = np.repeat(np.arange(len(head)), count)[several]
    i = 0
    while i < len(todo):  # whole gram groups, about SORT_BYTES at a time
        j = int(np.searchsorted(weight, weight[i] + SORT_BYTES))
        j = min(max(j, i + 1), len(todo))
        j = int(np.searchsorted(group, group[j - 1], side="right"))
        p = todo[i:j]
        f = first[p]
        out[ragged(wo[p], windows[p])] = smallest_holders((data[ragged(at[f], size[f])], size[f]), least[p])
        i = j
    return out[ragged(wo[back], windows[back])]


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
