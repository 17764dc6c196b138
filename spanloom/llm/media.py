"""Media columns: interleaved sequences of text and media references.

``interleave`` parses HTML into an ordered sequence of structs (position, kind,
text, digest, caption): text blocks as they read, and for each ``img`` its
reference, with the caption of the figure it stands in.  ``resolve`` joins the
references with a media store by digest; positions and captions stay beside
their media, and references without a payload stay with null features.

The store keeps payloads losslessly as 8-bit grey PNG images (576 samples a
row): ``store_payloads`` writes them to the shared folder, ``read_store`` reads
the stored bytes back and computes digests and features where they lie.  What
crosses the network in a join is a row per digest, never the payload.

Cases: a null text or html counts as empty (payload: one padded row of 255s);
equal payloads have one digest and equal values; an empty table gives an empty
store; captions and positions do not change when a payload is missing; scripts,
styles and comments are not read, a tag ends at the first ``>`` outside quotes, and
one that the text's end cuts off counts for nothing; names that are taken get underscores.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, settle, slices, text_buffers
from .htmltext import tags

ROW, PAD, MAX_SEEN = 576, 255, 200_000
_PNG = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
MEDIA = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


# ---------------------------------------------------------------- payloads
def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of 576."""
    return raw + bytes([PAD]) * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """Grey 8-bit PNG, 576 samples a row; the unpadded length stands in a private chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"leNg", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[np.ndarray, int]:
    """(samples as rows x 576, unpadded length) of ``to_png``; checks every chunk's sum."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG")
    at, width, data, n = 8, 0, [], 0
    while at < len(png):
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"leNg":
            n = struct.unpack(">Q", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:], n


def feature_of(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples and a 64-bit average hash of an 8 x 8 grid of block means."""
    flat = samples.ravel()
    total, square = int(flat.sum(dtype=np.int64)), int((flat.astype(np.int64) ** 2).sum())
    n = len(flat)
    mean = total / n
    cells = np.add.reduceat(flat.astype(np.int64), np.arange(64) * n // 64) / np.diff(np.append(np.arange(64) * n // 64, n))
    bits = int("".join("1" if c >= mean else "0" for c in cells), 2)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};std={max(0.0, square / n - mean * mean) ** 0.5:.4f};ahash={bits:016x}"


def store_payloads(df: DataFrame, raw_col: str = "text") -> DataFrame:
    """Writes each different payload of ``raw_col`` (string or binary) to the store, once a task: (digest, media)."""
    settle(df.sparkSession)

    def encode(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        for b in batches:
            raw, offs = text_buffers(b.column(0))
            for i, j in slices(offs, 8 << 20):
                digests, media = [], []
                for r in range(i, j):
                    text = raw[offs[r] : offs[r + 1]].tobytes()
                    digest = hashlib.sha256(text)
                    if digest.digest() in seen:  # a copy that this task has stored
                        continue
                    if len(seen) >= MAX_SEEN:  # then some copies are stored again; the store's reader makes them one
                        seen.clear()
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(to_png(pad(text), len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return materialize(df.select(raw_col).mapInArrow(encode, "digest string, media binary"), "media", compression="uncompressed")


def read_store(store: DataFrame) -> DataFrame:
    """One row of MEDIA per digest, from the stored bytes."""

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for digest, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                samples, n = from_png(png)
                payload = samples.tobytes()
                if hashlib.sha256(payload[:n]).hexdigest() != digest:
                    raise ValueError(f"payload of {digest} is damaged")
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(samples)))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in MEDIA.split(", ")])

    out = store.select("digest", "media").mapInArrow(decode, MEDIA)
    return out.groupBy("digest").agg(*[F.first(c).alias(c) for c in out.columns[1:]])  # equal digests, equal values


# ---------------------------------------------------------------- sequences
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_SRC = re.compile(r"""(?<![^\s"'/])src\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLOCK = frozenset("p div figure figcaption h1 h2 h3 h4 h5 h6 li ul ol article section main body html blockquote td tr table header footer".split())


def sequence_of(html: str | None) -> list[dict]:
    """Ordered text blocks and media references of one page."""
    from html import unescape

    out: list[dict] = []
    parts: list[str] = []
    figure: list[int] | None = None
    caption = False

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if not text:
            return
        if caption and figure:
            for k in figure:
                out[k]["caption"] = text
        else:
            out.append({"kind": "text", "text": text, "digest": None, "caption": None})

    at, html = 0, html or ""
    for start, end, close, tag, attributes in tags(html):
        if start < at:  # inside a script or style
            continue
        parts.append(html[at:start])
        at = end
        if tag in ("script", "style") and not close:
            m = _RAW_END[tag].search(html, end)
            parts.append(" ")
            at = m.end() if m else len(html)
        elif tag == "img" and not close:
            flush()
            src = _SRC.search(attributes)
            ref = unescape(next((g for g in src.groups() if g is not None), "")) if src else ""
            if figure is not None:
                figure.append(len(out))
            out.append({"kind": "media", "text": None, "digest": ref.removeprefix("sha256:"), "caption": None})
        elif tag in _BLOCK:
            flush()
            if tag == "figure":
                figure = None if close else []
            elif tag == "figcaption":
                caption = not close
    parts.append(html[at:])
    flush()
    for k, x in enumerate(out):
        x["position"] = k
    return out


def interleave(pages: DataFrame, keep=("page_id",), html_col: str = "html") -> DataFrame:
    """``keep`` columns and ``sequence`` of every page."""
    kinds, k = dict(pages.dtypes), len(keep)

    def run(batches):
        import pyarrow as pa

        item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
        for b in batches:
            seqs = pa.array([sequence_of(h) for h in b.column(k).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], seqs], names=[*keep, "sequence"])

    return pages.select(*keep, html_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", sequence {SEQUENCE}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row per item of every sequence, with the media's columns where its digest is known.

    ``media`` has one row a digest; write it before where copies crowd, so that Spark can split the join.
    """
    keep = [c for c in sequences.columns if c != "sequence"]
    taken, names = list(keep), {}
    for c in ("position", "kind", "text", "digest", "caption", *[c for c in media.columns if c != "digest"]):
        names[c] = free_name(taken, c)
        taken.append(names[c])
    items = sequences.select(*keep, F.explode("sequence").alias("x_")).select(*keep, *[F.col(f"x_.{c}").alias(names[c]) for c in ("position", "kind", "text", "digest", "caption")])
    known = media.select(*[F.col(c).alias(names[c]) for c in media.columns])
    joined = items.join(known, names["digest"], "left")
    return joined.select(*keep, *names.values())


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page of its own: a heading, and a figure whose payload is the whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    media = materialize(read_store(store_payloads(docs)), "media-rows")  # written, so that Spark can split the join where copies crowd
    figure = F.concat(F.lit("<article><h1>Document</h1><figure><img src=\"sha256:"), F.sha2(F.encode("text", "UTF-8"), 256), F.lit("\"><figcaption>Text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("</figcaption></figure></article>"))
    pages = docs.select("doc_id", figure.alias("html"))
    found = resolve(interleave(pages, ("doc_id",)), media).where(F.col("kind") == "media")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
