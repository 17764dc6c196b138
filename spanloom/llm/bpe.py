"""BPE encoding and decoding by content-defined chunk reuse.

Each text is cut where a rolling hash of the last 16 bytes says so, so equal
passages are cut alike wherever they stand.  A chunk is encoded once in a
Python worker and found by a 128-bit digest afterwards; at every join of two chunks
the text between the neighbouring safe boundaries is encoded again, and the window
widens until its ends are token boundaries on both sides (exact agreement).

A position before a space that a visible sign follows is a *safe boundary*: the
pre-tokenizer always starts a token there and never looks across it.

``Encoder`` gives the same ids as ``Tokenizer.encode(add_special_tokens=False)``:
pre-tokens are found with numpy over code points and looked up by their bytes; each
word not seen before goes to the tokenizers library.  Texts with code points
whose class is not the same in all Unicode versions, or with the string of an
added token, go to the library as they are.

Cases: a null text counts as empty and gives no ids; equal rows give equal
results; other columns are dropped, but for those named in ``keep``, whose names
must differ from the result's; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_array, prefix_hash, ragged, settle, slices, span_hash, text_buffers

VOCAB = "byte_bpe_50k.json"
L, N, O, S, BAD = 0, 1, 2, 3, 4  # noqa: E741
#: words of the word table and ids of the chunk memo in one worker; both start anew beyond, which changes no result
MAX_WORDS, MAX_MEMO_IDS = 400_000, 6_000_000
CHUNK_MASK, CHUNK_WINDOW = 0x3FF, 16


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Class of each code point of the BMP; BAD if Unicode versions might disagree."""
    old = unicodedata.ucd_3_2_0
    out = np.full(0x110000, BAD, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if c < 128:
            out[c] = S if ch in "\t\n\x0b\x0c\r " else L if ch.isalpha() else N if ch.isdigit() else O
        elif cat == old.category(ch) and cat[0] not in "CZ":
            out[c] = {"L": L, "N": N}.get(cat[0], O)
    out[0x1C:0x20] = BAD
    return out


def byte_alphabet() -> dict[str, int]:
    """Sign of the vocabulary -> byte, as all byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        alphabet, vocab = byte_alphabet(), self.tok.get_vocab(with_added_tokens=True)
        self.added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        pieces = [b""] * (max(vocab.values()) + 1)
        for sign, i in vocab.items():
            pieces[i] = self.added[i].encode() if i in self.added else bytes(alphabet[x] for x in sign)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_len)))[:-1]
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)
        self.cls = _classes()
        self.signs = {b: s for s, b in alphabet.items()}
        self._clear()

    def _clear(self):
        self.entry: dict[bytes, int] = {}
        self.at, self.len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0

    # ---- word table
    def _add(self, words: list[bytes]) -> None:
        model, signs, n = self.tok.model, self.signs, len(self.entry)
        got = [[t.id for t in model.tokenize(w.decode("latin-1").translate(signs))] for w in words]
        lens = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(lens.sum()))
        while n + len(words) > len(self.at):
            self.at, self.len = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.len, np.zeros_like(self.len)))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.at[n : n + len(words)] = self.n_ids + np.concatenate(([0], np.cumsum(lens)))[:-1]
        self.len[n : n + len(words)] = lens
        self.entry.update(zip(words, range(n, n + len(words))))
        self.n_ids += len(flat)

    def _entries(self, words: pa.Array) -> np.ndarray:
        """Place of each word in the table; words are compared by their bytes."""
        if not len(words):
            return np.zeros(0, np.int64)
        d = words.dictionary_encode()
        distinct, entry = d.dictionary.to_pylist(), self.entry
        if new := [w for w in distinct if w not in entry]:
            self._add(new)
        return np.fromiter((entry[w] for w in distinct), np.int64, len(distinct))[d.indices.to_numpy()]

    # ---- encoding
    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row offsets into them) of the texts ``raw[offs[i]:offs[i+1]]``."""
        parts, ends, done = [], [], 0
        for i, j in slices(offs):
            ids, o = self._slice(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            parts.append(ids)
            ends.append(o[1:] + done)
            done += len(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return flat, np.concatenate(([0], *ends)).astype(np.int64)

    def _slice(self, raw, offs):
        if len(self.entry) > MAX_WORDS:
            self._clear()
        data = raw.tobytes()
        cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        co = lead[offs]
        k = self.cls[cp]
        bad = np.diff(np.searchsorted(np.flatnonzero(k == BAD), co)) > 0
        for content in self.added.values():
            at = data.find(content.encode())
            while at >= 0:
                bad[np.searchsorted(offs, at, side="right") - 1] = True
                at = data.find(content.encode(), at + 1)
        starts = self._pretokens(cp, k, co)
        ends = np.append(starts[1:], len(cp))
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        size = np.append(head, len(raw))[ends] - head[starts] if len(starts) else np.zeros(0, np.int64)
        words = binary_array(raw, size)  # pre-tokens stand one after the other
        wo = np.searchsorted(starts, co)
        if bad.any():
            ok = np.ones(len(starts), bool)
            for b in np.flatnonzero(bad):
                ok[wo[b] : wo[b + 1]] = False
            starts, words = starts[ok], words.filter(pa.array(ok))
            wo = np.searchsorted(starts, co)
        e = self._entries(words)
        n = self.len[e].astype(np.int64)
        ids = self.ids[ragged(self.at[e], n)]
        io = np.concatenate(([0], np.cumsum(n)))[wo]
        if bad.any():
            rows = [ids[io[r] : io[r + 1]] for r in range(len(offs) - 1)]
            whole = np.flatnonzero(bad)
            for r, x in zip(whole, self.tok.encode_batch_fast([data[offs[r] : offs[r + 1]].decode() for r in whole], add_special_tokens=False)):
                rows[r] = np.array(x.ids, np.uint32)
            ids, io = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        return ids, io

    @staticmethod
    def _pretokens(cp, k, co) -> np.ndarray:
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64)
        first = np.zeros(n + 1, bool)
        first[co] = True
        space = k == S
        cut = np.zeros(n + 1, bool)
        a, b = k[:-1], k[1:]
        sa, sb = space[:-1], space[1:]
        cut[1:n] = np.where(sb, ~sa, np.where(sa, cp[:-1] != 32, a != b))
        last = space.copy()  # last sign of a run of spaces that something visible follows in the same text
        last[:-1] &= ~space[1:]
        last &= ~first[1:]
        cut[:n] |= last
        cut |= first
        q = np.flatnonzero((cp == 39) & cut[:n])  # ' at the start of a token of its own
        q = q[(q + 1 < n)]
        q = q[(k[q + 1] == L) & ~first[q + 1]]
        if len(q):
            x, y = cp[q + 1], cp[np.minimum(q + 2, n - 1)]
            one = np.isin(x, [115, 116, 109, 100])
            two = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & (q + 2 < n) & ~first[q + 2]
            cut[q[one | two] + 1] = False
            cut[q[one] + 2] = True
            cut[q[two] + 3] = True
        return np.flatnonzero(cut[:n])

    # ---- decoding
    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        raw = self.pool[ragged(self.piece_at[ids], self.piece_len[ids])].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


class ChunkEncoder:
    """``Encoder`` behind a memo of content-defined chunks."""

    def __init__(self, path: str):
        self.enc = Encoder(path)
        self.memo: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.seen = self.reused = 0

    def encode(self, raw, offs):
        parts, ends, done = [], [], 0
        for i, j in slices(offs):
            ids, o = self._slice(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            parts.append(ids)
            ends.append(o[1:] + done)
            done += len(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate(([0], *ends)).astype(np.int64)

    def _chunks(self, raw, offs):
        """Starts of chunks: rows' starts and rolling-hash cuts at code point starts."""
        n, w = len(raw), CHUNK_WINDOW
        cut = np.zeros(n + 1, bool)
        if n > w:
            at = np.arange(w, n)
            h = span_hash(prefix_hash(raw), at - w, at)
            cut[w:n] = ((h & np.uint64(CHUNK_MASK)) == 0) & ((raw[w:] & 0xC0) != 0x80)
        cut[offs] = True
        return np.flatnonzero(cut[:n])

    def _slice(self, raw, offs):
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        starts = self._chunks(raw, offs)
        ends = np.append(starts[1:], n)
        view = memoryview(raw.tobytes())
        keys = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]
        self.seen += len(keys)
        memo, new = self.memo, {}
        for x, k in enumerate(keys):
            if k not in memo:
                new.setdefault(k, x)
        self.reused += len(keys) - len(new)
        if new:
            at = np.fromiter(new.values(), np.int64, len(new))
            size = ends[at] - starts[at]
            ids, io = self.enc.encode(raw[ragged(starts[at], size)], np.concatenate(([0], np.cumsum(size))))
            for x, k in enumerate(new):
                memo[k] = ids[io[x] : io[x + 1]].copy()
            self.held += len(ids)
        pieces = [memo[k] for k in keys]
        ids = np.concatenate(pieces)
        if self.held > MAX_MEMO_IDS:
            self.memo, self.held = {}, 0
        tok_end = np.cumsum(self.enc.piece_len[ids])
        tok_start = tok_end - self.enc.piece_len[ids]
        joins = starts[~np.isin(starts, offs)]
        ids, tok_start = self._repair(raw, offs, ids, tok_start, joins)
        return ids, np.append(np.searchsorted(tok_start, offs[:-1]), len(ids))

    def _repair(self, raw, offs, ids, tok_start, joins):
        if not len(joins):
            return ids, tok_start
        nxt = np.append(raw[1:], 0)
        visible = (nxt > 32) & (nxt < 127) | (nxt == 0xC3)
        safe = (raw == 32) & visible
        inside = offs[1:-1][offs[1:-1] > 0] - 1
        safe[inside] = False  # a text's last byte
        safe = np.union1d(np.flatnonzero(safe), offs)
        lo = safe[np.searchsorted(safe, joins, side="right") - 1]
        hi = safe[np.searchsorted(safe, joins, side="left")]
        while True:  # widen until both ends are token boundaries of the chunks' ids
            off_lo, off_hi = ~self._is_start(tok_start, lo, len(raw)), ~self._is_start(tok_start, hi, len(raw))
            if not (off_lo.any() or off_hi.any()):
                break
            lo[off_lo] = safe[np.maximum(np.searchsorted(safe, lo[off_lo]) - 1, 0)]
            hi[off_hi] = safe[np.minimum(np.searchsorted(safe, hi[off_hi]) + 1, len(safe) - 1)]
        wide = lo < hi
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return ids, tok_start
        head = np.append(True, lo[1:] >= np.maximum.accumulate(hi)[:-1])  # windows that overlap become one
        lo, hi = lo[head], np.maximum.reduceat(hi, np.flatnonzero(head))
        size = hi - lo
        new, no = self.enc.encode(raw[ragged(lo, size)], np.concatenate(([0], np.cumsum(size))))
        new_start = ragged(lo, size)[np.cumsum(self.enc.piece_len[new]) - self.enc.piece_len[new]] if len(new) else np.zeros(0, np.int64)
        a, b = np.searchsorted(tok_start, lo), np.searchsorted(tok_start, hi)
        out, pos, last = [], [], 0
        for x in range(len(lo)):
            out += [ids[last : a[x]], new[no[x] : no[x + 1]]]
            pos += [tok_start[last : a[x]], new_start[no[x] : no[x + 1]]]
            last = b[x]
        return np.concatenate([*out, ids[last:]]), np.concatenate([*pos, tok_start[last:]])

    @staticmethod
    def _is_start(tok_start, at, n):
        x = np.searchsorted(tok_start, at)
        return (at >= n) | (tok_start[np.minimum(x, len(tok_start) - 1)] == at)


_HELD: dict[tuple[str, str], object] = {}


def held(kind, path: str):
    """One encoder for all tasks of a Python worker."""
    key = (kind.__name__, path)
    if key not in _HELD:
        _HELD[key] = kind(path)
    return _HELD[key]


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocab: str | None = None, keep=(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, the columns ``keep``, ``n_tokens``, digests of the ids and of the decoded text; with ``with_ids`` also ``ids`` and ``decoded``."""
    settle(docs.sparkSession)
    path, kinds, own = vocab or vocab_path(), dict(docs.dtypes), [id_col, *[c for c in keep if c != id_col]]
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
    if clash := {c.lower() for c in own} & set(made):
        raise ValueError(f"{', '.join(sorted(clash))}: names of result columns")
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>, decoded string"] * with_ids])
    at = len(own)

    def run(batches):
        import pyarrow as pa

        enc = held(ChunkEncoder, path)
        for b in batches:
            raw, offs = text_buffers(b.column(at))
            for i, j in slices(offs, 4 << 20):
                ids, io = enc.encode(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                rows = [ids[io[r] : io[r + 1]] for r in range(j - i)]
                texts = [enc.enc.decode(x) for x in rows]
                cols = [
                    *[b.column(c).slice(i, j - i) for c in range(at)],
                    pa.array(np.diff(io)),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                if with_ids:
                    cols += [pa.ListArray.from_arrays(pa.array(io, pa.int32()), pa.array(ids.astype(np.int32))), pa.array([t.decode() for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*own, *made])

    return docs.select(*own, F.col(text_col).alias("text_")).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
