"""Tokens, sentences and zones.

Spans are half-open code point offsets.  The linguistic tokenizer and the
sentence splitter read a text from left to right and decide by what they have
seen, so they run as Arrow-batched functions over whole documents: no shuffle,
memory bounded by a batch.  What SQL can say stays in Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..arrow import map_batches, record_batches, slices

_USER, _DOMAIN = r"[a-zA-Z0-9_.-]+", r"(?:[a-zA-Z0-9-]+\.)+[a-zA-Z0-9]+"
EMAIL = rf"{_USER}(?: ?\.\.\. ?)?@{_DOMAIN}"
URL = rf"http://{_DOMAIN}[a-zA-Z0-9_=?/-]+"
_EMAIL, _URL = re.compile(EMAIL), re.compile(URL)
_CLITICS = {3: ("n't", "'re", "'ve", "'ll"), 2: ("'s", "'m", "'d")}
_MARKUP = re.compile(r"(?:\s+|<[^>]*>)*")
_BLOCK, _FIGURES = re.compile(r"(\S+)\s*"), re.compile(r"[0-9][0-9,]*")
#: longest block whose tokens are kept: a longer one hardly comes again, and takes as much memory as it has tokens
CACHED_SIGNS = 24
TOKEN = "doc_id {0}, seq int, start int, `end` int, token string, `case` string, intvalue long, type string"


# ---------------------------------------------------------------- SEG1-3
def _cuts(block: str, at: int, final: bool, special: dict[int, int]) -> list[bool]:
    """Where tokens of a white-space block start; one entry more than it has signs."""
    n = len(block)
    cut = [False] * n + [True]
    for i, c in enumerate(block):
        if not (c.isalnum() or c == "."):
            cut[i] = cut[i + 1] = True
    for m in re.finditer(r"``|''|--", block):
        if cut[m.start()]:
            cut[m.start() + 1] = False
    for i in range(n - 2):
        if block.startswith("...", i) and cut[i]:
            cut[i + 1] = cut[i + 2] = False
    for m in re.finditer(r"(?<=\d),(?=\d)", block[:-1] if n > 2 else ""):
        cut[m.start()] = cut[m.start() + 1] = False
    for m in re.finditer(r"(?<=\d),(?=\d$)", block):
        if m.start() < n - 2:
            cut[m.start()] = cut[m.start() + 1] = False
    if final and (m := re.search(r"\.(?=$|[\"'}>)]$|''$)", block)):
        cut[m.start()] = True
    for size, forms in _CLITICS.items():
        for i in range(n - size + 1):
            if cut[i + size] and block[i : i + size] in forms:
                cut[i : i + size] = [True] + [False] * (size - 1)
    for i, c in enumerate(block):
        if c == "&" and (e := block.rfind(";", i)) > i:
            cut[i + 1 : e + 1] = [False] * (e - i)
    for i in range(n):
        if (e := special.get(at + i)) is not None:
            cut[i] = True
            for j in range(i + 1, min(n, e - at)):
                cut[j] = False
    return cut


def tokens_of(text: str, start: int = 0, end: int | None = None, whole_document: bool = True) -> Iterator[tuple]:
    """(start, end with trailing space, token, case, intvalue, type) of a text."""
    end = len(text) if end is None else end
    special: dict[int, int] = {}
    kind: dict[int, str] = {}
    for pattern, name in ((_EMAIL, "email"), (_URL, "url")):
        for m in pattern.finditer(text, start, end):
            special[m.start()], kind[m.start()] = m.end(), name
    at, last, first_block = max(start, _MARKUP.match(text, start, end).end()), "", True
    for begin, stop, after in _blocks(text, at, end, special):
        block, final = text[begin:stop], whole_document and after >= end
        if final or special and any(begin <= k < stop for k in special):
            parts = _parts(block, _cuts(block, begin, final, special))
        else:
            parts = _plain_block(block) if stop - begin <= CACHED_SIGNS else _parts(block, _cuts(block, 0, False, {}))
        for s, e, word, upper, value in parts:
            case, type_ = None, kind.get(begin + s)
            if type_ is not None:
                value = None
            elif upper:
                case = "forcedCap" if first_block or last in ("_", '"', "``", "`") else "cap"
            yield begin + s, after if begin + e == stop else begin + e, word, case, value, type_
            last = word
        first_block = False


def _blocks(text: str, at: int, end: int, special: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the next) of white-space blocks; an address with spaces in it is of one block."""
    if not any(" " in text[a:b] for a, b in special.items()):
        yield from ((m.start(), m.end(1), m.end()) for m in _BLOCK.finditer(text, at, end))
        return
    while at < end:
        begin, at = at, special.get(at, at + 1)
        while at < end and not text[at].isspace():
            at = special.get(at, at + 1)
        stop = at
        while at < end and text[at].isspace():
            at += 1
        yield begin, stop, at


def _parts(block: str, cut: list[bool]) -> list[tuple[int, int, str, bool, int | None]]:
    """(start, end, token, capitalized, value) of a block's tokens."""
    out, s = [], 0
    for e in range(1, len(block) + 1):
        if cut[e]:
            word = block[s:e]
            number = not word[0].isupper() and _FIGURES.fullmatch(word) and (int(word.split(",")[0]) > 0 or "," not in word)
            out.append((s, e, word, word[0].isupper(), int(word.replace(",", "")) if number else None))
            s = e
    return out


@lru_cache(maxsize=1 << 14)
def _plain_block(block: str) -> list[tuple[int, int, str, bool, int | None]]:
    """Tokens of a block that is neither a text's last nor holds an address: the same wherever it stands."""
    return _parts(block, _cuts(block, 0, False, {}))


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """SEG1-SEG3: one row per token."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "seq", "start", "end", "token", "case", "intvalue", "type"]
        for b in slices(batches):
            rows = ((d, k, *t) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, t in enumerate(tokens_of(x or "")))
            yield from record_batches(rows, [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()], names)

    return map_batches(docs.select("doc_id", text), run, TOKEN.format(kind))


def emails(text: Column) -> Column:
    """SEG3: e-mail addresses in reading order."""
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


# ---------------------------------------------------------------- SEG4
def word_array(text: Column) -> Column:
    """SEG4: white-space tokens of a text as an array (empty for null)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """SEG4: white-space tokens as rows ``doc_id, seq, token``."""
    return docs.select("doc_id", F.posexplode(word_array(F.col(text))).alias("seq", "token"))


def pieces(docs: DataFrame, sep: str, type_: str, text: str = "text") -> DataFrame:
    """Spans of the parts of a text between one-sign separators (lines, words): doc_id, seq, type, start, end.

    Positions are running sums over a document's parts, computed inside the
    row; nothing is shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in slices(batches):
            parts = pc.split_pattern(pc.fill_null(b.column(1), ""), sep)
            flat, at = parts.flatten(), parts.offsets.to_numpy()
            n = pc.utf8_length(flat).to_numpy().astype(np.int64)
            row = parts.value_parent_indices().to_numpy() if hasattr(parts, "value_parent_indices") else np.repeat(np.arange(len(parts)), np.diff(at))
            ends = np.cumsum(n + 1)
            base = np.concatenate(([0], ends))[at[:-1]][row]
            e = ends - 1 - base
            ids = pc.take(b.column(0), pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array((np.arange(len(row)) - at[row]).astype(np.int32)), pa.array((e - n).astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "seq", "start", "end"])

    found = map_batches(docs.select("doc_id", text), run, f"doc_id {kind}, seq int, start int, `end` int")
    return found.select("doc_id", "seq", F.lit(type_).alias("type"), "start", "end")


# ---------------------------------------------------------------- SEG6
#: Words whose period ends no sentence
ABBREVIATIONS = frozenset(
    "Adj. Adm. Adv. Asst. Bart. Brig. Bros. Capt. Cmdr. Col. Comdr. Con. Cpl. Dr. Ens. Gen. Gov. Hon. Hosp. Insp. Lt. Maj. Messrs. Mlle. Mme. Mr. Mrs. Ms. Msgr. Prof. Pvt. Rep. Reps. Res. Rev. Rt. Sen. Sens. Sfc. Sgt. Sr. St. Supt. Surg. Alex. Benj. Chas. a.k.a. c.f. i.e. vs. v. e.g. U.S. U.N. D.C.".split()
)
_LOWER_ABBREVIATIONS = frozenset(a.lower() for a in ABBREVIATIONS)
_OPENING = "`'\"([{<"
_STOP, _STRONG_STOP = re.compile(r"[?!.]"), re.compile(r"[?!]$|[?!.][\"'}>)]$|[?!.]''$")


def _sentence_ends(word: str, nxt: str, first: bool, monocase: bool) -> bool:
    if not _STOP.search(word):
        return False
    known = _LOWER_ABBREVIATIONS if monocase else ABBREVIATIONS
    fold = (lambda w: w.lower()) if monocase else (lambda w: w)
    bare = [word] + ([word[1:]] if len(word) > 1 and word[0] in _OPENING else []) + ([word[2:]] if len(word) > 2 and word[:2] in ("''", "``") else [])
    if any(fold(w) in known for w in bare):
        return False
    starts = nxt[0].isupper() or monocase or (nxt[0] in _OPENING and nxt[1:2].isupper()) or (nxt[:2] in ("``", "''") and nxt[2:3].isupper()) or nxt == "_" or nxt[0] == "<"
    if not starts:
        return False
    if _STRONG_STOP.search(word):
        return True
    if not word.endswith("."):
        return False
    if first and word.lower() in ("q.", "a."):
        return True
    initial = str.isalpha if monocase else str.isupper
    if len(word) == 2 and initial(word[0]) or len(word) == 4 and word[1] == "." and initial(word[2]) and initial(word[0]):
        return False
    if nxt[0] == "<":
        return True
    return not (nxt[0] == "(" and nxt.endswith((")", ").", "),")))


def sentences_of(text: str, start: int = 0, end: int | None = None, dividers: tuple[int, ...] = (), monocase: bool = False) -> list[tuple[int, int]]:
    """SEG6: sentence spans; ``dividers`` are offsets where a sentence must end."""
    end = len(text) if end is None else end
    forced = set(dividers)
    while start < end and text[start].isspace():
        start += 1
    out, begin, word, broken, first = [], start, None, False, True
    for count, m in enumerate(re.finditer(r"(\S+)(\s*)", text[start:end]), 1):
        a, b, c = start + m.start(), start + m.end(1), start + m.end()
        if word is not None and (broken or _sentence_ends(word, m[1], first, monocase) or (word == "_" and count <= 5)):
            out.append((begin, a))
            begin, first = a, True
        else:
            first = word is None
        word, broken = m[1], any(p in forced for p in range(b, c + 1))
    if begin < end:
        out.append((begin, end))
    return out


def sentences(docs: DataFrame, text: str = "text", monocase: str | None = None, dividers: str | None = None) -> DataFrame:
    """SEG6: doc_id, seq, start, end of each sentence; ``monocase`` and ``dividers`` (array<int>) name columns."""
    kind = dict(docs.dtypes)["doc_id"]
    mono = F.col(monocase) if monocase else F.lit(False)
    div = F.col(dividers) if dividers else F.array().cast("array<int>")

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = ((d, k, s, e) for d, x, m, v in zip(*[b.column(i).to_pylist() for i in range(4)]) for k, (s, e) in enumerate(sentences_of(x or "", dividers=tuple(v or ()), monocase=bool(m))))
            yield from record_batches(rows, [b.schema.field(0).type, *[pa.int32()] * 3], ["doc_id", "seq", "start", "end"])

    return map_batches(docs.select("doc_id", F.col(text).alias("t"), mono.alias("m"), div.alias("v")), run, f"doc_id {kind}, seq int, start int, `end` int")


# ---------------------------------------------------------------- SEG7-SEG13
def gap_sessions(rows: DataFrame, key: str, time: str, gap: Column, order: list | None = None) -> DataFrame:
    """SEG7: rows with ``session``: a new one where the step from the row before is greater than ``gap`` (not equal)."""
    w = W.partitionBy(key).orderBy(*(order or [time]))
    step = F.col(time) - F.lag(time).over(w)
    return rows.withColumn("session", F.sum(F.when(step > gap, 1).otherwise(0)).over(w))


def dateline_end(text: Column) -> Column:
    """SEG8: end of the dateline zone, or null: an agency mark within the first 80 signs, and the space behind it."""
    out = F.lit(None).cast("int")
    for agency in reversed(("(AFP)", "(AP)", "(Xinhua)")):
        at = F.instr(text, agency)
        e = at - 1 + len(agency)
        rest = F.length(F.regexp_extract(F.substring(text, e + 1, F.length(text)), r"^\s*", 0))
        out = F.when((at > 1) & (at <= 80), e + rest).otherwise(out)
    return out


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(line: Column) -> Column:
    """SEG9: nothing but white space and control signs."""
    return _trimmed(line) == ""


def is_text_break(line: Column) -> Column:
    """SEG9: blank, or nothing but ``-``, ``_`` and ``~``."""
    return is_blank(line) | _trimmed(line).rlike(r"^[-_~]+$")


def sentence_number(positions: DataFrame, sents: DataFrame) -> DataFrame:
    """SEG10: number of the last sentence that starts at or before ``pos`` (0 before the first)."""
    s = sents.select("doc_id", F.col("start").alias("s"))
    found = positions.join(s, (positions["doc_id"] == s["doc_id"]) & (s["s"] <= positions["pos"]), "left").drop(s["doc_id"])
    return found.groupBy(*positions.columns).agg(F.greatest(F.count("s") - 1, F.lit(0)).alias("sentence"))


def letter_cases(text: Column) -> tuple[Column, Column]:
    """Counts of ASCII upper- and lower-case letters."""
    return F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^a-z]", ""))


def is_monocase(text: Column) -> Column:
    """SEG11: no capitals at all, or more than half of all letters."""
    up, low = letter_cases(text)
    return (up == 0) | (up * 2 > up + low)


_FUNCTION_WORDS = "a|an|and|as|at|but|by|for|from|in|into|of|on|or|the|to|with|over|under|after"


def is_title_case(text: Column) -> Column:
    """SEG12: every word of letters starts with a capital, function words aside; letters of any script, and spaces that break no line bind words."""
    return text.rlike(r"(?U)\b\p{IsUppercase}") & ~text.rlike(rf"(?U)(^|[\s&&[^\x85\xA0\u2007\u202F]])(?!(?:{_FUNCTION_WORDS})\b)\p{{IsLowercase}}")


def document_id(tags: DataFrame) -> DataFrame:
    """SEG13: DOCID over DOCNO over document@DOCID over DOC@id; rows (doc, type, value, attrs) of head markup."""
    first = lambda cond, v: F.first(F.when(cond, v), ignorenulls=True)
    return tags.groupBy("doc").agg(
        F.coalesce(
            first(F.col("type") == "DOCID", F.trim("value")),
            first(F.col("type") == "DOCNO", F.trim("value")),
            first(F.lower("type") == "document", F.element_at("attrs", "DOCID")),
            first(F.col("type") == "DOC", F.element_at("attrs", "id")),
        ).alias("document_id")
    )
