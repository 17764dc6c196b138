"""Inline markup: reading it into text and annotations, and writing it back.

Tags may cross; a close tag ends the last open tag of its name.  Attribute
values may be quoted, ``{a b c}`` lists, ``[k=v ...]`` nested features (flattened
to dotted keys) or ``#id`` references.  Each text is scanned once, from left to
right, in an Arrow-batched function; references resolve by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import map_batches, slices

_TAG = re.compile(r"""<\s*(/?)\s*([A-Za-z_][\w.:-]*)((?:\s+[^<>"'{\[]*?(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\{[^}]*\}|\[[^\]]*\])?)*?)\s*(/?)\s*>""", re.S)
_ATTR = re.compile(r"""([\w.:-]+)\s*=\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\{[^}]*\}|\[[^\]]*\]|[^\s/>]+)""", re.S)
_PROLOG = re.compile(r"<\?xml[^>]*\?>|<!(?!--)[^>]*>|<!--.*?-->", re.S)
READ = "doc_id {0}, text string, annotations array<struct<seq:int,type:string,start:int,`end`:int,attrs:map<string,string>>>, problems array<string>"


def decode_value(key: str, raw: str) -> dict[str, str]:
    """SRC3: one attribute as flat features: lists keep their words, nested features get dotted keys."""
    if raw[:1] in "\"'" and raw[-1:] == raw[:1] and len(raw) > 1:
        return {key: re.sub(r"\\(.)", r"\1", raw[1:-1])}
    if raw.startswith("{"):
        return {key: " ".join(raw[1:-1].split())}
    if raw.startswith("["):
        return {f"{key}.{k}": v for k0, r in _ATTR.findall(raw[1:-1]) for k, v in decode_value(k0, r).items()}
    return {key: raw}


def read_markup(source: str, tags: Iterable[str] | None = None, empty: Iterable[str] = ()):
    """SRC1/SRC2: (text, annotations, problems); ``tags`` None captures all, other tags stay in the text."""
    wanted = None if tags is None else {t.lower() for t in tags}
    hollow = {t.lower() for t in empty}
    out, done, open_, problems, at, n = [], [], [], [], 0, 0
    seq = 0

    def text_to(e):
        nonlocal n
        part = source[at:e]
        out.append(part)
        n += len(part)

    while True:
        lt = source.find("<", at)
        if lt < 0:
            text_to(len(source))
            break
        if p := _PROLOG.match(source, lt):
            text_to(lt)
            at = p.end()
            continue
        m = _TAG.match(source, lt)
        if not m or (wanted is not None and m[2].lower() not in wanted):
            e = m.end() if m else lt + 1
            text_to(e)
            at = e
            continue
        text_to(lt)
        at, name = m.end(), m[2]
        if m[1]:
            for d in range(len(open_) - 1, -1, -1):
                if open_[d][1].lower() == name.lower():
                    s, type_, start, attrs = open_.pop(d)
                    done.append((s, type_, start, n, attrs))
                    break
            else:
                problems.append(f"close tag without open tag: {name}")
            continue
        attrs = {}
        for k, v in _ATTR.findall(m[3]):
            attrs |= decode_value(k, v)
        if m[4] or name.lower() in hollow:
            done.append((seq, name, n, n, attrs))
        else:
            open_.append((seq, name, n, attrs))
        seq += 1
    problems += [f"open tag without close tag: {x[1]}" for x in open_]
    return "".join(out), sorted(done), problems


def write_markup(text: str, annotations: Iterable[tuple], types: Iterable[str] | None = None, escape: bool = False, trim: bool = False) -> str:
    """SNK1: text with tags, parents around children; ``trim`` leaves a span's trailing white space outside."""
    wanted = None if types is None else set(types)
    rows = []
    for seq, (type_, start, end, attrs) in enumerate(annotations):
        if wanted is None or type_ in wanted:
            e = start + len(text[start:end].rstrip()) if trim and end > start else end
            rows.append((start, e, seq, type_, attrs or {}))
    opens, closes = {}, {}
    for start, end, seq, type_, attrs in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        shown = "".join(f' {k}="{v}"' for k, v in attrs.items())
        if start == end:
            opens.setdefault(start, []).append(f"<{type_}{shown}></{type_}>")
        else:
            opens.setdefault(start, []).append(f"<{type_}{shown}>")
            closes.setdefault(end, []).insert(0, (start, f"</{type_}>"))
    out, last = [], 0
    for p in sorted({*opens, *closes}):
        part = text[last:p]
        out.append(part.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if escape else part)
        out += [t for _, t in sorted(closes.get(p, ()), key=lambda c: -c[0])]
        out += opens.get(p, ())
        last = p
    return "".join(out) + text[last:]


def parse(docs: DataFrame, source: str = "text", tags: list[str] | None = None, empty: tuple[str, ...] = ()) -> DataFrame:
    """SRC1-SRC3 over a table: doc_id, text, annotations, problems; null sources are empty texts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        item = pa.struct([("seq", pa.int32()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))])
        for b in slices(batches):
            got = [read_markup(x or "", tags, empty) for x in b.column(1).to_pylist()]
            anns = [[{"seq": s, "type": t, "start": a, "end": e, "attrs": list(f.items())} for s, t, a, e, f in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(anns, pa.list_(item)), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["doc_id", "text", "annotations", "problems"])

    return map_batches(docs.select("doc_id", source), run, READ.format(kind))


def annotation_rows(parsed: DataFrame) -> DataFrame:
    """Long form of ``parse``: one row per annotation."""
    return parsed.select("doc_id", F.explode("annotations").alias("a")).select("doc_id", F.col("a.seq").cast("long").alias("ann_id"), F.col("a.seq").cast("long").alias("seq"), "a.type", "a.start", "a.end", "a.attrs")


def dereference(annotations: DataFrame, key: str) -> DataFrame:
    """SRC4: ``#id`` values of attribute ``key`` as the annotation id they name (null if there is none)."""
    ids = annotations.select("doc_id", F.element_at("attrs", "id").alias("ref_id"), F.col("ann_id").alias("ref")).where("ref_id IS NOT NULL")
    want = annotations.withColumn("ref_id", F.regexp_extract(F.element_at("attrs", key), r"^#(.+)$", 1))
    return want.join(ids, ["doc_id", "ref_id"], "left").drop("ref_id")


def render(docs: DataFrame, annotations: DataFrame, types: list[str] | None = None) -> DataFrame:
    """SNK1/SNK2/SNK14 over tables: doc_id and the text with tags."""
    kind = dict(docs.dtypes)["doc_id"]
    grouped = annotations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "start", "end", F.map_entries("attrs").alias("attrs")))).alias("anns"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            out = [write_markup(x or "", [(r["type"], r["start"], r["end"], {e["key"]: e["value"] for e in r["attrs"] or ()}) for r in a or ()], types) for x, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "sgml"])

    return map_batches(docs.select("doc_id", "text").join(grouped, "doc_id", "left"), run, f"doc_id {kind}, sgml string")


def strip_markup(text):
    """SRC10: text without tags; what follows a tag that never closes goes."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"(?s)<.*$", "")
