"""Entity, relation and event files in APF XML: tables to documents and back.

Offsets in the files include their end; tables are half-open.  ``to_inclusive``
and ``to_half_open`` are the only places that convert.
"""

from __future__ import annotations

from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import map_batches, slices

#: one row per mention, argument or value of a file
ROW = "doc_id string, kind string, id string, type string, subtype string, mention string, mention_type string, role string, ref string, start int, `end` int, text string"
_NAMES = [x.split()[0].strip("`") for x in ROW.split(", ")]
_KINDS = ("entity", "value", "timex2", "relation", "event")


def to_inclusive(start: int, end: int) -> tuple[int, int]:
    return start, end - 1


def to_half_open(start: int, end: int) -> tuple[int, int]:
    return start, end + 1


def read_apf(source: str) -> list[tuple]:
    """SRC9: rows of one file; arguments have the id they refer to in ``ref``."""
    out, root = [], ElementTree.fromstring(source)
    for doc in root.iter("document"):
        doc_id = doc.get("DOCID")
        for kind in _KINDS:
            for x in doc.findall(kind):
                head = (doc_id, kind, x.get("ID"), x.get("TYPE") or x.get("VAL"), x.get("SUBTYPE"))
                for a in x.findall(f"{kind}_argument"):
                    out.append((*head, None, None, a.get("ROLE"), a.get("REFID"), None, None, None))
                for m in x.findall(f"{kind}_mention"):
                    seq = m.find("anchor/charseq") if kind == "event" else m.find("extent/charseq")
                    span = (*to_half_open(int(seq.get("START")), int(seq.get("END"))), seq.text or "") if seq is not None else (None, None, None)
                    out.append((*head, m.get("ID"), m.get("TYPE"), m.get("ROLE"), None, *span))
                    for a in m.findall(f"{kind}_mention_argument"):
                        out.append((*head, m.get("ID"), None, a.get("ROLE"), a.get("REFID"), None, None, None))
    return out


def write_apf(doc_id: str, rows: list[tuple]) -> str:
    """SNK4: a file of rows (entities, values, times, relations, events, in this order; attributes without a value are left out)."""

    def attrs(**kw):
        return "".join(f" {k}={quoteattr(v)}" for k, v in kw.items() if v is not None)

    out = ['<?xml version="1.0"?>', f"<source_file>\n<document{attrs(DOCID=doc_id)}>"]
    for kind in _KINDS:
        groups: dict[tuple, list[dict]] = {}
        for r in (dict(zip(_NAMES, x)) for x in rows):
            if r["kind"] == kind:
                groups.setdefault((r["id"], r["type"], r["subtype"]), []).append(r)
        for (id_, type_, subtype), members in groups.items():
            named = {"VAL": type_} if kind == "timex2" else {"TYPE": type_, "SUBTYPE": subtype}
            out.append(f"<{kind}{attrs(ID=id_, **named)}>")
            out += [f"<{kind}_argument{attrs(REFID=m['ref'], ROLE=m['role'])}/>" for m in members if m["mention"] is None]
            for m in members:
                if m["mention"] is None or m["ref"] is not None:
                    continue
                out.append(f"<{kind}_mention{attrs(ID=m['mention'], TYPE=m['mention_type'], ROLE=m['role'])}>")
                if m["start"] is not None:
                    a, b = to_inclusive(m["start"], m["end"])
                    tag = "anchor" if kind == "event" else "extent"
                    out.append(f'<{tag}><charseq START="{a}" END="{b}">{escape(m["text"] or "")}</charseq></{tag}>')
                out += [f"<{kind}_mention_argument{attrs(REFID=x['ref'], ROLE=x['role'])}/>" for x in members if x["mention"] == m["mention"] and x["ref"] is not None]
                out.append(f"</{kind}_mention>")
            out.append(f"</{kind}>")
    return "\n".join([*out, "</document>\n</source_file>"])


def parse(files: DataFrame, source: str = "text") -> DataFrame:
    """SRC9/SRC11 over a table of whole files; a file that is no XML gives no rows."""

    def run(batches):
        import pyarrow as pa

        types = [pa.string()] * 9 + [pa.int32()] * 2 + [pa.string()]
        for b in slices(batches):
            rows = []
            for x in b.column(0).to_pylist():
                try:
                    rows += read_apf(x) if x else []
                except ElementTree.ParseError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=_NAMES)

    return map_batches(files.select(source), run, ROW)


def render(rows: DataFrame) -> DataFrame:
    """SNK4 over a table of rows: doc_id and its file.  A file holds one document's rows."""
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*_NAMES))).alias("rows"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            out = [write_apf(d, [tuple(r.values()) for r in x]) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "apf"])

    return map_batches(grouped, run, "doc_id string, apf string")
