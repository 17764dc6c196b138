"""Patterns: regular expressions over annotations.

A rule file defines named patterns and sets of ``when pattern, action;`` rules:

    ngroup := [constit cat=det]? [constit cat=adj]* [constit cat=n] : Head;
    pattern set chunks;
    when ngroup
      add [ngroup head=Head];

Elements: ``"token"``, ``[type f=v g=?ne(w) h=Var]`` (``null``: the feature must
be absent), ``[integer min=1 max=31 intvalue=N]``, ``[undefinedCap]``, names of
other patterns, ``( ... )``, ``|``, ``?``, ``*``, ``+``, ``: Var`` behind an
element binds its span or annotation.  At each token all rules are tried; the
longest match wins, the first rule on ties; its actions run, and matching goes
on behind what they added, or one token further.  Matches read what earlier
ones added, so a sentence is one ordered fold; documents stream past in order.
"""

from __future__ import annotations

import re
from functools import lru_cache
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import groups, in_order, key_type, map_batches, record_batches

_LEX = re.compile(r"""\s+|//[^\n]*|(?P<string>"[^"]*")|(?P<op>:=|[\[\]()|?*+:;,=])|(?P<word>[^\s\[\]()|?*+:;,="]+)""")


def _lex(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"pattern syntax at {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append(m[0])
        at = m.end()
    return out


@dataclass
class Node:
    """kind: token, ann, seq, alt, rep, ref, bind."""

    kind: str
    value: object = None
    parts: list = field(default_factory=list)


class Rules:
    """SRC23: parsed pattern collection; unknown names never match."""

    def __init__(self, text: str = ""):
        self.patterns: dict[str, Node] = {}
        self.sets: dict[str, list[tuple[Node, list[tuple]]]] = {}
        self.toks, self.i = _lex(text), 0
        current = "default"
        while self.i < len(self.toks):
            if self._peek("pattern") and self.toks[self.i + 1] == "set":
                self.i += 2
                current = self._next()
                self.sets.setdefault(current, [])
                self._eat(";")
            elif self._peek("when"):
                self.i += 1
                pattern, actions = self._alternation(), []
                while not self._peek(";"):
                    if self._peek(","):
                        self.i += 1
                    actions.append(self._action())
                self._eat(";")
                self.sets.setdefault(current, []).append((pattern, actions))
            else:
                name = self._next()
                self._eat(":=")
                self.patterns[name] = self._alternation()
                self._eat(";")

    def _peek(self, *want):
        return self.i < len(self.toks) and self.toks[self.i] in want

    def _next(self):
        if self.i >= len(self.toks):
            raise ValueError("pattern file ends early")
        self.i += 1
        return self.toks[self.i - 1]

    def _eat(self, want):
        if (got := self._next()) != want:
            raise ValueError(f"expected {want!r}, found {got!r}")

    def _alternation(self):
        parts = [self._sequence()]
        while self._peek("|"):
            self.i += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else Node("alt", parts=parts)

    def _sequence(self):
        parts = []
        while self.i < len(self.toks) and not self._peek("|", ")", ";", ",", "add", "addfeatures", "print", "write"):
            parts.append(self._repetition())
        return Node("seq", parts=parts)

    def _repetition(self):
        node = self._element()
        while True:
            if self._peek("?", "*", "+"):
                node = Node("rep", self._next(), [node])
            elif self._peek(":"):
                self.i += 1
                node = Node("bind", self._next(), [node])
            else:
                return node

    def _element(self):
        t = self._next()
        if t == "(":
            node = self._alternation()
            self._eat(")")
            return node
        if t == "[":
            return Node("ann", self._features())
        if t.startswith('"'):
            return Node("token", t[1:-1])
        if self._peek("=") :
            self.i += 1
            return Node("assign", (t, self._next().strip('"')))
        return Node("ref", t)

    def _features(self):
        type_, feats = self._next(), {}
        while not self._peek("]"):
            key = self._next()
            self._eat("=")
            if self._peek("["):
                self.i += 1
                inner = self._features()
                feats[key] = inner[0]
                feats |= {f"{key}.{k}": v for k, v in inner[1].items()}
                continue
            value = self._next()
            if value.startswith("?") or value == "?":
                name = value[1:] or self._next()
                self._eat("(")
                value = ("?" + name, self._next())
                self._eat(")")
            feats[key] = value
        self._eat("]")
        return type_, feats

    def _action(self):
        verb = self._next().lower()
        if verb in ("print", "write"):
            parts = [self._next()]
            while self._peek("+"):
                self.i += 1
                parts.append(self._next())
            return verb, parts
        self._eat("[")
        what, over, bound = self._features() if verb == "add" else (None, self._features_only()), None, None
        while self._peek("over", "to", "bound"):
            word = self._next()
            if word == "bound":
                self._eat("to")
                bound = self._next()
            else:
                over = self._next()
        return verb, what, over, bound

    def _features_only(self):
        feats = {}
        while not self._peek("]"):
            key = self._next()
            self._eat("=")
            feats[key] = self._next()
        self._eat("]")
        return feats


class Matcher:
    """PAT1-PAT17 over one document: tokens and annotations in, new annotations out.

    Annotations are dicts with type, start, end, attrs; token ends include the
    space behind, so neighbours touch.
    """

    def __init__(self, rules: Rules, isa=None):
        self.rules, self.isa = rules, isa or (lambda word, concept: word == concept)

    def run(self, set_name: str, text: str, tokens: list[tuple[int, int]], annotations: list[dict], limit: int | None = None):
        self.text, self.anns, self.printed = text, list(annotations), []
        self.tokens = {s: e for s, e in tokens}
        self.limit = max(self.tokens.values(), default=0) if limit is None else limit
        self.at: dict[int, list[dict]] = {}
        for a in self.anns:
            self.at.setdefault(a["start"], []).append(a)
        added, i = [], 0
        starts = sorted(self.tokens)
        while i < len(starts):
            p, best = starts[i], None
            for pattern, actions in self.rules.sets.get(set_name, ()):
                for end, binds in self._match(pattern, p, {}):
                    if end <= self.limit and end > p and (best is None or end > best[0]):
                        best = (end, binds, actions)
            i += 1
            if best:
                new = self._act(best[2], p, best[0], best[1])
                added += new
                far = max((a["end"] for a in new), default=p)
                while i < len(starts) and starts[i] < far:
                    i += 1
        return added, self.printed

    def _match(self, node: Node, p: int, b: dict):
        k = node.kind
        if k == "seq":
            yield from self._series(node.parts, p, b)
        elif k == "alt":
            for x in node.parts:
                yield from self._match(x, p, b)
        elif k == "rep":
            if node.value in "?*":
                yield p, b
            for q, c in self._match(node.parts[0], p, b):
                if q == p:
                    continue
                if node.value == "?":
                    yield q, c
                else:
                    yield from self._match(Node("rep", "*", node.parts), q, c)
        elif k == "ref":
            if node.value in self.rules.patterns:
                yield from self._match(self.rules.patterns[node.value], p, b)
        elif k == "bind":
            inner = node.parts[0]
            for q, c in self._match(inner, p, b):
                ann = c.pop("_last", None) if inner.kind == "ann" else None
                yield q, c | {node.value: ann or (p, q)}
        elif k == "assign":
            yield p, b | {node.value[0]: node.value[1]}
        elif k == "token":
            if p in self.tokens and self.text[p : self.tokens[p]].strip() == node.value:
                yield self.tokens[p], b
        else:
            yield from self._annotation(node.value, p, b)

    def _series(self, parts, p, b):
        if not parts:
            yield p, b
            return
        for q, c in self._match(parts[0], p, b):
            yield from self._series(parts[1:], q, c)

    def _annotation(self, value, p, b):
        type_, feats = value
        here = [a for a in self.at.get(p, ()) if not a.get("hidden")]
        if type_ == "undefinedCap":
            if p in self.tokens and self.text[p : p + 1].isupper() and not any(a["type"] == "constit" for a in here):
                yield self.tokens[p], b
            return
        if type_ == "integer":
            word = self.text[p : self.tokens.get(p, p)].strip()
            if word.replace(",", "").isdigit():
                v = int(word.replace(",", ""))
                if int(feats.get("min", v)) <= v <= int(feats.get("max", v)):
                    yield self.tokens[p], b | ({feats["intvalue"]: str(v)} if "intvalue" in feats else {})
            return
        for a in here:
            if a["type"] == type_ and (c := self._unify(feats, a["attrs"], b)) is not None:
                yield a["end"], c | {"_last": a}

    def _unify(self, feats, attrs, b):
        """ANN16/ANN17: null means absent, a capitalized value is a variable, ``?ne`` and ``?isa`` are tests."""
        b = dict(b)
        for k, want in feats.items():
            have = attrs.get(k)
            if want == "null":
                if have is not None:
                    return None
            elif have is None:
                return None
            elif isinstance(want, tuple):
                if want[0] == "?ne" and have == want[1] or want[0] == "?isa" and not self.isa(have, want[1]):
                    return None
            elif want[:1].isupper():
                if b.get(want, have) != have:
                    return None
                b[want] = have
            elif have != want.strip('"'):
                return None
        return b

    def _value(self, v, b):
        got = b.get(v, v.strip('"') if isinstance(v, str) else v)
        if isinstance(got, tuple):
            return self.text[got[0] : got[1]].strip()
        return self.text[got["start"] : got["end"]].strip() if isinstance(got, dict) else got

    def _act(self, actions, start, end, b):
        new = []
        for action in actions:
            if action[0] in ("print", "write"):
                self.printed.append("".join(self._value(v, b) for v in action[1]))
                continue
            verb, (type_, feats), over, bound = action
            filled = {k: self._value(v, b) for k, v in feats.items()}
            if verb == "add":
                span = (start, end)
                if over == "0":
                    span = (start, start)
                elif over is not None and over in b:
                    span = b[over] if isinstance(b[over], tuple) else (b[over]["start"], b[over]["end"])
                ann = {"type": type_, "start": span[0], "end": span[1], "attrs": filled}
                if filled.get("hidden") in ("true", "t"):
                    ann["hidden"] = True
                self.anns.append(ann)
                self.at.setdefault(span[0], []).append(ann)
                new.append(ann)
                if bound:
                    b[bound] = ann
            elif isinstance(b.get(over), dict):
                b[over]["attrs"].update(filled)
        return new


@lru_cache(maxsize=8)
def _rules(text: str) -> Rules:
    """Rules parsed once in a Python worker, not once a document."""
    return Rules(text)


def apply_patterns(tokens: DataFrame, rules_text: str, set_name: str, annotations: DataFrame | None = None) -> DataFrame:
    """PAT1: new annotations of a rule set per document.

    ``tokens`` are (doc_id, start, end, token); texts are rebuilt from them, so
    a task holds one document's tokens and annotations at a time.
    """
    kind, like = dict(tokens.dtypes)["doc_id"], key_type(tokens)
    none = F.lit(None).cast("map<string,string>")
    rows = tokens.select("doc_id", "start", "end", F.lit("token").alias("type"), "token", none.alias("attrs"))
    if annotations is not None:
        rows = rows.unionByName(annotations.select("doc_id", "start", "end", "type", F.lit(None).cast("string").alias("token"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs")))

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(_rules(rules_text))

        def found():
            for d, rows in groups(batches):
                toks = [(s, e, w if attrs is None else dict(attrs)["string"]) for s, e, t, w, attrs in rows if t == "token"]
                text = [" "] * max((e for _, e, _ in toks), default=0)
                for s, _, w in toks:
                    text[s : s + len(w)] = w
                anns = [{"type": t, "start": s, "end": e, "attrs": {"string": w} if attrs is None else dict(attrs)} for s, e, t, w, attrs in rows]
                new, _ = matcher.run(set_name, "".join(text), [(s, e) for s, e, _ in toks], anns)
                yield from ((d, a["type"], a["start"], a["end"], list(a["attrs"].items())) for a in new)

        yield from record_batches(found(), [like, pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())], ["doc_id", "type", "start", "end", "attrs"])

    return map_batches(in_order(rows, "doc_id", "start", "end", F.col("attrs").isNotNull()), run, f"doc_id {kind}, type string, start int, `end` int, attrs map<string,string>")
