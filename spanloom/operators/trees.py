"""Parse trees: reading, heads, chunks, dependencies, grammars, edges.

A tree is a nested structure of one sentence; its operators are pure functions
that run in Arrow batches.  Edge sets are tables (doc_id, src, label, dst).
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import map_batches, slices


@dataclass
class Tree:
    label: str
    children: list[Tree] = field(default_factory=list)
    word: str | None = None
    function: str | None = None
    head: int = -1

    def leaves(self) -> list[Tree]:
        return [self] if self.word is not None else [x for c in self.children for x in c.leaves()]

    def show(self) -> str:
        """SNK9: s-expression."""
        esc = lambda w: w.replace("(", "-LRB-").replace(")", "-RRB-")
        return f"({self.label} {esc(self.word) if self.word is not None else ' '.join(c.show() for c in self.children)})"


# ---------------------------------------------------------------- SRC12
def read_trees(source: str) -> list[Tree]:
    """Treebank s-expressions: comments skipped, tag and function split, -NONE- dropped, outer brackets unwrapped."""
    source = re.sub(r"(?m)^\*x\*.*$|^;.*$", "", source)
    toks = re.findall(r"[()]|[^\s()]+", source)
    at, out = 0, []

    def node():
        nonlocal at
        at += 1
        label = ""
        if toks[at] not in "()":
            label, at = toks[at], at + 1
        kids, word = [], None
        while toks[at] != ")":
            if toks[at] == "(":
                if (k := node()) is not None:
                    kids.append(k)
            else:
                word, at = toks[at], at + 1
        at += 1
        if label.upper() == "-NONE-" or (word is None and not kids):
            return None
        base, _, fn = label.partition("-") if not label.startswith("-") else (label, "", "")
        if not label and len(kids) == 1:
            return kids[0]
        return Tree(re.sub(r"=\d+$", "", base), kids, word, fn or None)

    while at < len(toks):
        if toks[at] == "(":
            if (t := node()) is not None:
                out.append(t)
        else:
            at += 1
    return out


_NO_SPACE_BEFORE = re.compile(r"^(?:[.,:;?!%)\]}]|''|'s|'S|'|n't|N'T|'re|'ve|'ll|'d|'m)$")


def detokenize(words: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Text of tree words, and each word's span."""
    text, spans = "", []
    for k, w in enumerate(words):
        if k and not _NO_SPACE_BEFORE.match(w) and words[k - 1] not in ("``", "(", "[", "{", "$"):
            text += " "
        spans.append((len(text), len(text) + len(w)))
        text += w
    return text, spans


# ---------------------------------------------------------------- SRC26, PRS4
def read_head_rules(text: str) -> dict[str, list[tuple[str, list[str]]]]:
    """Lines ``CAT left-to-right|right-to-left LABEL ...`` (# starts a comment line); several lines of one CAT are tried in order."""
    rules: dict[str, list[tuple[str, list[str]]]] = {}
    for line in text.splitlines():
        w = line.split()
        if len(w) >= 2 and not line.startswith("#"):
            rules.setdefault(w[0], []).append((w[1], w[2:]))
    return rules


#: The published head table (S. Sekine, 1996), by category
HEAD_TABLE = """
ADJP     right-to-left  QP ADJP $ JJ JJR JJS DT FW CD RB RBR RBS RP
ADVP     left-to-right  ADVP RB RBR RBS FW IN TO CD JJ JJR JJS
CONJP    left-to-right  CC RB IN
FRAG     left-to-right  FRAG
INTJ     right-to-left  INTJ
LST      left-to-right  LS
NAC      right-to-left  NN NNS NP NNPS NNP NAC EX $ CD QP PRP VBG JJ JJS JJR ADJP FW
NP       right-to-left  NP NN NNS NNP NNPS NAC EX $ CD QP PRP VBG JJ JJR JJS ADJP FW RB DT RBR RBS SYM PRP$
NX       right-to-left  NX NP NN NNS NNP NNPS NAC EX $ CD QP PRP VBG JJ JJR JJS ADJP FW RB DT RBR RBS SYM PRP$
PP       left-to-right  IN TO FW PP
PRN      right-to-left  S NP SINV PP ADVP
PRT      left-to-right  RP
QP       right-to-left  CD NN NNS JJ JJR JJS RB RBR RBS DT $
RRC      left-to-right  VP S NP ADVP ADJP PP
S        right-to-left  VP S SBAR ADJP UCP SINV SBARQ SQ NP
SBAR     right-to-left  SBAR IN WDT VP WHADVP WHADJP WHNP WHPP WP RBS DT S
SBARQ    right-to-left  SQ S SINV SBARQ FRAG X
SINV     right-to-left  VP VBZ VBD VBP VB MD SQ S SINV ADJP
SQ       right-to-left  VP VBZ VBD VBP VB MD SQ
TOP      left-to-right  S SBAR ADJP UCP SINV SBARQ SQ NP
UCP      left-to-right  UCP
VP       left-to-right  AUX AUXG VBN VBD MD VBZ VBP VP VB VBG
WHADJP   right-to-left  WHADJP WHADVP WRB CC JJ ADJP
WHADVP   left-to-right  WRB CC
WHNP     right-to-left  WDT WP WP$ WHADJP WHPP WHNP WRB DT NP
WHPP     left-to-right  IN TO FW PP
X        left-to-right  X
"""
HEAD_RULES = read_head_rules(HEAD_TABLE)


def head_of(label: str, kids: list[str], rules=HEAD_RULES, words: list[str | None] | None = None) -> int:
    """Index of the head child, -1 if there are no children.

    A noun phrase has its last noun (NN..., NX, POS, JJR) for head, else its first
    NP; otherwise the category's list decides, label by label in its direction,
    then the first child in that direction that isn't punctuation.  A category
    without a list has its first child.  ``words`` are those of children that are
    terminals, None for others.
    """
    if not kids:
        return -1
    if label == "NP":
        nouns = [i for i, k in enumerate(kids) if k.startswith("NN") or k in ("NX", "POS", "JJR")]
        if nouns:
            return nouns[-1]
        if "NP" in kids:
            return kids.index("NP")
    for way, wanted in rules.get(label, ()):
        order = range(len(kids)) if way == "left-to-right" else range(len(kids) - 1, -1, -1)
        for w in wanted:
            for i in order:
                if kids[i] == w:
                    return i
    for way, _ in rules.get(label, ())[:1]:
        order = range(len(kids)) if way == "left-to-right" else range(len(kids) - 1, -1, -1)
        for i in order:
            word = words[i] if words else None
            if word is None or not all(unicodedata.category(c).startswith("P") for c in word):
                return i
        return order[0]
    return 0


def mark_heads(t: Tree, rules=HEAD_RULES) -> Tree:
    for c in t.children:
        mark_heads(c, rules)
    t.head = head_of(t.label, [c.label for c in t.children], rules, [c.word for c in t.children])
    return t


def terminal_heads(t: Tree, rules=HEAD_RULES) -> list[int]:
    """PRS5: for each word the index of the word it depends on, -1 for the root."""
    mark_heads(t, rules)
    leaves = t.leaves()
    number = {id(x): i for i, x in enumerate(leaves)}
    out = [-1] * len(leaves)

    def lexical(x):
        while x.word is None:
            x = x.children[x.head]
        return number[id(x)]

    def walk(x):
        if x.word is None:
            h = lexical(x)
            for c in x.children:
                k = lexical(c)
                if k != h:
                    out[k] = h
                walk(c)

    walk(t)
    return out


# ---------------------------------------------------------------- PRS6, PRS7
_CHUNKS = {"NP", "VP", "PP", "ADJP", "ADVP", "SBAR", "PRT", "CONJP", "INTJ", "LST", "UCP"}
_PUNCT = re.compile(r"^(?:[.,:;?!()\"']|``|''|-LRB-|-RRB-|\.|:|,)$")


def tree_chunks(t: Tree) -> list[str]:
    """B-/I-/O tags: each phrase keeps the run of words that ends with its head; WH- prefixes go."""
    mark_heads(t)
    leaves = t.leaves()
    number = {id(x): i for i, x in enumerate(leaves)}
    owner: list[tuple[int, str] | None] = [None] * len(leaves)
    count = 0

    def lexical(x):
        while x.word is None:
            x = x.children[x.head]
        return number[id(x)]

    def walk(x, chunk):
        nonlocal count
        if x.word is not None:
            i = number[id(x)]
            owner[i] = None if _PUNCT.match(x.label) or x.label in ("CC",) and chunk and chunk[1] != "NP" else chunk
            return
        kind = x.label.removeprefix("WH")
        if kind in _CHUNKS and not (kind == "VP" and chunk and chunk[1] == "VP"):
            count += 1
            chunk = (count, kind)
        for c in x.children:
            walk(c, chunk)

    def heads(x, out):
        if x.word is None:
            out.append((x.label.removeprefix("WH"), lexical(x)))
            if all(c.word is not None for c in x.children):  # a base phrase stays whole
                out.append((x.label, number[id(x.children[-1])]))
            for c in x.children:
                heads(c, out)
        return out

    walk(t, None)
    keep = {h for _, h in heads(t, [])}
    tags = ["O"] * len(leaves)
    for i in range(len(leaves) - 1, -1, -1):  # right to left: words behind a phrase's head leave it
        if owner[i] is None:
            continue
        nxt = owner[i + 1] if i + 1 < len(leaves) and tags[i + 1] != "O" else None
        if i in keep or nxt == owner[i]:
            tags[i] = owner[i][1]
    out, prev = [], None
    for i, tag in enumerate(tags):
        if tag == "O":
            out.append("O")
            prev = None
        else:
            out.append(("I-" if prev == owner[i] else "B-") + tag)
            prev = owner[i]
    return out


def chunk_dependencies(tags: list[str], heads: list[int]) -> list[int | None]:
    """PRS7: for each chunk the chunk its head word depends on (null: the root or no chunk)."""
    chunk, n = [], -1
    for t in tags:
        n += t.startswith("B-")
        chunk.append(n if t != "O" else None)
    out: list[int | None] = [None] * (n + 1)
    for i, h in enumerate(heads):
        c = chunk[i]
        while h >= 0 and c is not None and chunk[h] is None:
            h = heads[h]
        if c is not None and h >= 0 and chunk[h] != c:
            out[c] = chunk[h]
    return out


# ---------------------------------------------------------------- PRS1, CFG1, SRC25
def read_grammar(text: str) -> dict[str, list[tuple[str, ...]]]:
    """SRC25: ``S -> NP VP | ...`` lines."""
    out: dict[str, list[tuple[str, ...]]] = {}
    for line in text.splitlines():
        if "->" in line and not line.lstrip().startswith("//"):
            left, right = line.split("->", 1)
            out.setdefault(left.strip(), []).extend(tuple(x.split()) for x in right.rstrip(" ;").split("|") if x.split())
    return out


def chart_parse(grammar: dict[str, list[tuple[str, ...]]], words: list[str], categories: dict[str, list[str]], goal: str) -> list[Tree]:
    """PRS1: all parses by a bottom-up chart; unary cycles count once."""
    n = len(words)
    chart: dict[tuple[int, int], dict[str, list[Tree]]] = {}
    by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
    for left, rights in grammar.items():
        for r in rights:
            by_first.setdefault(r[0], []).append((left, r))
    agenda = deque()
    for i, w in enumerate(words):
        for c in [*categories.get(w, []), w]:
            agenda.append((i, i + 1, Tree(c, word=w)))
    active: dict[int, list[tuple[int, str, tuple[str, ...], list[Tree]]]] = {}
    seen: set[tuple[int, int, str]] = set()
    while agenda:
        i, j, t = agenda.popleft()
        mark = (i, j, t.show())
        if mark in seen or t.show().count("(") > 4 * n + 8:
            continue
        seen.add(mark)
        chart.setdefault((i, j), {}).setdefault(t.label, []).append(t)
        starts = [(i, left, r, []) for left, r in by_first.get(t.label, ())]
        for s, left, r, kids in [*starts, *[a for a in active.get(i, ()) if a[2][0] == t.label]]:
            rest, now = r[1:], [*kids, t]
            if rest:
                active.setdefault(j, []).append((s, left, rest, now))
                for (a, b), cells in list(chart.items()):
                    if a == j:
                        for t2 in cells.get(rest[0], ()):
                            if len(rest) == 1:
                                agenda.append((s, b, Tree(left, [*now, t2])))
                            else:
                                active.setdefault(b, []).append((s, left, rest[1:], [*now, t2]))
            else:
                agenda.append((s, j, Tree(left, now)))
    found = {t.show(): t for t in chart.get((0, n), {}).get(goal, [])}
    return list(found.values())


def recognize(grammar, words, categories, goal) -> bool:
    """PRS1."""
    return bool(chart_parse(grammar, words, categories, goal))


# ---------------------------------------------------------------- PRS11-PRS14
def add_inverses(edges: DataFrame) -> DataFrame:
    """PRS11: each edge and its inverse (label-1)."""
    back = edges.select("doc_id", F.col("dst").alias("src"), F.concat("label", F.lit("-1")).alias("label"), F.col("src").alias("dst"))
    return edges.select("doc_id", "src", "label", "dst").unionByName(back).distinct()


def shortest_path(edges: list[tuple[int, str, int]], a: int, b: int, radius: int = 4, avoid: frozenset[int] = frozenset()) -> str | None:
    """PRS12: labels of the shortest path, ``:`` between; inverse steps end in -1; null beyond the radius."""
    nxt: dict[int, list[tuple[str, int]]] = {}
    for s, label, d in edges:
        nxt.setdefault(s, []).append((label, d))
        nxt.setdefault(d, []).append((label + "-1", s))
    queue, seen = deque([(a, [])]), {a}
    while queue:
        p, labels = queue.popleft()
        if p == b:
            return ":".join(labels)
        if len(labels) == radius or (p != a and p in avoid):
            continue
        for label, d in sorted(nxt.get(p, [])):
            if d not in seen:
                seen.add(d)
                queue.append((d, [*labels, label]))
    return None


def lemmatize_path(path: str, lemma: dict[str, str]) -> str:
    """PRS13: words of a path (at odd places) as lemmas."""
    parts = path.split(":")
    return ":".join(lemma.get(x.lower(), x.lower()) if i % 2 else x for i, x in enumerate(parts))


def reduce_conjunction(path: str) -> str:
    """PRS13: a step through a conjunction and the word behind it goes."""
    return re.sub(r"(?:^|(?<=:))conj(?:-1)?:[^:]+:", "", path)


def transform_dependencies(edges: list[tuple[int, str, int]], words: list[str]) -> list[tuple[int, str, int]]:
    """PRS3: passive subjects as objects, agents as subjects, prep + pobj as prep_x, relative words as their nouns."""
    by_dst = {d: (s, l) for s, l, d in edges}
    pobj = {s: d for s, l, d in edges if l == "pobj"}
    out = []
    for s, label, d in edges:
        if label == "nsubjpass":
            out.append((s, "dobj", d))
        elif label == "agent" and d in pobj:
            out.append((s, "nsubj", pobj[d]))
        elif label == "prep" and d in pobj:
            out.append((s, f"prep_{words[d].lower()}", pobj[d]))
        elif label == "pobj" and by_dst.get(s, (0, ""))[1] in ("prep", "agent"):
            continue
        elif words[d].lower() in ("who", "which", "that") and by_dst.get(s, (0, ""))[1] == "rcmod":
            out.append((s, label, by_dst[s][0]))
        else:
            out.append((s, label, d))
    return out


def score_dependencies(response: DataFrame, key: DataFrame) -> DataFrame:
    """PRS14: precision and recall of edge sets."""
    from .scoring import set_scores

    cols = ["doc_id", "src", "label", "dst"]
    return set_scores(response.select(*cols), key.select(*cols))


def parse_table(sentences: DataFrame, column: str = "ptb") -> DataFrame:
    """SRC12/PRS4-7 over a table: id, words, head of each word, chunk tags, chunk dependencies."""
    kind = dict(sentences.dtypes)["sent_id"]

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in read_trees(x or ""):
                    heads, tags = terminal_heads(t), tree_chunks(t)
                    rows.append((d, [l.word for l in t.leaves()], heads, tags, chunk_dependencies(tags, heads)))
            types = [b.schema.field(0).type, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["sent_id", "words", "heads", "chunks", "chunk_heads"])

    return map_batches(sentences.select("sent_id", column), run, f"sent_id {kind}, words array<string>, heads array<int>, chunks array<string>, chunk_heads array<int>")
