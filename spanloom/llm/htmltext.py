"""Main text of web pages with a site style tree.

The DOMs of all pages of a host are merged into one tree of *style nodes* (the
path of block tags with their class or id), whatever they are called and wherever
they stand.  A node's importance is a product of

* two entropies over the host's distinct pages, of its presentation (the child
  tags it shows) and of its content (its text), joined: boilerplate looks and reads
  alike on every page.  They are drawn towards 1 as if ``UNSEEN`` more pages had
  differed, so a node of few pages isn't judged by them;
* ``mass ** k``, its mean share of a page's text to the power of what speaks
  against it beforehand: k is 0 for a plain node, and grows by ``SOFT`` for a class
  or id that names boilerplate and for standing outside the page's ``article`` or
  ``main``, by ``STRONG`` for tags, roles and labels of menus, footers, asides,
  forms and reader comments.  So a label alone cuts nothing: what holds most of the
  site's text stays, whatever it is called.

Branches of low importance are cut from each page; only scripts, styles and what
is hidden or never shown go unmeasured.

``html``, ``body``, ``article``, ``main`` and their own paragraphs and headings
are one style node on every page, so there each content is a node of its own:
its importance falls with the share of the host's distinct texts that hold it.
Pages of one text count once, as a host may well hold one text many times over.

The tree is built by ordinary aggregation: a row for each distinct page with its
nodes, pre-aggregated counts per (host, path, feature), then one row per (host,
path); a host with a third of all pages spreads over features before it meets.
What goes back to the pages are only verdicts that differ from what a page would
decide by itself, broadcast behind a check of their size, joined otherwise.

Cases: null html gives the empty text; a null or odd url is the host "";
broken, unclosed or cut-off markup is read as a browser would, as far as it
goes, in linear time; repeated pages count once in the tree and each keep their
row; columns besides ``keep``, url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

MIN_IMPORTANCE, PRESENTATION, UNSEEN = 0.2, 0.3, 0.7
SOFT, STRONG, GONE = 2, 6, 99
#: verdicts up to this size are broadcast
BROADCAST_BYTES = 16 << 20

_NAME, _TAG_END, _COMMENT_END = re.compile(r"[a-zA-Z][^\s/>\x00]*"), re.compile(r"""[>"']"""), re.compile(r"--!?>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var img br wbr nobr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
_NEVER_SHOWN = frozenset("head script style noscript template iframe object svg math canvas audio video select button dialog map textarea title".split())
_BY_TAG = frozenset("nav footer aside form menu".split())
_LABEL = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|signup|login|nav|navbar|navigation|menu\w*|breadcrumbs?|toolbar|sidebar|side|widget|related|recommend\w*|share|sharing|social|footer|foot|masthead|topbar|header|comments?|commentlist|replies|reply|respond|disqus|pagination|pager|search|skip|disclaimer)(?:$|[\s_-])",
    re.I,
)
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|disqus|sidebar|related)(?:$|[\s_-])", re.I)
_RESERVED = re.compile(r"[/^=~]")
_UNSEEN_STYLE, _STRONG_STEP = re.compile(r"display\s*:\s*none", re.I), re.compile(rf"/~{STRONG}")
_FIXED = re.compile(r"(?:/(?:html|body|article|main)(?:[.#][^/]*)?)*(?:/(?:p|h[1-6]))?")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(text)} if text and not text.isspace() else {}


def tags(html: str):
    """(start, end, closing, name, attributes) of each tag; name "" for comments and the like, None for a tag that the text's end cuts off.

    Every sign is looked at a bounded number of times, whatever the markup.
    """
    at, last_quote = 0, {q: html.rfind(q) for q in "\"'"}
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        sign = html[at : at + 1]
        if sign in ("!", "?"):
            if html.startswith("!--", at):
                if html.startswith((">", "->"), at + 3):
                    end = html.find(">", at + 3) + 1
                else:
                    m = _COMMENT_END.search(html, at + 3)
                    end = m.end() if m else 0
            else:
                end = html.find(">", at) + 1
            yield (start, end or len(html), False, "" if end else None, "")
            at = end or len(html)
            continue
        closing = sign == "/"
        m = _NAME.match(html, at + closing)
        if not m:
            if closing and (end := html.find(">", at) + 1):
                yield start, end, True, "", ""
                at = end
            continue
        at = m.end()
        while True:
            e = _TAG_END.search(html, at)
            if not e:
                yield start, len(html), closing, None, ""
                return
            at = e.end()
            if e[0] == ">":
                break
            if last_quote[e[0]] >= at:  # else no quote closes it, and it is a sign as others
                at = html.find(e[0], at) + 1
        yield start, at, closing, m[0].lower(), html[m.end() : at - 1]


def blocks(html: str) -> list[tuple[str, str, bool, str]]:
    """(path, tag, in the main part, text) of each text block that is shown, in page order.

    A path's steps that something speaks against beforehand begin with ``~`` and
    how much: ``~2div.ad``.  ``tag`` is the block that the text stands in.
    """
    out: list[tuple[str, str, bool, str]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path so far, gone, in main
    parts: list[str] = []
    n, where = len(html), ("", "", False)

    def flush():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((*where, text))
            parts.clear()

    def add(a, b):
        nonlocal where
        if b > a and not (stack and stack[-1][2]):
            if not parts:
                where = (stack[-1][1], stack[-1][0], stack[-1][3]) if stack else ("", "", False)
            parts.append(html[a:b])

    def close_to(depth):
        del stack[depth:]

    at, found = 0, tags(html)
    for start, end, closing, tag, attributes in found:
        if start < at:  # inside a script and the like
            continue
        add(at, start)
        at = end
        if not tag:
            continue
        if closing:
            if tag == "br":
                if parts:
                    parts.append(" ")
                continue
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    if tag not in _INLINE or stack[d][2] or stack[d][1] != (stack[d - 1][1] if d else ""):
                        flush()
                    close_to(d)
                    break
                if tag in _INLINE and stack[d][0] not in _INLINE:
                    break  # an inline end tag does not close blocks
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                flush()
            elif parts and tag == "br":
                parts.append(" ")
            continue
        block = tag not in _INLINE
        if block:
            flush()
            if tag in _CLOSES_P or tag == "p":
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == "p":
                        close_to(d)
                        break
                    if stack[d][0] not in _INLINE:
                        break
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == tag:
                        close_to(d)
                        break
                    if stack[d][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body"):
                        break
        attrs = _attributes(attributes)
        above = stack[-1] if stack else ("", "", False, False)
        against, gone, main = 0, above[2], above[3]
        label = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
        if not gone:
            if tag in _NEVER_SHOWN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _UNSEEN_STYLE.search(attrs.get("style", "")):
                gone = True
            else:
                named = len(label) > 1 and tag not in ("body", "html")
                if tag in _BY_TAG or attrs.get("role") in _ROLES or named and _READERS.search(label):
                    against = STRONG
                elif named and tag not in ("article", "main") and _LABEL.search(label) or tag == "header" and not main:
                    against = SOFT
                if (tag in ("article", "main") or attrs.get("role") == "main") and against < STRONG and not _STRONG_STEP.search(above[1]):
                    main = True
        if gone and not above[2] or against and not block:
            flush()
        name = tag + ("." + ".".join(sorted(attrs["class"].split())) if attrs.get("class", "").strip() else "#" + re.sub(r"\d+", "0", attrs["id"]) if attrs.get("id") else "")
        if block or against:
            stack.append((tag, f"{above[1]}/{f'~{against}' if against else ''}{_RESERVED.sub('|', name)}", gone, main))
        else:
            stack.append((tag, above[1], gone, main))
        if raw := _RAW_END.get(tag):
            e = raw.search(html, at)
            stack.pop()
            if not e:
                at = n
                break
            at = html.find(">", e.start()) + 1 or n
    add(at, n)
    flush()
    return out


def _branches(path: str):
    """The path and all branches it hangs on."""
    names = path.split("/")
    return ["/".join(names[:k]) for k in range(2, len(names) + 1)]


def _fixed(path: str) -> bool:
    return bool(_FIXED.fullmatch(path))


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _content(path: str, text: str) -> str:
    """Node of one content of a fixed path."""
    return f"{path}={_digest(text):x}"


class Page:
    """Text blocks of a page, and the style nodes that each hangs on.

    A node's name ends with ``^`` and how much speaks against it in this place, if
    anything does: what its own step says, and SOFT more for the outermost branch
    outside the main part of a page that has one.
    """

    def __init__(self, html: str):
        self.found = blocks(html)
        lanes: dict[tuple[str, bool], list[str]] = {}
        inner = {b for p, _, main, _ in self.found if main for b in _branches(p)}
        self.nodes = []
        for path, _, main, text in self.found:
            outside = bool(inner) and not main
            lane = lanes.get((path, outside))
            if lane is None:
                lane, out = [], outside
                for b in _branches(path) or [""]:
                    step = b[b.rfind("/") + 1 :]
                    k = int(step[1]) if step[:1] == "~" else 0
                    if out and b not in inner:
                        k, out = k + SOFT, False
                    if k or not _fixed(b):
                        lane.append(f"{b}^{k}" if k else b)
                if out:  # text of its own beside the main part, in a branch that holds it
                    lane.append(f"{path}^{SOFT}")
                lanes[path, outside] = lane
            self.nodes.append([*lane, _content(path, text)] if _fixed(path) else lane)

    def measured(self) -> tuple[list, int]:
        """((node, presentation, content, share of the page's text) of each node, digest of the page's main texts)."""
        total = sum(len(x[3]) for x in self.found) or 1
        shapes: dict[str, list[str]] = {}
        words: dict[str, list[str]] = {}
        for (path, tag, _, text), lane in zip(self.found, self.nodes):
            for b in lane:
                shape = shapes.setdefault(b, [])
                if not shape or shape[-1] != tag:
                    shape.append(tag)
                words.setdefault(b, []).append(text)
        out = [(b, _digest("/".join(shapes[b])), _digest("\n".join(w)), sum(map(len, w)) / total) if "=" not in b else (b, None, None, None) for b, w in words.items()]
        return out, _digest("\n".join([x[3] for x in self.found if x[2]] or [x[3] for x in self.found]))

    def main_text(self, verdicts: dict[str, bool]) -> str:
        """The texts that stay: ``verdicts`` has measured nodes, true if they are cut; one without a verdict goes if anything speaks against it."""
        known = {}

        def cut(b):
            hit = known.get(b)
            if hit is None:
                hit = known[b] = verdicts.get(b, "^" in b and "=" not in b)
            return hit

        return "\n\n".join([x[3] for x, lane in zip(self.found, self.nodes) if not any(map(cut, lane))])


def _verdicts(paths) -> dict[str, bool]:
    """Measured nodes, true if cut, of their names marked - or +."""
    return {p[1:]: p[0] == "-" for p in paths or ()}


NODES = "array<struct<path:string,shape:long,words:long,share:double>>"


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, importance) of the style nodes over each host's distinct pages, and of contents of fixed paths that several texts hold."""

    def nodes(batches):
        import pyarrow as pa

        item = pa.list_(pa.struct([("path", pa.string()), ("shape", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))
        for b in batches:
            rows = []
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h:
                    found, whole = Page(h).measured()
                    rows.append((host_of(u), _digest(h), whole, [dict(zip(("path", "shape", "words", "share"), x)) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), item))], names=["host", "page", "whole", "nodes"])

    seen = pages.select(url_col, html_col).mapInArrow(nodes, f"host string, page long, whole long, nodes {NODES}")
    seen = seen.groupBy("host", "page").agg(F.first("whole").alias("whole"), F.first("nodes").alias("nodes"))  # equal pages, equal nodes
    each = seen.select("host", "whole", F.explode("nodes").alias("x")).select("host", "whole", "x.*")
    kinds = each.where("words IS NOT NULL").select("host", "path", "share", F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("shape").alias("f")), F.struct(F.lit("w").alias("kind"), F.col("words").alias("f")))).alias("x")).select("host", "path", "share", "x.*")
    counts = kinds.groupBy("host", "path", "kind", "f").agg(F.count("*").alias("c"), F.sum("share").alias("share"))
    entropy = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.sum("share").alias("share"))
    even = F.when(F.col("n") > 1, (F.log("n") - F.col("cl") / F.col("n")) / F.log("n")).otherwise(1.0)
    weight = F.when(F.col("kind") == "s", PRESENTATION).otherwise(1 - PRESENTATION)
    joined = entropy.groupBy("host", "path").agg(F.max("n").alias("pages"), F.sum(even * weight).alias("e"), F.max(F.col("share") / F.col("n")).alias("mass"))
    against = F.coalesce(F.regexp_extract("path", r"\^(\d+)$", 1).try_cast("int"), F.lit(0))
    drawn = (F.col("e") * F.col("pages") + UNSEEN) / (F.col("pages") + UNSEEN)
    styles = joined.select("host", "path", "pages", (drawn * F.pow(F.least("mass", F.lit(1.0)), against)).alias("importance"))
    # contents: once for each text of the host, by page and content
    own = each.where("words IS NULL").select("host", "whole", "path").distinct()
    texts = own.select("host", "whole").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    shared = own.groupBy("host", "path").agg(F.count("*").alias("c")).where("c > 1")
    alike = 1 - F.log("c") / F.log("pages")
    contents = shared.join(texts, "host").select("host", "path", "pages", ((alike * F.col("pages") + UNSEEN) / (F.col("pages") + UNSEEN)).alias("importance"))
    return styles.unionByName(contents)


def main_text(pages: DataFrame, keep=("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` columns of every page, ``text`` and ``n_chars`` (code points)."""
    settle(pages.sparkSession)
    low = F.col("importance") < MIN_IMPORTANCE
    # pages know by themselves that plain nodes stay and others go
    news = style_tree(pages, url_col, html_col).where(low != F.col("path").rlike(r"\^\d+$"))
    cuts = news.groupBy("host").agg(F.sort_array(F.collect_list(F.concat(F.when(low, "-").otherwise("+"), "path"))).alias("cut_paths")).persist()
    size = cuts.agg(F.sum(F.length(F.to_json(F.struct("host", "cut_paths"))))).first()[0] or 0
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long"
    small = {r.host: _verdicts(r.cut_paths) for r in cuts.collect()} if size <= BROADCAST_BYTES else None
    cols = [*keep, url_col, html_col]
    rows = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    if small is None:  # too large to send everywhere: join by host
        host = F.lower(F.coalesce(F.regexp_extract(f"c{len(keep)}", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
        rows = rows.withColumn("host", host).join(cuts, "host", "left").drop("host")
    k = len(keep)

    def texts(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            joined = b.column(k + 2).to_pylist() if small is None else None
            for i, (u, h) in enumerate(zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist())):
                tree = small.get(host_of(u), {}) if joined is None else _verdicts(joined[i])
                out.append(Page(h).main_text(tree) if h else "")
            names = [*keep, "text", "n_chars"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=names)

    out = rows.mapInArrow(texts, schema)
    cuts.unpersist()
    return out


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
