"""HTML extraction and media columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import pytest

from spanloom.llm import htmltext, media

from .conftest import prose


def page(rng, k, host="a.example"):
    body = "".join(f"<p>{prose(rng, 20)} &amp; <b>bold</b>\n text</p>" for _ in range(3))
    return f"""<!DOCTYPE html><html><head><title>t{k}</title><script>var x = "<p>no</p>";</script><style>p {{}}</style></head><body>
<div id="top-1" class="zq"><p>Welcome to our site</p></div><nav><ul><li>Home<li>About</ul></nav>
<article><h1>Head {k}</h1>{body}<aside>see also</aside></article>
<div class="comments"><p>first!</p></div><div class="zr"><p>All rights reserved</p></div><footer>foot</footer></body></html>"""


def test_labels_and_tree_cut_boilerplate(spark):
    rng = random.Random(1)
    rows = [(k, "http://a.example/x", page(rng, k)) for k in range(12)]
    out = {r.page_id: r for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        text = out[k].text
        assert text.startswith(f"Head {k}\n\n") and text.count("\n\n") == 3 and text.count(" & bold text") == 3
        for word in ("Welcome", "Home", "first!", "rights", "foot", "see also", "no<", "var x"):
            assert word not in text
        assert out[k].n_chars == len(text)


def test_pages_without_marks_use_the_style_tree(spark):
    rng = random.Random(2)
    bare = [(k, "http://b.example/", f"<html><body><div class='q1'><p>Same words on all pages</p></div><div class='q2'><p>{prose(rng, 25)}</p><p>{prose(rng, 9)}</p></div></body></html>") for k in range(10)]
    out = htmltext.main_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()
    assert all("Same words" not in r.text and r.text for r in out)


def test_tree_measures_articles_and_what_stands_outside(spark):
    rng = random.Random(4)
    notice, made = "This text is for members of our readers' club.", {}
    for host, n in (("c.example", 12), ("d.example", 4), ("e.example", 1)):
        for k in range(n):
            made[len(made)] = (host, prose(rng, 12), prose(rng, 60), prose(rng, 9))
    page_of = lambda lead, body, last: f"<html><body><div class='q1'>{lead}</div><div class='q2'>Same on all pages</div><article><p>{body}</p><p>{notice}</p></article><p>{last}</p><nav>{body[:9]}</nav></body></html>"
    rows = [(k, f"http://{host}/{k}", page_of(*x)) for k, (host, *x) in made.items()]
    rows += [(100 + k, f"http://f.example/{k}", f"<html><body><article><p>One text many times</p></article><div>{prose(rng, 1)}</div></body></html>") for k in range(10)]
    out = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (host, lead, body, last) in made.items():  # a text that all of a host's articles hold goes; one page says nothing of it
        assert out[k] == ("\n\n".join((body, notice)) if host == "e.example" else body)
    assert all(out[100 + k] == "One text many times" for k in range(10))


def scrambled(rng, k, names):
    a, b, c, d, e = names
    said = "".join(f"<div class='{e}'><i>{rng.choice(['Ann', 'Bo'])}</i> {prose(rng, 5)}</div>" for _ in range(2))
    body = "".join(f"<p>{prose(rng, 30)}</p>" for _ in range(3))
    return body, f"<html><body><div class='{a}'><ul><li>Home</li><li>News</li><li>Help</li></ul></div><div class='{b}'>We keep your data safe, read how.</div><article class='{c}'><h1>T{k} {prose(rng, 3)}</h1>{body}</article><div class='{d}'>{said}</div></body></html>"


def test_names_may_be_anything(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("bcdfgklmz") for _ in range(6)) for _ in range(5)]
    made = [scrambled(rng, k, names) for k in range(15)]
    rows = [(k, "http://s.example/", html) for k, (_, html) in enumerate(made)]
    out = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (body, _) in enumerate(made):
        assert out[k].startswith(f"T{k} ") and out[k].split("\n\n")[1:] == re.findall("<p>(.*?)</p>", body)


def test_a_label_alone_cuts_nothing(spark):
    rng = random.Random(7)
    rows = [(k, "http://n.example/", f"<body><div class='menu'>Home News {k}</div><div class='notice'><p>{prose(rng, 50)}</p><p>{prose(rng, 40)}</p></div></body>") for k in range(6)]
    out = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k].count("\n\n") == 1 and "Home" not in out[k] for k in out)


def plain_tree(rows):
    """Importance of each (host, node), counted page by page."""
    pages = {(htmltext.host_of(u), h) for _, u, h in rows if h}
    seen, texts = {}, {}
    for host, h in pages:
        found, whole = htmltext.Page(h).measured()
        for node, shape, words, share in found:
            if words is None:
                texts.setdefault(host, set()).add(whole)
                seen.setdefault((host, node), []).append((whole,))
            else:
                seen.setdefault((host, node), []).append((shape, words, share))
    out = {}
    for (host, node), x in seen.items():
        if len(x[0]) == 1:
            n, c = len(texts[host]), len(set(x))
            if c > 1:
                out[host, node] = ((1 - math.log(c) / math.log(n)) * n + htmltext.UNSEEN) / (n + htmltext.UNSEEN)
            continue
        n = len(x)
        entropy = [-sum(c / n * math.log(c / n) for c in Counter(y[i] for y in x).values()) / math.log(n) if n > 1 else 1.0 for i in (0, 1)]
        e = htmltext.PRESENTATION * entropy[0] + (1 - htmltext.PRESENTATION) * entropy[1]
        k = int(node.rsplit("^", 1)[1]) if "^" in node else 0
        out[host, node] = (e * n + htmltext.UNSEEN) / (n + htmltext.UNSEEN) * min(1.0, sum(y[2] for y in x) / n) ** k
    return out


def test_query_equals_plain_counting(spark, tmp_path):
    rng = random.Random(9)
    names = [f"k{i}" for i in range(5)]
    rows = [(k, f"http://h{k % 3}.example/{k}", scrambled(rng, k, names)[1] if k % 4 else page(rng, k)) for k in range(24)]
    rows += [(50, "http://h1.example/", rows[5][2]), (51, None, rows[5][2]), (52, "http://h1.example/", None), (53, "http://h2.example/", "<p>alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_tree(rows)
    got = {(r.host, r.path): r.importance for r in htmltext.style_tree(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r.text for r in htmltext.op7_html(spark, str(tmp_path)).collect()}
    for k, u, h in rows:
        kept = []
        if h:
            p = htmltext.Page(h)
            for block, nodes in zip(p.found, p.nodes):
                low = [want.get((htmltext.host_of(u), x)) for x in nodes]
                if not any(v is not None and v < htmltext.MIN_IMPORTANCE for v in low):
                    kept.append(block[3])
        assert out[k] == "\n\n".join(kept)


@pytest.mark.parametrize("bad", ["<a " * 300_000, "<" * 400_000, "<!--" * 200_000, "</" * 200_000, "<a x='" * 100_000, "<a x=\"" * 100_001, "<script>" * 100_000, "<p " + "q" * 900_000, "<img " * 200_000])
def test_hostile_markup_takes_linear_time(bad):
    begun = time.process_time()
    htmltext.Page(bad).main_text({})
    media.sequence_of(bad)
    assert time.process_time() - begun < 20


def test_join_path_equals_broadcast_path(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, f"http://h{k % 2}.example/", f"<div class='q1'>Same words</div><div class='q2'><p>{prose(rng, 25)}</p></div>") for k in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, htmltext.main_text(df).collect()))
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, htmltext.main_text(df).collect())) == want


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b</p>", "a b"), ("<div>x<span>y</span>z</div>", "xyz"),
        ("<p>cut <b", "cut"), ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<p>\xa0 &nbsp; </p>", ""), ("<article>m</article><p>other</p>", "m"), ("<p hidden>no</p><p>x</p>", "x"), ("<p>5 < 6</p>", "5 < 6"),
    ],
)
def test_markup(html, text):
    assert htmltext.Page(html or "").main_text({}) == text


def test_html_query_keeps_every_row(spark, tmp_path):
    rows = [(1, None, None, "x"), (1, "u", "<p>a</p>", "x"), (2, "u", "<p>a</p>", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    out = htmltext.op7_html(spark, str(tmp_path))
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, "", 0), (1, "a", 1), (2, "a", 1)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert htmltext.op7_html(spark, f"{tmp_path}/e").count() == 0


# ---------------------------------------------------------------- media
def test_signs_inside_quotes_and_names_that_clash(spark):
    seq = media.sequence_of("<img alt=\"a > b\" src='sha256:x'><!-- <img src=no> --><script>'<img src=no>'</script><p>t</p>")
    assert [(x["kind"], x["digest"] or x["text"]) for x in seq] == [("media", "x"), ("text", "t")]
    pages = spark.createDataFrame([(1, "k", "<img src=aa>")], "page_id long, kind string, html string")
    store = spark.createDataFrame([("aa", 5)], "digest string, width int")
    out = media.resolve(media.interleave(pages, ("page_id", "kind")), store)
    assert out.columns == ["page_id", "kind", "position", "kind_", "text", "digest", "caption", "width"] and out.first().kind == "k"


def test_copies_are_stored_once(spark):
    docs = spark.createDataFrame([("same",)] * 50 + [("other",)], "text string").repartition(3)
    assert media.read_store(media.store_payloads(docs)).count() == 2
    assert media.store_payloads(docs).count() <= 2 * 3


def test_media_query_equals_plain_computation(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in media.op8_media(spark, sf_dir).collect()}
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        png = media.to_png(full, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == media.feature_of(media.from_png(png)[0])
        assert (r.position, r.caption) == (1, f"Text of document {i}")


def test_png_is_readable_and_damage_is_seen():
    payload = media.pad(b"abc" * 1000)
    png = media.to_png(payload, 3000)
    samples, n = media.from_png(png)
    assert n == 3000 and samples.tobytes() == payload and struct.unpack(">II", png[16:24]) == (576, len(payload) // 576)
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(png[:-20] + b"x" + png[-19:])
    with pytest.raises(ValueError, match="not a PNG"):
        media.from_png(b"GIF")


def test_sequences_keep_positions_and_captions(spark):
    html = "<h1>T</h1><p>one</p><figure><img src='sha256:aa'><img src=\"bb\"><figcaption>cap &amp; co</figcaption></figure><p>two <img src=cc> three</p><img>"
    seq = media.sequence_of(html)
    assert [(x["position"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in seq] == [(0, "text", "T", None), (1, "text", "one", None), (2, "media", "aa", "cap & co"), (3, "media", "bb", "cap & co"), (4, "text", "two", None), (5, "media", "cc", None), (6, "text", "three", None), (7, "media", "", None)]
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("aa", 1), ("zz", 2)], "digest string, width int")
    out = media.resolve(media.interleave(pages), store).orderBy("position").collect()
    assert [r.width for r in out] == [None, None, 1, None, None, None, None, None] and len(out) == 8
    assert media.interleave(pages.limit(0)).count() == 0
