"""WARC archives and main text of pages: contracts, round trips and awkward cases."""

import base64
import gzip
import hashlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from readtrim.llm import html_template, queries, warc

SF = "/root/testdata/sf0.001"
BIG = "<p>" + "long text with ü and 中 " * 20_000 + "</p>"
ROWS = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://a.example/4\r\nX: y", ""), (5, "http://b.example", None),
    (6, "http://b.example/6", BIG), (7, "http://b.example/7", BIG), (8, "http://b.example/8", BIG + "x"), (9, "http://b.example/9", "WARC/1.1\r\n\r\n0\r\n\r\n"),
    (10, "http://ü.example/", "unique"), (None, "http://c.example", "<p>one</p>"), (None, "http://c.example", "only null"), (11, "u", "twice"), (11, "u", "twice"),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(4)
    return df.select("*", *[F.lit("own").alias(c) for c in ("payload", "digest", "status", "type", "length", "block", "host", "text", "n", "token", "refers_to")]).cache()


def expected_rows(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    for i, _, html in rows:
        raw = (html or "").encode()
        largest = max((x for x in groups[raw] if x is not None), default=None)
        refers = largest if largest is not None and i != largest else None
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers


def test_archives_round_trip(pages):
    got = sorted(map(tuple, warc.page_rows(pages).collect()), key=str)
    assert got == sorted(expected_rows(ROWS), key=str)
    back = warc.archive_and_read(pages).where("record_type = 'response' and page_id = 7").collect()
    assert [bytes(r.payload).decode() for r in back] == [BIG] and {r.status for r in back} == {"ok"}
    assert warc.page_rows(pages.where("false")).count() == 0


def test_sql_agrees_on_the_small_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    cur = con.execute(warc.SQL)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    got = queries.QUERIES["op1_warc_segments"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_archives_are_readable_by_any_gzip_reader(spark, tmp_path, pages):
    folder = f"file://{tmp_path}/arc"
    manifest = warc.write(warc.with_revisits(pages.where("page_id in (6, 7)")), folder, archive=1 << 16).collect()
    assert len(manifest) >= 1 and sum(m.records for m in manifest) > 2
    types = []
    for m in manifest:
        raw = open(m.path, "rb").read()
        assert len(raw) == m.bytes
        types += [h["warc-type"] for h, _ in warc.parse(io.BytesIO(gzip.decompress(raw)))]
    assert types.count("revisit") == 1 and types.count("response") == 1 and types.count("continuation") > 3


def segment(origin, number, block, total=None, **head):
    base = {"type": "response" if number == 1 else "continuation", "page_id": "1" if number == 1 else None, "url": None, "digest": None, "refers_to": None, "length": None}
    return {"origin": origin, "number": number, "total": total, **base, **head, "block": block}


def test_reassembly_tells_what_is_wrong(spark):
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    a, b, c = body[:30], body[30:60], body[60:]
    n = len(body)
    rows = [
        segment("ok", 2, bytearray(b)), segment("ok", 3, bytearray(c), n), segment("ok", 1, bytearray(a)), segment("ok", 2, bytearray(b)),
        segment("gap", 1, bytearray(a)), segment("gap", 3, bytearray(c), n),
        segment("short", 1, bytearray(a)), segment("short", 2, bytearray(b), n),
        segment("conflict", 1, bytearray(a)), segment("conflict", 2, bytearray(b)), segment("conflict", 2, bytearray(c), n),
        segment("headless", 2, bytearray(b)), segment("headless", 3, bytearray(c), n),
        segment("open", 1, bytearray(a)), segment("open", 2, bytearray(b)),
        segment("chunks", 1, bytearray(a)), segment("chunks", 2, bytearray(b[:20]), 50),
    ]
    df = spark.createDataFrame(rows, warc._RAW.replace("block binary", "block binary")).withColumn("page_id", F.col("origin"))
    got = {r.page_id: (r.status, r.payload) for r in warc.decode(warc.reassemble(df)).collect()}
    assert got["ok"] == ("ok", b"hello world")
    assert {k: v[0] for k, v in got.items() if k != "ok"} == {
        "gap": "missing segment", "short": "wrong length", "conflict": "conflict", "headless": "missing segment", "open": "missing segment", "chunks": "bad chunks"
    }
    assert all(v[1] is None for k, v in got.items() if k != "ok")


@pytest.mark.parametrize("body", [b"", b"x", b"a" * 8192, b"\r\n0\r\n\r\n" * 50])
def test_chunked_framing(body):
    for size in (1, 7, 8192):
        assert warc.unchunked(warc.chunked(body, size)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n", b"3\r\nabc\r\n0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


# ---------------------------------------------------------------- main text


def page(body, title="T"):
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:y}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        f'<div class="ad">Buy now</div>{body}<footer>&copy; x</footer></body></html>'
    )


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("just  text &amp; more", "just text & more"),
        (page("<article><h1>Head</h1><p>One <b>two</b>\n three&nbsp;four</p><p>Five</article>"), "Head\nOne two three four\nFive"),
        (page('<article><p>Keep</p><aside>no</aside><div class="comments"><p>reader</p></div><form>f</form><p>this</p></article>'), "Keep\nthis"),
        (page('<main><div id="cookie-notice">cookies</div><p>A</p></main>'), "A"),
        (page("<article><p>1 &lt; 2 &#x41;&eacute;</p><!-- <p>no</p> --><ul><li>x<li>y</ul></article>"), "1 < 2 Aé\nx\ny"),
        (page("<article><table><tr><td>a</td><td>b</td></tr></table></article>"), "a b"),
        (page('<article><p>own</p></article><article class="teaser"><p>other</p></article>'), "own"),
        ("<p>a < b</p><p title='>'>c", "a < b\nc"),
    ],
)
def test_main_text(html, text):
    assert html_template.main_text(html or "") == text


def test_template_of_a_host_is_left_out_without_article_markup(spark):
    def plain(k):
        return (
            f'<html><body><div class="top"><div>Daily Paper</div><div>All the news</div></div><div class="c"><div>Story {k} begins</div><div>and goes on {k} times</div></div>'
            f'<div class="low"><div>Imprint</div><div>Contact us</div></div></body></html>'
        )

    rows = [(k, f"http://p.example/{k}", plain(k)) for k in range(8)] + [(100 + k, f"http://single{k}.example/", plain(k)) for k in range(2)]
    got = {r.page_id: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[3].text == "Story 3 begins\nand goes on 3 times" and got[3].template_tokens > 4
    assert got[100].text.startswith("Daily Paper") and got[100].template_tokens == 0  # one page is no template
    copies = [(1000 + k, "http://p.example/copy", plain(99)) for k in range(30)]
    got = {r.page_id: r for r in html_template.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string").repartition(3)).collect()}
    assert {got[1000 + k].text for k in range(30)} == {"Story 99 begins\nand goes on 99 times"} and got[3].text == "Story 3 begins\nand goes on 3 times"


def test_near_copies_on_a_minority_of_a_host_keep_what_they_share(spark):
    """Three pages of fifteen share three paragraphs and differ by a byline; the host's own text still goes."""

    def plain(k):
        own = [f"By author {k}", *(f"Shared paragraph {p}" for p in range(3))] if k < 3 else [f"Story {k} begins", f"and goes on {k} times"]
        story = "".join(f"<div>{x}</div>" for x in own)
        return own, f'<html><body><div class="top"><div>Daily Paper</div><div>All the news</div></div><div class="c">{story}</div><div class="low"><div>Imprint</div></div></body></html>'

    rows = [(k, f"http://p.example/{k}", plain(k)[1]) for k in range(15)]
    got = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {k: "\n".join(plain(k)[0]) for k in range(15)}


def test_vectors_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    hosted = html_template._hosted(pages)
    a = html_template.token_vectors(hosted).select("host", "token", "pages", "total", "vector").collect()
    b = html_template.token_vectors(hosted.repartition(7)).select("host", "token", "pages", "total", "vector").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def plain_templates(rows):
    """Group of hosts -> (tags, content tags, texts), with whole occurrence vectors instead of sums of hashes."""
    from collections import defaultdict
    from urllib.parse import urlsplit

    by_host = defaultdict(set)
    for _, url, html in rows:
        by_host[urlsplit(url or "").netloc.lower()].add(html or "")
    groups = defaultdict(list)
    for host, pages in by_host.items():
        groups[host if len(pages) >= 3 else ""] += [(host, p) for p in sorted(pages)]
    out = {}
    for group, pages in groups.items():
        vectors, where, share, texts = defaultdict(dict), defaultdict(list), defaultdict(list), set()
        for k, (_, html) in enumerate(pages):
            items = html_template.read_page(html)
            for x in items:
                text = isinstance(x, html_template.Block)
                token = html_template._text_token(x) if text else x.token
                vectors[token][k] = vectors[token].get(k, 0) + 1
                where[token, k] = where[token, k] + [x.position / len(items)]
                share[token].append(0.0 if text else float(x.content))
                texts |= {token} if text else set()
        classes = defaultdict(list)
        for token, v in vectors.items():
            if len(v) >= max(3, 0.2 * len(pages)):
                at = sum(sum(where[token, k]) / len(where[token, k]) for k in v) / len(v)
                classes[tuple(sorted(v.items()))].append((at, token))
        found = [(v, sorted(m)) for v, m in classes.items() if len(m) >= 3]
        found.sort(key=lambda c: (-len(c[0]), sum(n for _, n in c[0]), -len(c[1]), c[1][0][1]))
        kept = []
        for v, members in found:
            gap = lambda p, others: sum(1 for q, _ in others if q < p)
            if all(gap(members[0][0], o) == gap(members[-1][0], o) or gap(o[0][0], members) == gap(o[-1][0], members) for _, o in kept):
                kept.append((v, members))
        tags = {t for _, m in kept for _, t in m if t not in texts}
        content = {t for t in tags if sum(share[t]) / len(share[t]) > 0.5}
        out[group] = tags, content, {t for v, m in kept if len(v) > 0.5 * len(pages) for _, t in m if t in texts}
    return {g: t for g, t in out.items() if t[0] or t[2]}


def frame_page(k):
    """Pages of one site: its own frame, an article in it, notices that vary, and on some pages a list of comments."""
    body = "".join(f"<p>Story {k} part {p}</p>" for p in range(1 + k % 4))
    talk = '<div class="comments"><p>reader says</p></div>' if k % 3 == 0 else ""
    return (
        f'<html><body><div class="bar"><div>Daily</div><div>Day {k}</div></div><div class="promo-x">Offer {k}</div><article><h1>T{k}</h1>{body}{talk}</article>'
        f'<div class="tail"><div>More {k}</div><p>Imprint</p></div></body></html>'
    )


def test_templates_against_whole_vectors(spark):
    small = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    made = [(1000 + k, f"http://f.example/{k}", frame_page(k)) for k in range(12)] + [(2000 + k, f"http://one{k}.example/", frame_page(k)) for k in range(4)]
    copies = [(3000 + k, "http://f.example/5", frame_page(5)) for k in range(20)]
    rows = small + made + copies
    hosted = html_template._hosted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    got = {r.host: (set(r.tags), set(r.content), set(r.texts)) for r in html_template.deduced(hosted)[0].collect()}
    assert got == plain_templates(rows) and got["f.example"][1] and got["f.example"][2]


def test_slots_decide_and_elements_only_choose_among_them():
    """What lies behind a tag of the template that isn't content stays out whatever it looks like on this page, and the other way round."""
    tags = {x.token: x for x in html_template.read_page(frame_page(1)) if isinstance(x, html_template.Tag)}
    content = frozenset(t for t, x in tags.items() if x.content)
    whole = html_template.main_text(frame_page(1))
    assert html_template.main_text(frame_page(1), html_template.Template(frozenset(tags), content, frozenset())) == whole == "T1\nStory 1 part 0\nStory 1 part 1"
    other = html_template.Template(frozenset(tags), frozenset(t for t, x in tags.items() if not x.content), frozenset())
    assert "Story" not in html_template.main_text(frame_page(1), other) and "More 1" in html_template.main_text(frame_page(1), other)
    # an article that the template doesn't know still counts
    more = frame_page(1).replace("</body>", "<main><p>second</p></main></body>")
    assert html_template.main_text(more, html_template.Template(frozenset(tags), content, frozenset())) == whole + "\nsecond"


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        text = html_template.main_text("<div>" * n + "<article><p>deep</p>" + "<ul><li>x" * n + "</article>")
        assert text.startswith("deep\nx")
        return time.perf_counter() - began

    seconds(100)
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.02)  # about 1.1 MB; quadratic would be a hundredfold


def test_classes_must_nest():
    outer, inner, crossing = (1, [0.1, 0.9]), (2, [0.3, 0.5]), (3, [0.4, 0.95])
    assert html_template._nested([outer, inner, crossing]) == [1, 2]


def test_extraction_of_awkward_pages(pages):
    got = html_template.extract(pages)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id == 5} == {""}
    assert html_template.extract(pages.where("false")).count() == 0


def test_articles_of_the_small_tables_come_out_whole(spark):
    """The test pages' article elements, by a plain reading of their markup."""
    import re
    from html import unescape

    got = {r.page_id: r.text for r in queries.QUERIES["op5_html_template"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        inside = re.sub(r"</?(?:h1|p|br|div|ul|li)\b[^>]*>", "\n", inside)
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in inside.split("\n")]
        assert got[r.page_id] == "\n".join(x for x in lines if x)
