"""Main text of pages by template deduction over equivalence classes.

1. Every page is read into tokens: opening and closing tags with their path (names and classes), and text blocks with
   their path and the hash of their text. Paths are running hashes, so deep pages are read in linear time.
2. Copies of a page count once. A token's occurrence vector over its host's pages is kept as a sum of hashes of (page, count), so it is built by
   partial sums, whatever the host's size. Tokens of a host that share vector, pages and total are an equivalence class.
3. Classes with at least CLASS tokens on a SUPPORT share of the host's pages (three at least) are valid if they nest: ordered
   by mean position, a class lies in one gap of each larger one or the other way round. Valid classes make the template; it is
   bounded: each token needs a fixed share of the pages, so there are at most (mean tokens of a page) / SUPPORT. Its text is
   left out of pages only if it is on more than MOST of them: a smaller share may be near copies of one article.
4. The template's tags cut every page into slots: what lies behind one of them and before the next. A slot is content if
   on most of the host's pages it lies in an article (or main) element and in no part of it that is a menu, notice and the
   like. If the host has such slots, their blocks are the text; template text in them stays. Elements only choose among
   slots; an article that the template doesn't know makes a slot of its own.
5. Where the host's template has no content slot, the text is what remains: blocks that are not template text, not mostly
   links and not in a part named as menu, notice and the like. A page without a host template is read by its own tags in the same way.

Hosts with fewer than PAGES different pages are taken together as one group, so that their common frame is found.
Inside content, headers, forms, scripts, side bars, notices, adverts and comment sections are left out, by element or by
words of class, id and role. h1 to h6 of an article belong to it.

Edge cases: a null or empty html gives the empty text; text without markup is one block; unclosed elements end
with the element around them; a null url stands with the small hosts; repeated rows each get their row; fewer than three pages make no
template; extra columns are ignored. Pages are read whole and nothing is capped.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, materialize

SUPPORT, MOST, CLASS, PAGES, SALTS = 0.2, 0.5, 3, 3, 16

_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S
)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp noembed noframes iframe".split())
_OUT = set("script style noscript template head title textarea select option button form nav aside header footer iframe object svg canvas dialog menu".split())
_BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "html", "body"}
_CELL = {"td", "th"}
_SIBLINGS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_NOISE = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|"
    r"rail|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|comments?|comment-list|respond|replies|disqus|share|sharing|social|"
    r"related|recommended|newsletter|subscribe|subscription|signup|login|pagination|pager|widget|toolbar|skip-link)(?![a-z])"
)
#: An article of this kind is no main one, and one inside such an element neither.
_ASIDE = re.compile(r"(?<![a-z])(?:comments?|repl(?:y|ies)|teasers?|related|recommended|sidebar|ads?|promos?)(?![a-z])")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}


@dataclass(slots=True)
class Block:
    """A text block: its words, where it is, and how much of it is links."""

    text: str
    path: int
    inside: bool  # in an article or main element
    noise: bool
    position: int
    links: int


@dataclass(slots=True)
class Tag:
    """An opening or closing tag: its token, and whether what follows it is content (in an article, in no noise)."""

    token: int
    position: int
    content: bool
    edge: bool  # begins or ends an article or main element


@dataclass(slots=True)
class _Open:
    """An open element with what holds for all that lies in it."""

    name: str
    path: int
    inside: bool
    noise: bool
    hard: bool  # in a side bar, a footer or a comment section
    link: bool
    main: bool


def _hash(x: str) -> int:
    from xxhash import xxh64_intdigest

    v = xxh64_intdigest(x, 5)
    return v - (1 << 64) if v >> 63 else v


def read_page(page: str) -> list[Block | Tag]:
    """The page's blocks and block-level tags in order."""
    out: list[Block | Tag] = []
    stack = [_Open("", 0, False, False, False, False, False)]
    count: dict[str, int] = {}  # open elements by name
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            top = stack[-1]
            out.append(Block(text, top.path, top.inside, top.noise, len(out), linked))
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text:
            text = _html.unescape(text)
            buffer.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    def pop(to: int) -> None:
        while len(stack) > to:
            x = stack.pop()
            count[x.name] -= 1
            if x.name in _BLOCK:
                top = stack[-1]
                out.append(Tag(_hash(f"/{x.path}"), len(out), top.inside and not top.noise, x.main))

    def nearest(names: set[str], stop: set[str] | frozenset[str]) -> int:
        """Where the innermost open element of these names is, unless one of ``stop`` lies inside it (0: nowhere)."""
        if any(count.get(x) for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    return k
                if stack[k].name in stop:
                    break
        return 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        put(page[at:lt])
        m = _MARKUP.match(page, lt)
        if m is None:
            m2 = _LOOSE.match(page, lt)
            if m2 is None:  # a lone "<"
                put("<")
                at = lt + 1
                continue
            at, end, name, attrs = m2.end(), m2[1], m2[2].lower(), m2[3]
        else:
            at = m.end()
            if m["name"] is None:
                continue
            end, name, attrs = m["end"], m["name"].lower(), m["attrs"]
        block = name in _BLOCK
        if block:
            flush()
        elif name in _CELL:
            buffer.append(" ")
        if end:
            # the end of an inline element doesn't reach beyond the block it stands in
            if k := nearest({name}, frozenset() if block else _BLOCK):
                pop(k)
            continue
        if name in _CLOSES_P and (k := nearest({"p"}, _BLOCK)):
            pop(k)
        if name in _SIBLINGS and (k := nearest(_SIBLINGS[name], _SCOPE[name])):
            pop(k)
        if name in _VOID or attrs.rstrip().endswith("/") and name in ("path", "use", "rect", "circle"):
            if not block and name in ("img", "wbr", "input"):
                buffer.append("" if name == "wbr" else " ")
            continue
        kv = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs else {}
        label = name + ("." + ".".join(kv["class"].split()) if kv.get("class") else "") + (f"#{kv['id']}" if kv.get("id") else "")
        if name in _RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name == "title":
                flush()
            at = stop.end() if stop else n
            continue
        marks = f"{kv.get('class', '')} {kv.get('id', '')}".lower().replace("_", "-")
        main = (name in ("article", "main") or kv.get("role") == "main") and not _ASIDE.search(marks)
        noise = not main and (
            name in _OUT or kv.get("role") in _ROLES or "hidden" in attrs.lower().split() or bool(marks.strip() and name != "body" and _NOISE.search(marks))
        )
        top = stack[-1]
        path = _hash(f"{top.path}/{label}")
        starts = main and not top.inside
        # an unclosed menu around a main element does no harm, a side bar or a comment section around it does
        hard = top.hard or not top.inside and not main and (name in ("aside", "footer") or noise and bool(_ASIDE.search(label.lower())))
        new = _Open(name, path, top.inside or main, top.hard if starts else top.noise or noise, hard, top.link or name == "a", starts)
        if block:
            out.append(Tag(path, len(out), new.inside and not new.noise, starts))
        stack.append(new)
        count[name] = count.get(name, 0) + 1
    flush()
    pop(1)
    return out


def _text_token(b: Block) -> int:
    return _hash(f"t\x1f{b.path}\x1f{b.text}")


@dataclass(frozen=True)
class Template:
    """Tags of a host's template, those of them whose slot is content, and its text tokens."""

    tags: frozenset[int] = frozenset()
    content: frozenset[int] = frozenset()
    texts: frozenset[int] = frozenset()


def main_text(page: str, template: Template = Template()) -> str:
    """The blocks of the page's content slots, joined by newlines."""
    items = read_page(page)
    if template.content and any(isinstance(x, Tag) and x.token in template.content for x in items):
        slot, kept = False, []
        for x in items:
            if isinstance(x, Block):
                if slot and not x.noise:
                    kept.append(x.text)
            elif x.token in template.tags:
                slot = x.token in template.content
            elif x.edge:  # an article of this page only
                slot = x.content
        return "\n".join(kept)
    blocks = [x for x in items if isinstance(x, Block)]
    if any(isinstance(x, Tag) and x.edge for x in items):
        return "\n".join(b.text for b in blocks if b.inside and not b.noise)
    return "\n".join(b.text for b in blocks if not b.noise and _text_token(b) not in template.texts and b.links * 2 <= max(len(b.text), 1))


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", host.alias("__host"), html.alias("__html"), F.xxhash64(host, html).alias("__hash"))


def _slot(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(SLOTS))


def distinct_pages(hosted: DataFrame, copied: DataFrame) -> DataFrame:
    """One row of each host's copies of a page: else a page with many copies would look like its host's template.

    ``copied``: (__slot), the hash slots of pages that have copies, SLOTS at most. Pages outside them pass as they are;
    those inside are told apart by their whole hash, first in their own task.
    """
    rows = hosted.withColumn("__slot", _slot(F.col("__hash")))
    clear = rows.join(F.broadcast(copied), "__slot", "left_anti")
    doubtful = rows.join(F.broadcast(copied), "__slot", "left_semi").dropDuplicates(["__hash"])
    return clear.select(*hosted.columns).unionByName(doubtful.select(*hosted.columns))


def token_vectors(hosted: DataFrame) -> DataFrame:
    """(host, token, pages, total, vector, position, is_text, content): occurrence vectors, built by partial sums.

    ``content``: the share of the token's occurrences that content follows.
    """
    schema = "host string, page long, token long, n int, position double, is_text boolean, content double"

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "token", "n", "position", "is_text", "content"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64()]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows: list[tuple] = []
                for host, html in zip(*(b.column(k).slice(at, 256).to_pylist() for k in (0, 1)), strict=True):
                    page = _hash(html)
                    rows += [(host, page, *r) for r in page_tokens(html)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)

    found = hosted.select("__host", "__html").mapInArrow(make, schema)
    return found.groupBy("host", "token").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("total"),
        F.sum(F.xxhash64("page", "n").bitwiseAND(F.lit((1 << 31) - 1))).alias("vector"),
        F.avg("position").alias("position"),
        F.first("is_text").alias("is_text"),
        (F.sum("content") / F.sum("n")).alias("content"),
    )


def page_tokens(page: str) -> list[tuple[int, int, float, bool, float]]:
    """(token, occurrences, mean position, is text, occurrences that content follows) of a page's different tokens."""
    items = read_page(page)
    seen: dict[int, list] = {}
    for x in items:
        text = isinstance(x, Block)
        s = seen.setdefault(_text_token(x) if text else x.token, [0, 0.0, text, 0.0])
        s[0] += 1
        s[1] += x.position / len(items)
        s[3] += 0.0 if text else float(x.content)
    return [(t, n, p / n, text, c) for t, (n, p, text, c) in seen.items()]


def _nested(classes: list[tuple[int, list[float]]]) -> list[int]:
    """Keys of the classes that nest, tried from the one on most pages down. Positions are sorted."""
    from bisect import bisect_left

    kept: list[tuple[int, list[float]]] = []
    for key, own in classes:
        lo, hi = own[0], own[-1]
        fits = True
        for _, other in kept:
            inside = bisect_left(other, lo) == bisect_left(other, hi)  # in one gap of the other
            around = bisect_left(own, other[0]) == bisect_left(own, other[-1])
            if not (inside or around):
                fits = False
                break
        if fits:
            kept.append((key, own))
    return [k for k, _ in kept]


def templates(vectors: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, tags, content, texts, n_tokens, n_classes): each host's template. ``hosts``: (host, n), n different pages."""
    frequent = vectors.join(hosts, "host").where((F.col("pages") >= PAGES) & (F.col("pages") >= F.col("n") * SUPPORT))
    classes = (
        frequent.groupBy("host", "n", "vector", "pages", "total")
        .agg(F.sort_array(F.collect_list(F.struct("position", "token", "is_text", "content"))).alias("members"))
        .where(F.size("members") >= CLASS)
    )
    # one row per host; bounded, see step 3 above
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("n", "pages", "total", "members")).alias("classes"))

    def nest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        schema = pa.schema({"host": pa.string(), "tags": longs, "content": longs, "texts": longs, "n_tokens": pa.int32(), "n_classes": pa.int32()})
        for b in batches:
            out = []
            for host, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.sort(key=lambda c: (-c["pages"], c["total"], -len(c["members"]), c["members"][0]["token"]))
                good = _nested([(k, [m["position"] for m in c["members"]]) for k, c in enumerate(found)])
                members = [m for k in good for m in found[k]["members"]]
                tags = [m for m in members if not m["is_text"]]
                texts = sorted(m["token"] for k in good if found[k]["pages"] > found[k]["n"] * MOST for m in found[k]["members"] if m["is_text"])
                out.append({
                    "host": host, "tags": sorted(m["token"] for m in tags), "content": sorted(m["token"] for m in tags if m["content"] > 0.5),
                    "texts": texts, "n_tokens": len(members), "n_classes": len(good),
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    return by_host.mapInArrow(nest, "host string, tags array<long>, content array<long>, texts array<long>, n_tokens int, n_classes int")


def deduced(hosted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates by group of hosts, (__host, __group)): small hosts share the group of the empty name."""
    contents = materialize(hosted.groupBy("__host", "__hash").agg(F.count("*").alias("n")), "contents")
    # tables of their own: the planner sees how small they are
    sizes = contents.groupBy("__host").agg(F.count("*").alias("pages"))
    groups = materialize(sizes.select("__host", F.when(F.col("pages") >= PAGES, F.col("__host")).otherwise("").alias("__group"), "pages"), "groups")
    hosts = materialize(groups.groupBy(F.col("__group").alias("host")).agg(F.sum("pages").alias("n")), "hosts")
    copied = materialize(contents.where("n > 1").select(_slot(F.col("__hash")).alias("__slot")).distinct(), "copied")
    small = groups.where("__host <> __group").select(F.col("__host").alias("host"), F.col("__group").alias("group"))
    vectors = token_vectors(distinct_pages(hosted, copied))
    pooled = (
        vectors.join(small, "host", "left")
        .groupBy(F.coalesce("group", "host").alias("host"), "token")
        .agg(
            F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("vector").alias("vector"),
            (F.sum(F.col("position") * F.col("pages")) / F.sum("pages")).alias("position"), F.first("is_text").alias("is_text"),
            (F.sum(F.col("content") * F.col("total")) / F.sum("total")).alias("content"),
        )
    )
    return materialize(templates(pooled, hosts), "templates"), groups.select("__host", "__group")


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, ``text``, ``n_chars``, and how many template tokens the page's host has."""
    hosted = _hosted(pages)
    made, groups = deduced(hosted)
    by_host = groups.join(made.withColumnRenamed("host", "__group"), "__group")
    # Templates are dealt under SALTS keys, so a host with a third of all pages is not one task's.
    salted = materialize(by_host.select("__host", "tags", "content", "texts", "n_tokens", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")), "salted")
    salt = F.pmod(F.xxhash64("page_id", "__hash"), F.lit(SALTS)).cast("int")
    joined = hosted.withColumn("__salt", salt).join(salted, ["__host", "__salt"], "left").select(
        "page_id", "url", "__html", "__host", "tags", "content", "texts", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")
    )
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, Template] = {}
            text = []
            hosts = b.column(3).to_pylist()
            for k, (html, host) in enumerate(zip(b.column(2).to_pylist(), hosts, strict=True)):
                if host not in known:
                    known[host] = Template(*(frozenset(b.column(c)[k].as_py() or ()) for c in (4, 5, 6)))
                text.append(main_text(html, known[host]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), b.column(7)],
                names=["page_id", "url", "text", "n_chars", "template_tokens"],
            )

    return joined.mapInArrow(take, f"{kinds}, text string, n_chars long, template_tokens int")


#: For pages whose article is marked up once, with these tags and character references only: its blocks, read from the markup.
SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT *, string_split(regexp_replace(x, '</?(h[1-6]|p|br|div|ul|ol|li)( [^>]*)?>', chr(1), 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda p: regexp_replace(replace(replace(replace(regexp_replace(p, '</?[A-Za-z][^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS parts FROM b),
d AS (SELECT page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS parts FROM c)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM d"""
