"""HTML extraction with site template removal.

A page is parsed into elements, and every element subtree that holds text is hashed, in
two ways: by its words (tag, text without case; digits as 0 if it is long), and, where its text is
mostly links, by its shape (tags, classes and path, with text blanked and runs of equal
parts taken as one), so that a menu is one shape on a host whatever it names. Spark counts,
per host, on how many pages with different text a subtree occurs. Pages with equal text
count once, so copies of an article do not make it a template. Subtrees are the site's
template, and are deleted, if they recur

* on at least ``MIN_PAGES`` different pages and ``SHARE`` of the host's; on hosts of few
  pages on two thirds of them, but ``FEWEST`` pages at least, are enough for the first, or
* on at least ``MANY_PAGES`` different pages, whatever their share, if they are long (not
  inline and of at least ``LONG`` characters) and outside of article and main elements.

Inside of article and main elements, and of table cells anywhere, only long subtrees are
taken; inside of articles by their words alone.
Templates are counted over all elements. Elements that by name, role or class are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments go
as well, whether they recur or not: a page that is the only one of its host has them, too.
A class says so by all its words (cookie-notice, site-header), not by its use of one
(has-sidebar, article-header, cookie-recipe). Neither a class nor a form speaks for an
element that holds the article or, on a page without article and main elements, ``MOST``
of the text outside of links and of what goes by its element. Of the rest
the article (or main) elements are the text, or the whole body if there are none.

Scale. Subtree counts are partial sums per (host, hash), so a host with a third of all
pages is spread over all tasks. The template table is broadcast only while it has at
most ``BROADCAST_ROWS`` rows; beyond that the pages' own hashes are joined to it by
(host, hash), and go to the pages by (host, hash of the page). Pages are parsed twice,
once to count and once to extract: their trees are larger than they are.

Defined cases: null and empty html give an empty text; unclosed and stray tags are read
as browsers do for the elements concerned (p, li, table parts close themselves; an end
tag closes up to its element); a tag whose quote never ends goes to the next '>', and
what follows the last '>' is text; parsing takes time in proportion to the page; a page
without host belongs to the host ''; character references without semicolon are decoded
as in html5; repeated rows and null ids are kept as they come.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import store

MIN_PAGES, SHARE, BROADCAST_ROWS = 10, 0.3, 100_000
FEWEST, MANY_PAGES, LONG = 3, 200, 40

# Element names by their role in html.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
GONE = frozenset("head title script style noscript template nav header footer aside form button select textarea input label fieldset iframe object embed svg canvas audio video map dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation topnav sidenav subnav menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside widget widgets related recommended share sharing social comment comments commentlist disqus respond replies".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
STATES = frozenset("has with without no not is hide show enabled disabled open closed after before layout".split())
HEADS = frozenset("header masthead banner".split())
ARTICLE_WORDS = frozenset("article entry post story content title headline text news blog".split())
PLAIN = ARTICLE_WORDS | frozenset("site page pages main global top bottom left right middle center upper lower primary secondary mobile desktop small big large inner outer fixed sticky floating area areas bar bars box boxes block blocks panel panels pane section sections container wrap wrapper group region zone slot unit column col row list lists item items link links button buttons form thread reader readers user users posts articles stories message toast js ui my the is".split())
FORMS, MOST = frozenset("form fieldset".split()), 0.75
HOLDS_ARTICLE = frozenset("related recommended promo promotion sponsor sponsored".split()) | COMMENTS
HEADINGS = frozenset("h1 h2".split())
CELLS = frozenset("td th tr dt dd".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}

_NEXT = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "gone", "words", "kids")

    def __init__(self, tag: str, gone: str = "", words: tuple[str, ...] = ()):
        # gone: "" or the reason, "tag", "class" or "comment"; words: of class and id
        self.tag, self.gone, self.words, self.kids = tag, gone, words, []


def _by_class(token: str) -> str:
    """Whether a class or id says that its element goes: "", "class", "around" (goes even if
    it holds an article) or "comment"."""
    words = _NAME.findall(token)
    found = NAMES.intersection(words)
    if not found or not STATES.isdisjoint(words) or any(w not in NAMES and w not in PLAIN and not w.isdigit() for w in words):
        return ""
    if found <= HEADS and not ARTICLE_WORDS.isdisjoint(words):
        return ""
    return "comment" if not COMMENTS.isdisjoint(found) else "around" if not HOLDS_ARTICLE.isdisjoint(found) else "class"


def _gone(tag: str, attrs: str) -> tuple[str, tuple[str, ...]]:
    """Why an element goes, and the words of its class and id."""
    gone, words = "tag" if tag in GONE else "", []
    if not attrs or tag in ("html", "body"):
        return gone, ()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words += value.split()
        elif name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value.strip() == "true":
            gone = gone or ("" if tag in ("article", "main") else "tag")
        elif name == "itemprop" and value.strip() == "comment":
            gone = "comment"
    for w in words if not gone else ():
        why = _by_class(w)
        if why and (tag not in ("article", "main") or why == "comment"):
            gone = why
            break
    return gone, tuple(sorted(set(words)))


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at ``at``, or -1."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return page.find(">", m.end())
        at = close + 1


def parse(page: str) -> Node:
    """The element tree; text nodes are strings, still with character references."""
    root = Node("")
    open_nodes, at, n, last = [root], 0, len(page), page.rfind(">")
    n_open: Counter = Counter()
    text = 0  # where the text begins that is not yet a node

    def close(k: int) -> None:
        for x in open_nodes[k:]:
            n_open[x.tag] -= 1
        del open_nodes[k:]

    while True:
        m = _NEXT.search(page, at) if at < last else None
        if m is None:
            if text < n:
                open_nodes[-1].kids.append(page[text:])
            return root
        if m[5]:
            end = _tag_end(page, m.end())
            if end < 0:
                at = m.end()
                continue
        else:
            mark = "-->" if m[1] else "]]>" if m[2] else ">"
            end = page.find(mark, m.end())
            end = n - 1 if end < 0 else end + len(mark) - 1
        if m.start() > text:
            open_nodes[-1].kids.append(page[text : m.start()])
        at = text = end + 1
        if not m[5]:
            continue
        tag, attrs = m[5].lower(), page[m.end() : end]
        if m[4]:
            if n_open[tag]:
                for k in range(len(open_nodes) - 1, 0, -1):
                    own = open_nodes[k].tag
                    if own == tag:
                        close(k)
                        break
                    if tag in INLINE and own not in INLINE:  # blocks that stand open inside stay open
                        break
            continue
        if tag in CLOSES_P or tag in CLOSES:
            ends, scope = CLOSES.get(tag, ("p",)), SCOPE.get(tag, ())
            left = sum(n_open[t] for t in ends)
            for k in range(len(open_nodes) - 1, 0, -1):
                if not left:
                    break
                own = open_nodes[k].tag
                if own in ends:
                    close(k)
                    left -= 1
                elif own in scope or own not in INLINE and tag not in CLOSES:
                    break
        node = Node(tag, *_gone(tag, attrs))
        open_nodes[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in RAW and tag in ("svg", "path"):
            continue
        if tag in RAW:
            m = _END[tag].search(page, at)
            stop = m.start() if m else n
            if stop > at:
                node.kids.append(page[at:stop])
            shut = page.find(">", stop) if m else n
            at = text = shut + 1 if shut >= 0 else n
            continue
        open_nodes.append(node)
        n_open[tag] += 1


def _walk(root: Node) -> list[Node]:
    """All elements, each after those inside it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if type(k) is Node]
    order.reverse()
    return order


def rule_out(root: Node, rules: bool = True) -> set[int]:
    """``id`` of the elements that the rules delete."""
    holds: dict[int, tuple[bool, bool]] = {}  # an article, a headline
    prose: dict[int, int] = {}  # characters outside of links and of what goes by its element
    for node in _walk(root):
        own = 0
        for k in node.kids:
            own += len("".join(k.split())) if type(k) is str else prose[id(k)]
        wraps = node.gone in ("class", "around") or node.tag in FORMS and node.gone == "tag"
        prose[id(node)] = 0 if node.tag == "a" or node.gone and not wraps else own
        article, head = node.tag in ("article", "main") and node.gone != "comment", node.tag in HEADINGS
        for k in node.kids:
            if type(k) is Node:
                a, h = holds[id(k)]
                article, head = article or a, head or h
        holds[id(node)] = article, head
    out, todo = set(), [(root, False)]
    while todo:
        node, inside = todo.pop()
        article, head = holds[id(node)]
        form = node.tag in FORMS and node.gone == "tag"
        most = not holds[id(root)][0] and prose[id(node)] > 0 and prose[id(node)] >= MOST * prose[id(root)]
        stays = (node.gone == "class" or form) and article or (node.gone in ("class", "around") or form) and most or node.tag == "header" and inside and head and node.gone == "tag"
        if node.gone and not stays and (rules or node.tag in RAW or node.tag == "head"):
            out.add(id(node))
        inside = inside or node.tag in ("article", "main")
        todo += [(k, inside) for k in node.kids if type(k) is Node]
    return out


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def subtrees(root: Node) -> dict[int, tuple[int, ...]]:
    """Signed 64-bit hashes of each element that holds text, by ``id(node)``: of its words,
    and of its shape if it is mostly links. The lowest bit says whether it is long and
    outside of article and main elements, the next whether it is inside of one."""
    path, todo = {}, [(root, 0, False)]
    while todo:  # from the top: what an element lies in
        node, above, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        own = 0 if inside else _hash(b"%d %s %s" % (above, node.tag.encode(), " ".join(node.words).encode("utf-8", "surrogatepass").translate(_ZEROS)))
        path[id(node)] = own, inside
        todo += [(k, own, inside) for k in node.kids if type(k) is Node]
    done: dict[int, tuple[int, int, int, int, int]] = {}
    out: dict[int, tuple[int, ...]] = {}
    for node in _walk(root):
        if node.tag in RAW or node.tag == "head":
            done[id(node)] = 0, 0, 0, 0, 0
            continue
        said, shape, size, links, linked, last = [node.tag.encode()], [node.tag.encode()], 0, 0, 0, None
        for k in node.kids:
            if type(k) is str:
                t = " ".join(k.split())
                if t:
                    size += len(t)
                    raw = t.lower().encode("utf-8", "surrogatepass")
                    # dates and counters of a notice may differ, numbers in short blocks count
                    said.append(raw.translate(_ZEROS) if len(t) >= LONG else raw)
            else:
                word, form, chars, n, among = done[id(k)]
                said.append(b"\1%d" % word)
                if form != last:
                    shape.append(b"\1%d" % form)
                last = form
                size, links, linked = size + chars, links + n, linked + among
        if node.tag == "a":
            links, linked = links + 1, size
        word, form = _hash(b"\0".join(said)), _hash(b"\0".join(shape))
        done[id(node)] = word, form, size, links, linked
        own, inside = path[id(node)]
        block = size >= LONG and node.tag not in INLINE
        if size and node.tag not in ("", "html", "body", "article", "main") and (block or not inside and node.tag not in CELLS):
            found = [word & -4 | inside << 1 | (block and not inside)]
            if not inside and links >= 2 and 2 * linked >= size:
                found.append(_hash(b"shape %d %d" % (own, form)) & -4)
            out[id(node)] = tuple(h - (1 << 64) if h >> 63 else h for h in found)
    return out


def _tops(root: Node, dropped: set[int]) -> list[Node]:
    """The outermost article and main elements, in page order."""
    tops, todo = [], [root]
    while todo:
        node = todo.pop()
        if id(node) in dropped:
            continue
        if node.tag in ("article", "main"):
            tops.append(node)
        else:
            todo += [k for k in reversed(node.kids) if type(k) is Node]
    return tops


def extracted(root: Node, template: frozenset[int]) -> str:
    """The text without template subtrees. Where articles are the text and the host has no
    template inside of articles, what lies elsewhere needs no hash."""
    rules = rule_out(root)
    if not template or not any(h & 2 for h in template) and _tops(root, rules):
        return main_text(root, dropped=rules)
    return main_text(root, template, subtrees(root), dropped=rules)


def main_text(root: Node, template: frozenset[int] = frozenset(), hashes: dict[int, tuple[int, ...]] | None = None, rules: bool = True, dropped: set[int] | None = None) -> str:
    """The text of what is left, blocks joined by one space."""
    dropped = rule_out(root, rules) if dropped is None else dropped
    dropped = dropped | {i for i, own in (hashes or {}).items() if not template.isdisjoint(own)}
    tops = _tops(root, dropped)
    out: list[str] = []
    # texts and the spaces between blocks, in page order
    work: list = list(reversed(tops or [root]))
    while work:
        k = work.pop()
        if type(k) is str:
            out.append(html.unescape(k) if "&" in k else k)
            continue
        if id(k) in dropped:
            if k.tag not in INLINE:
                out.append(" ")
            continue
        if k.tag in INLINE:
            work += reversed(k.kids)
        else:
            out.append(" ")
            work.append(" ")
            work += reversed(k.kids)
    return _SPACE.sub(" ", "".join(out)).strip()


_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, hash): the template subtrees of each host that has some."""
    store.small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            hosts, texts, trees = [], [], []
            for url, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                root = parse(_text(page))
                hosts.append(host(url))
                texts.append(_key(main_text(root)))
                trees.append(sorted({h for own in subtrees(root).values() for h in own}))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(trees, pa.list_(pa.int64()))], names=["host", "text", "trees"])

    seen = pages.select("url", "html").mapInArrow(run, "host string, text long, trees array<long>")
    once = store.materialize(seen.groupBy("host", "text").agg(F.min("trees").alias("trees")), "subtrees")
    n = F.col("pages")
    fewest = F.greatest(F.lit(min(FEWEST, min_pages)), F.least(F.lit(min_pages), F.ceil(n * 2 / 3)))
    sizes = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(n >= min(FEWEST, min_pages))
    counts = once.select("host", F.explode("trees").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(FEWEST, min_pages))
    long = F.col("hash").bitwiseAND(F.lit(1)) == 1
    found = counts.join(sizes, "host").where((F.col("n") >= fewest) & (F.col("n") >= share * n) | long & (F.col("n") >= many_pages))
    return found.select("host", "hash")


def _keyed(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with their host and the hash of their html."""

    def run(batches):
        for b in batches:
            hosts = [host(u) for u in b.column(1).to_pylist()]
            keys = [hashlib.sha256(p.as_buffer() if p.is_valid else b"").digest() for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hosts, pa.string()), pa.array(keys, pa.binary())], names=["page_id", "url", "html", "host", "page"])

    return pages.mapInArrow(run, "page_id long, url string, html binary, host string, page binary")


def _own_templates(pages: DataFrame, made: DataFrame) -> DataFrame:
    """(host, page, hashes): the template subtrees that each different html of a host has."""

    def run(batches):
        for b in batches:
            trees = [sorted({h for own in subtrees(parse(_text(p))).values() for h in own}) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(trees, pa.list_(pa.int64()))], names=["host", "page", "trees"])

    have = pages.select("host", "page", "html").mapInArrow(run, "host string, page binary, trees array<long>").dropDuplicates(["host", "page"])
    return have.select("host", "page", F.explode("trees").alias("hash")).join(made, ["host", "hash"], "left_semi").groupBy("host", "page").agg(F.collect_list("hash").alias("hashes"))


def _text(page: pa.Scalar) -> str:
    """A page's text; bytes that are not valid UTF-8 are replaced."""
    return page.as_buffer().to_pybytes().decode("utf-8", "replace") if page.is_valid else ""


OUT = "page_id long, url string, text string, n_chars long"


def extract(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS, many_pages: int = MANY_PAGES) -> DataFrame:
    """Per page: page_id, url, the main text and its length in code points."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary").alias("html"))
    made = store.materialize(templates(base, min_pages, share, many_pages), "templates")
    if made.count() <= broadcast_rows:
        known: dict[str, set[int]] = {}
        for r in made.collect():
            known.setdefault(r["host"], set()).add(r["hash"])
        held = spark.sparkContext.broadcast({k: frozenset(v) for k, v in known.items()})
        joined = base
    else:
        held = None
        keyed = _keyed(base)
        joined = keyed.join(_own_templates(keyed, made), ["host", "page"], "left").select("page_id", "url", "html", "hashes")

    def run(batches):
        for b in batches:
            ids, urls = b.column(0), b.column(1)
            kinds = b.column(3).to_pylist() if held is None else [held.value.get(host(u)) for u in urls.to_pylist()]
            texts = []
            for page, own in zip(b.column(2), kinds, strict=True):
                texts.append(extracted(parse(_text(page)), frozenset(own or ())))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, OUT)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, store.read(spark, sf_dir, "pages"))
