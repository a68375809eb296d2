"""Main text of web pages, by markup and by a site style tree.

A page is parsed once. Its blocks (the text between block-level tags) carry the node of the site style tree in which they
stand: the hash of the host and of the tags and classes above them, however deep. Branches that markup names as no content
(menus, forms, adverts and the like, by tag, role or class) go.

The pages of a host are merged to a style tree, pages of equal content once: for each node, how many pages hold which
content and which sequence of child tags. A node's importance is the normalised entropy with which its contents spread
over pages, mixed with the entropy of its presentation: 1 where every page has its own, near 0 where all have the same.
``UNSEEN`` pages of contents of their own are added to every node, so that a few pages prove nothing and no size of host
is treated apart. Nodes below ``least`` go from every page, those in marked main content (article, main) only below
``least_main``. Of what remains, main content is the page's text unless the page has more text outside it.

Contents are counted by (host, node, content), so a hot host is spread by its contents, and as 64-bit hashes, so that no
text is shuffled for it. Each host's list of unimportant nodes, bounded by its templates, is joined to its pages: all lists
are broadcast if they are counted to be small, else a host's pages are salted for the join.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leafwise.llm.common import BROADCAST_ROWS, mapped, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe)(?=[\s/>])[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(svg|math)(?=[\s/>])[^>]*(?:/>|>.*?</\2\s*>)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form menu button select textarea fieldset dialog script style noscript template svg math object canvas video audio".split())
MAIN = frozenset(("article", "main"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notice|notices|banner|"
    r"comments?|commentlist|disqus|replies|footer|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|widget|toolbar|pagination|skip-?link)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _unwanted(tag: str, names: str, role: str, hidden: bool, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside or role in ROLES or hidden:
        return True
    return inside and _named(tag, names)


def _named(tag: str, names: str) -> bool:
    return bool(names) and tag not in ("html", "body", "main") and NAMES.search(names) is not None


def _released(blocks: list[tuple[int, str, bool, bool, tuple[int, ...]]]) -> set[int]:
    """The named branches around the page's content: layout wrappers such as ``has-sidebar``.

    With main content, those around the least nested of it, none if some lies in no named branch. Else each branch of
    more than half the text."""
    sizes: dict[tuple[int, ...], int] = {}
    marked = [b for b in blocks if b[2] and not b[3]]
    for b in marked or (b for b in blocks if not b[3]):
        sizes[b[4]] = sizes.get(b[4], 0) + len(b[1])
    if marked:
        return set(min(sizes, key=lambda k: (len(k), -sizes[k])))
    held: dict[int, int] = {}
    for branches, n in sizes.items():
        for k in branches:
            held[k] = held.get(k, 0) + n
    return {k for k, n in held.items() if 2 * n > sum(sizes.values())}


def parse(page: str, root: int = 0) -> tuple[list[tuple[int, str, bool, bool]], list[tuple[int, str]]]:
    """Blocks (node, text, in main content, unwanted) in page order, and (node, child tags) of each element. ``root`` is
    the node of the host."""
    blocks: list[tuple[int, str, bool, bool, tuple[int, ...]]] = []
    shapes: list[tuple[int, str]] = []
    #: tag, node, main, unwanted, named branches outside main content, children
    stack: list[tuple[str, int, bool, bool, tuple[int, ...], list[str]]] = [("", root, False, False, (), [])]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1][1], text, *stack[-1][2:5]))
            parts.clear()

    def pop() -> None:
        _, node, _, _, _, children = stack.pop()
        if children:
            shapes.append((node, ">".join(dict.fromkeys(children))))

    def close(tags: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in ("ul", "ol", "table", "article", "main", "body", "div", "section"):
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[4] or m[7] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[3], m[5]) if m[4] else (m[6], m[8])
        if tag in INLINE:
            continue
        flush()
        if closing:
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag])
        names, role, hidden = "", "", False
        if attributes and "=" in attributes or "hidden" in (attributes or "").lower():
            values = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(attributes)}
            names, role = f"{values.get('class', '')} {values.get('id', '')}".strip(), values.get("role", "").lower()
            hidden = re.search(r"(?:^|\s)hidden(?:\s|$|[=/])", re.sub(r"\"[^\"]*\"|'[^']*'", "''", attributes), re.I) is not None or "display:none" in values.get("style", "").replace(" ", "")
        _, node, inside, unwanted, branches, children = stack[-1]
        children.append(tag)
        label = tag + ("." + ".".join(re.sub(r"\d+", "", names).split()) if names else "")
        if not attributes or not attributes.endswith("/"):
            if not inside and _named(tag, names):
                branches = (*branches, m.start())
            stack.append((tag, _hash(f"{node}/{label}"), inside or tag in MAIN, unwanted or _unwanted(tag, names, role, hidden, inside), branches, []))
    if at < len(page):
        parts.append(page[at:])
    flush()
    while stack:
        pop()
    released = _released(blocks)
    return [(node, text, inside, unwanted or not released.issuperset(branches)) for node, text, inside, unwanted, branches in blocks], shapes


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


BLOCK = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string()), ("main", pa.bool_())]))
NODE = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.bool_()), ("hash", pa.int64())]))
#: Parts of a host's pages that each meet its list of nodes.
SALTS = 16
#: Pages of own contents that every node is taken to have beyond those seen.
UNSEEN = 4


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse_pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, host, page: a hash of its content, blocks: those that markup does not rule out, nodes: of the tree)."""

    def kernel(chunk: pa.RecordBatch) -> dict:
        wanted, nodes, hosts, pages = [], [], [], []
        for page, url in zip(chunk.column("html").to_pylist(), chunk.column("url").to_pylist(), strict=True):
            root = _hash(host(url))
            blocks, shapes = parse(page or "", root)
            own = [b for b in blocks if not b[3]]
            wanted.append([{"node": b[0], "text": b[1], "main": b[2]} for b in own])
            tree = sorted({(b[0], True, _hash(b[1])) for b in own} | {(p, False, _hash(c)) for p, c in shapes})
            nodes.append([{"node": p, "kind": k, "hash": h} for p, k, h in tree])
            hosts.append(root)
            pages.append(_hash("\0".join(b[1] for b in own)))
        return {"host": pa.array(hosts, pa.int64()), "page": pa.array(pages, pa.int64()), "blocks": pa.array(wanted, BLOCK), "nodes": pa.array(nodes, NODE)}

    source = df.select(df[id_col].alias("page_id"), df[url_col].alias("url"), df[html_col].alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    return mapped(source, kernel, "html", f"page_id {kind}, url string, host bigint, page bigint, blocks array<struct<node:bigint,text:string,main:boolean>>, nodes array<struct<node:bigint,kind:boolean,hash:bigint>>", ("page_id", "url"))


def style_tree(parsed: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(host, node, importance) of the merged tree of each host's pages; hosts and nodes as hashes."""
    once = parsed.select("host", "page", "nodes").dropDuplicates(["host", "page"])
    held = once.select("host", F.explode("nodes").alias("n")).groupBy("host", "n.node", "n.kind", "n.hash").agg(F.count(F.lit(1)).alias("df"))

    def entropy(of: Column) -> Column:
        """Of df pages for each content, and UNSEEN more of one page each; normalised."""
        total = F.sum(F.when(of, F.col("df"))) + UNSEEN
        return 1 - F.sum(F.when(of, F.col("df") * F.log("df"))) / (total * F.log(total))

    sums = held.groupBy("host", "node").agg(entropy(F.col("kind")).alias("content"), entropy(~F.col("kind")).alias("shape"))
    return sums.select("host", "node", F.coalesce(gamma * F.col("content") + (1 - gamma) * F.col("shape"), "content", "shape").alias("importance"))


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.35, least_main: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page gives an empty text; a null URL, or one without a host, is of the host "". Repeated rows and
    ids pass as they are, ties of importance stay together; an empty table gives an empty result; columns beyond the
    three are not read. Unclosed and stray tags, quotes and comments are read as browsers do, roughly."""
    parsed = stored(parse_pages(df, id_col, url_col, html_col))
    nodes = stored(style_tree(parsed).where(F.col("importance") < least).select("host", "node", (F.col("importance") < least_main).alias("firm")))
    low = nodes.groupBy("host").agg(F.collect_set("node").alias("low"), F.collect_set(F.when(F.col("firm"), F.col("node"))).alias("lowest"))
    pages = parsed.drop("nodes")
    if nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # counted: two numbers a row
        pages = pages.join(F.broadcast(low), "host", "left")
    else:
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(low, ["host", "salt"], "left")
    gone = lambda b: F.coalesce(F.array_contains("low", b["node"]) & (~b["main"] | F.array_contains("lowest", b["node"])), F.lit(False))
    kept = pages.withColumn("kept", F.filter("blocks", lambda b: ~gone(b)))
    size = lambda main: F.aggregate(F.filter("kept", lambda b: b["main"] == main), F.lit(0), lambda a, b: a + F.length(b["text"]))
    marked = size(True)  # lengths in code points
    shown = F.filter("kept", lambda b: b["main"] | ~F.col("only"))
    text = F.array_join(F.transform(shown, lambda b: b["text"]), " ")
    return kept.withColumn("only", (marked > 0) & (marked >= size(False))).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
