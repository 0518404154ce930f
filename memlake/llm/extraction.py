"""HTML extraction with wrappers inferred as union-free regular expressions.

Pages of one host are read as trees of tags and texts. A page is first folded:
neighbours, or short runs of them, that repeat in kind become one repeated group.
Pages are then aligned with the wrapper one after the other: what only one side
has becomes optional, texts that differ become slots, texts that never differ
stay constants. All pages take part: each task aligns its own pages of a host,
and the wrappers of the tasks are aligned in a tree of merges. A host's wrapper
tells which places hold furniture; every page is then cut by it, and by the tags
and names that mark what is no article.
"""

from __future__ import annotations

import html as entities
import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm import common

#: Hosts that a task aligns at once; the wrappers so far are passed on beyond it.
HOSTS_AT_ONCE = 500
#: Wrappers of a host, from this many tasks, that one merge aligns.
FAN_IN = 32
#: Different pages from which on a text that all of them have is furniture.
LEAST_PAGES = 3
LONGEST_RUN = 4  # of siblings that may repeat as a group
#: Wrappers are sent to all tasks up to this size, and joined by host beyond it.
BROADCAST_BYTES = 16 << 20
MAX_DEPTH = 100  # of a wrapper; deeper places follow the rule of what is above them

BLOCK_TAGS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript iframe template".split())
CLOSED_BY_SIBLING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                     "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FORBIDDEN_TAGS = frozenset("aside button dialog footer form head header input menu nav select".split()) | RAW_TAGS
FORBIDDEN_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar".split())
FORBIDDEN_ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search".split())
MAIN_TAGS = frozenset({"article", "main"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
                    r"|(?P<text>[^<]+|<(?![A-Za-z/!?]))", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
#: Names that tell what an element has or lacks, not what it is.
_TRAIT = re.compile(r"(?:no|not|has|have|with|without|is|hide|show)(?![a-z])|.*[^a-z](?:free|less)\Z")


def _element(tag: str, rest: str, inside: bool) -> tuple[str, bool]:
    """Kind of an element (tag, class and id words) and whether its names keep it out of the article. Classes and ids
    of a whole page or its main part say nothing; a header inside an article is the article's own."""
    names: list[str] = []
    forbidden = tag in FORBIDDEN_TAGS and not (inside and tag == "header")
    if rest.strip(" /\n\t"):
        for name, value in _ATTRIBUTE.findall(rest):
            value = value.strip("\"'").lower()
            if name.lower() in ("class", "id"):
                names += value.split()
            elif name.lower() == "role":
                forbidden |= value in FORBIDDEN_ROLES
            elif name.lower() == "hidden":
                forbidden = True
    if tag not in ("html", "body", "main"):
        words = {word for name in names if not _TRAIT.match(name) for word in _WORD.findall(name)}
        forbidden |= bool(words & FORBIDDEN_NAMES - ({"header"} if inside else set()))
    return ".".join([tag, *sorted(re.sub(r"\d+", "0", n) for n in names)]), forbidden


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, str, bool]]:
    """Texts of a page outside of forbidden elements: path of kinds, whether it is in a main element, the text with its
    white space as one space, and whether it is all links. A block ends where a block element begins or ends."""
    stack: list[tuple[str, str, bool, bool, bool, bool]] = []  # tag, kind; forbidden, main, link, article: or one above
    unclosed: dict[str, int] = {}  # tags on the stack
    found: list[tuple[tuple[str, ...], bool, str, bool]] = []
    parts: list[str] = []
    place: tuple = ((), False)
    links = others = begun = False
    at, end = 0, len(page)

    def flush():
        nonlocal links, others, begun
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            found.append((*place, text, links and not others))
        parts.clear()
        links = others = begun = False

    def block_place():
        depth = len(stack)
        while depth and stack[depth - 1][0] not in BLOCK_TAGS:
            depth -= 1
        return tuple(s[1] for s in stack[:depth])

    def close(depth: int) -> None:
        for entry in stack[depth:]:
            unclosed[entry[0]] -= 1
        del stack[depth:]

    while at < end:
        token = _TOKEN.match(page, at)
        if token is None:  # a tag with an open quote: up to the next bracket
            bracket = page.find(">", at + 1)
            at = end if bracket < 0 else bracket + 1
            continue
        at = token.end()
        text, tag = token["text"] if token["text"] is not None else token["data"], token["tag"]
        if text is not None:
            if stack and stack[-1][2]:
                continue
            if text.strip():
                if not begun:
                    begun, place = True, (block_place(), bool(stack and stack[-1][3]))
                if stack and stack[-1][4]:
                    links = True
                else:
                    others = True
            parts.append(text if token["data"] is None else text.replace("&", "&amp;"))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if token["close"]:
            if unclosed.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in RAW_TAGS:
            if tag not in FORBIDDEN_TAGS or not token["rest"].endswith("/"):
                found_end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = found_end.end() if found_end else end
            continue
        if tag in CLOSED_BY_SIBLING or tag in BLOCK_TAGS:
            ends = CLOSED_BY_SIBLING.get(tag, set()) | ({"p"} if tag in BLOCK_TAGS else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        if tag in VOID_TAGS or token["rest"].endswith("/"):
            continue
        above = stack[-1] if stack else ("", "", False, False, False, False)
        kind, forbidden = _element(tag, token["rest"], above[5])
        stack.append((tag, kind, above[2] or forbidden, above[3] or tag in MAIN_TAGS, above[4] or tag == "a",
                      above[5] or tag == "article"))
        unclosed[tag] = unclosed.get(tag, 0) + 1
    flush()
    return found


class Node:
    """Part of a wrapper: an element kind, or a text (kind None) that is a constant or a slot."""

    def __init__(self, kind: str | None, text: str | None = None, main: bool = False, links: bool = False):
        self.kind, self.text, self.main, self.links = kind, text, main, links
        self.slot = self.optional = self.repeated = False
        self.children: list[Node] = []

    def alike(self, other: "Node") -> bool:
        return self.kind == other.kind

    def dump(self) -> list:
        """As nested lists, for JSON."""
        flags = "".join("01"[x] for x in (self.main, self.links, self.slot, self.optional, self.repeated))
        return [self.kind, self.text, flags, [child.dump() for child in self.children]]

    @classmethod
    def load(cls, parts: list) -> "Node":
        main, links, slot, optional, repeated = (x == "1" for x in parts[2])
        node = cls(parts[0], parts[1], main, links)
        node.slot, node.optional, node.repeated = slot, optional, repeated
        node.children = [cls.load(child) for child in parts[3]]
        return node


def _name(text: str) -> str:
    """A short name of a text; wrappers only ask whether texts are equal."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def page_tree(page: str) -> Node:
    """A page as a tree of its texts, without what lies deeper than a wrapper goes."""
    root = Node("")
    last: list[tuple[str, Node]] = []
    for path, main, text, links in blocks(page):
        path = path[:MAX_DEPTH]
        keep = 0
        while keep < min(len(path), len(last)) and last[keep][0] == path[keep]:
            keep += 1
        del last[keep:]
        node = last[-1][1] if last else root
        for kind in path[keep:]:
            node.children.append(Node(kind))
            node = node.children[-1]
            last.append((kind, node))
        node.children.append(Node(None, _name(text), main, links))
    return root


def fold(node: Node) -> Node:
    """Neighbours of one kind, and runs of up to `LONGEST_RUN` neighbours that come again, become repeated groups."""
    children: list[Node] = []
    for child in map(fold, node.children):
        children.append(child)
        size = 1
        while size <= LONGEST_RUN:
            again, before = children[-size:], children[-2 * size: -size]
            if len(before) == size and all(map(Node.alike, before, again)):
                del children[-2 * size:]
                for one, other in zip(before, again):
                    children.append(align(one, other))
                    children[-1].repeated = True
                size = 0
            size += 1
    node.children = children
    return node


def align(one: Node, other: Node) -> Node:
    """The least wrapper that has both: differing texts become a slot, missing parts optional."""
    made = Node(one.kind, one.text, one.main or other.main, one.links and other.links)
    made.optional, made.repeated = one.optional or other.optional, one.repeated or other.repeated
    made.slot = one.slot or other.slot or one.text != other.text
    if made.slot:
        made.text = None
    a, b = one.children, other.children
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].alike(b[j]) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].alike(b[j]):
            made.children.append(align(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            part, i = a[i], i + 1
        else:
            part, j = b[j], j + 1
        part.optional = True
        if made.children and made.children[-1].alike(part):
            part = align(made.children.pop(), part)
            part.repeated = True
        made.children.append(part)
    return made


def infer(pages: list[str]) -> Node:
    """The wrapper of some pages of a host."""
    return reduce(align, (fold(page_tree(page)) for page in pages)) if pages else Node("")


def furniture(wrapper: Node, pages: int) -> list[str]:
    """Places of a wrapper, by path, that hold no article: outside of `article` and `main`, repeated groups of links,
    and texts that are equal on all of `LEAST_PAGES` or more different pages. A path that also holds other text is
    none of them."""
    places: list[tuple[str, bool]] = []

    def walk(node: Node, path: tuple[str, ...], repeated: bool, optional: bool) -> None:
        for child in node.children:
            again, maybe = repeated or child.repeated, optional or child.optional
            if child.kind is None:
                constant = pages >= LEAST_PAGES and not child.slot and not maybe
                places.append((" ".join(path), not child.main and (child.links and again or constant)))
            else:
                walk(child, (*path, child.kind), again, maybe)

    walk(wrapper, (), False, False)
    return sorted({path for path, no in places if no} - {path for path, no in places if not no})


def article(page: str, drop: frozenset[str]) -> str:
    """Text of a page's article: its blocks joined by an empty line.

    If the page has text in `article` or `main`, these blocks; else all but those
    at the wrapper's furniture.
    """
    found = [(" ".join(path[:MAX_DEPTH]), main, text) for path, main, text, _ in blocks(page)]
    marked = any(main for _, main, _ in found)
    return "\n\n".join(text for path, main, text in found if (main if marked else path not in drop))


def _packed(wrapper: Node, seen: list[str]) -> dict:
    return {"wrapper": json.dumps(wrapper.dump(), separators=(",", ":")), "seen": seen}


def _wrappers(rows: DataFrame) -> DataFrame:
    """One wrapper of each host from all its pages: `host`, `wrapper` and names of up to `LEAST_PAGES` pages, `seen`."""
    schema = "host string, piece long, wrapper string, seen array<string>"
    types = pa.schema([("host", pa.string()), ("piece", pa.int64()), ("wrapper", pa.string()),
                       ("seen", pa.list_(pa.string()))])

    def infer_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Node, list[str]]] = {}
        piece = 0

        def out() -> Iterator[pa.RecordBatch]:
            for host, (wrapper, seen) in sorted(known.items(), key=lambda item: item[0].encode()):
                yield pa.RecordBatch.from_pylist([{"host": host, "piece": piece, **_packed(wrapper, seen)}], types)
            known.clear()

        for batch in batches:
            for host, number, page in zip(batch["host"].to_pylist(), batch["piece"].to_pylist(), batch["html"]):
                page, piece = page.as_py(), number
                tree, name = fold(page_tree(page)), _name(page)
                if host in known:
                    wrapper, seen = known[host]
                    known[host] = align(wrapper, tree), sorted({*seen, name})[:LEAST_PAGES]
                else:
                    known[host] = tree, [name]
                if len(known) > HOSTS_AT_ONCE:
                    yield from out()
        yield from out()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        packed = sorted(table["wrapper"].to_pylist(), key=str.encode)
        seen = sorted({name for names in table["seen"].to_pylist() for name in names})[:LEAST_PAGES]
        whole = reduce(align, (Node.load(json.loads(one)) for one in packed))
        return pa.Table.from_pylist([{"host": key[0].as_py(), "piece": key[1].as_py(), **_packed(whole, seen)}], types)

    made = common.materialize(rows.where("html is not null").select(
        "host", F.spark_partition_id().cast("long").alias("piece"), "html").mapInArrow(infer_part, schema))
    while True:
        made = made.withColumn("piece", F.expr(f"piece div {FAN_IN}"))
        made = common.materialize(made.groupBy("host", "piece").applyInArrow(merge, schema))
        if (made.agg(F.max("piece")).first()[0] or 0) == 0:
            return made.drop("piece")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html",
            keep: list[str] | None = None) -> DataFrame:
    """Add `text`, the article of the page, to every row's columns `keep`, or all.

    Text in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments is left out, by tag, class, id and role; what
    remains follows the wrapper of all pages of the host (see `furniture`).
    Character references are decoded, white space in a block becomes one space.
    Null and empty pages give an empty text, an empty table an empty one; pages
    without a host share one wrapper; repeated rows give equal texts and count as
    one page. Ids are not looked at. A column named `text` is replaced.
    """
    kept = [c for c in pages.columns if c != "text" and (keep is None or c in keep)]
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST"))), F.lit(""))
    rows = pages.select(*[F.col(c).alias(f"c_{c}") for c in kept], host.alias("host"), F.col(html_col).alias("html"))

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = [json.dumps(furniture(Node.load(json.loads(one)), len(seen)))
                     for one, seen in zip(batch["wrapper"].to_pylist(), batch["seen"].to_pylist())]
            yield pa.record_batch({"name": batch["host"], "rule": pa.array(drops, pa.string())})

    wrappers = common.materialize(_wrappers(rows).mapInArrow(rule, "name string, rule string"))
    size = wrappers.agg(F.sum(F.length("rule") + F.length("name"))).first()[0] or 0
    wrappers = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    joined = rows.join(wrappers, rows["host"] == wrappers["name"], "left").drop("name", "host")
    schema = joined.select(*[F.col(f"c_{c}").alias(c) for c in kept], F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, frozenset[str]] = {None: frozenset()}
        for batch in batches:
            texts = []
            for page, rule in zip(batch["html"], batch["rule"].to_pylist()):
                if rule not in known:
                    known[rule] = frozenset(json.loads(rule))
                texts.append(article(page.as_py() or "", known[rule]))
            yield pa.record_batch([*(batch[f"c_{c}"] for c in kept), pa.array(texts, pa.string())],
                                  names=[*kept, "text"])

    return joined.mapInArrow(run, schema)
