"""Main text of web pages by union-free regular-expression inference (wrappers).

A page becomes a tree of block elements, labelled by tag and marks (class, id, role), whose inline content is runs of
text. Neighbours that repeat fold into groups, (...)+ , and their insides are aligned. The expressions of a host's
pages are then aligned one after the other: equal labels meet, what only one side has becomes an optional group,
(...)?, repeated groups are aligned inside, equal strings of a slot stay template and differing ones make it a text
slot. The outcome is the host's wrapper, a regular expression without unions, with the pages, characters, link
characters and frequent strings of its parts. It decides which slots are text:

* strings that a slot has on at least half of a host's pages (MIN_PAGES different ones at least) are template: out;
* parts that are mostly links, several a page, are menus: out;
* elements for navigation, headers, footers, asides, forms, scripts and styles, ARIA landmarks of these, and adverts
  and comments that say so in a whole class word are out;
* other class words (sidebar, tags, notice ...) are only hints: they count together with one of the first two, or,
  outside the article, with a small share of the text;
* headings of template that lead to text that varies, and unmarked paragraphs of template between such text, stay: they
  are an article's own ("Abstract", "Method"); so does a list of varying links beside varying text: its references;
* where there is an article or a main block, only its slots are in. There an element of its own (a container, or one
  with marks) whose strings are all template is a notice, and one whose links are, a menu: out. All else stays. Of
  several articles those that begin with a link of their whole first run are teasers of other pages: out beside
  one that doesn't.

What would take the greater part of a page away (a host of copies of one page) isn't applied to that page. Elements
deeper than DEPTH stand in the wrapper beside their holder instead of in it. Optional parts that were seen least, once
a wrapper has more than PARTS, are judged by the page alone. Numbers in ids, and of three and more digits in class
words, are one mark.

Pages of a partition are aligned there, host by host; the partial wrappers of a host are merged in a tree of groups of
at most FAN, so no task sees all pages, or all partial wrappers, of a host.

Results for odd input: null html is empty and gives no text; a page without tags is one block of text; broken
or cut-off markup is closed at the end; very long and very deep pages are read whole; a null or odd url is a host of
its own, ""; repeated pages give a row each; pages that tie in everything are judged alike; an empty table gives no
rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, columns
from tessera.session import materialize

#: Levels of elements that a wrapper nests, its most parts, parts side by side that are aligned in order, the strings that a slot remembers, partial wrappers that are merged at once.
DEPTH, PARTS, WIDE, STRINGS, FAN = 100, 2000, 256, 64, 64
#: Different pages of a host from which on a repeated string is template, and the share of the pages that must have it.
MIN_PAGES, TEMPLATE = 3, 0.5
#: Link characters among all, and links a page, of a menu; the share of a page's text below which a hint counts outside the article; what is never taken away.
MENU_SHARE, MENU_LINKS, SMALL, MOST = 0.6, 2.5, 0.3, 0.85
#: Bytes of wrappers that may be broadcast; above that they are joined by host.
BROADCAST = 32 << 20

# HTML element names by role, and ARIA landmarks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg textarea title iframe object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUT_TAGS = frozenset("nav footer header aside form head script style noscript template svg textarea title iframe object canvas button select option dialog menu figure-ad".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption legend summary".split())
CONTAINERS = frozenset("div section ul ol dl table".split())
LISTS = frozenset("ul ol dl".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search menubar menu toolbar dialog alertdialog form".split())
CLOSED_BY = {"p": frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 section article aside header footer nav form pre blockquote dl figure main hr".split()),
             "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
# Whole class words of adverts and reader comments, and of containers whose articles aren't the page's own.
PLAIN_MARKS = frozenset("ad ads advert adverts advertisement advertising sponsored comments commentlist comment-list reader-comments disqus cookie-notice cookie-banner newsletter".split())
OWN_ARTICLES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus reply replies respond newsletter related recommended".split())
# Class words that hint at something beside the article, and first words like has- that speak of what is beside the element.
HINTS = OWN_ARTICLES | frozenset("""banner sponsor promo popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer header masthead toolbar
comment reply replies respond notice notices cookie cookies consent alert subscribe subscription signup login share sharing social related recommended
widget widgets pagination pager search tags legal copyright""".split())
MODIFIERS = frozenset("has no not with without".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<(?=[^a-zA-Z/!?])|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
TEXT, GROUP = "#", "+"


def lex(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): kind is open, close or text; open has the class and id words as value."""
    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        piece = m[0] if m else page[pos]
        pos = m.end() if m else pos + 1
        if piece[0] != "<" or len(piece) == 1 or not (piece[1].isalpha() or piece[1] in "/!?"):
            yield "text", TEXT, piece
            continue
        if piece[1] in "!?":
            continue
        name = _NAME.match(piece)
        if not name:
            continue
        tag = name[1].lower()
        if piece[1] == "/":
            yield "close", tag, ""
            continue
        marks = []
        if "=" in piece:
            for k, a, b, c in _ATTR.findall(piece):
                if (k := k.lower()) in ("class", "id", "role"):
                    marks += re.split(r"[\s_]+", re.sub(r"\d{3,}" if k == "class" else r"\d+", "0", (a or b or c).lower()))
        yield "open", tag, " ".join(sorted({w for w in marks if w}))
        if tag in RAW and not piece.endswith("/>"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = end.start() if end else n


class Node:
    """A block element with its parts in order, or a run of text. chars, link_chars and links count all that is below."""

    __slots__ = ("label", "tag", "parts", "text", "chars", "link_chars", "links", "path", "base", "depth")

    def __init__(self, label: str, parent: Node | None, text: str = "", link_chars: int = 0, links: int = 0):
        self.label, self.tag = label, label.split(" ", 1)[0]
        self.parts: list[Node] = []
        self.text, self.chars, self.link_chars, self.links = text, len(text), link_chars, links
        self.path = zlib.crc32(label.encode("utf-8", "surrogatepass"), parent.base if parent else 0)
        self.depth = parent.depth + 1 if parent else 0
        self.base = parent.base if parent and self.depth >= DEPTH else self.path  # what paths below go on from


def _marked(label: str, words: frozenset, parts: bool = False) -> bool:
    """Whether a mark is one of the words, or with parts begins or ends with one before or after a hyphen."""
    for w in label.split(" ")[1:]:
        if w in words:
            return True
        if parts and "-" in w and (ends := w.split("-"))[0] not in MODIFIERS and (ends[0] in words or ends[-1] in words):
            return True
    return False


def parse(page: str) -> list[Node]:
    """The nodes of a page, parents before their children; the first is the root. Iterative: depth doesn't matter."""
    root = Node("", None)
    nodes = [root]
    names: list[str] = []  # open elements, inline ones too
    owner = [root]  # the block that content of each open element goes to
    count: dict[str, int] = {}
    words: list[str] = []
    linked: list[str] = []
    state = [0, 0]  # open links, links begun in this run
    skip = 0  # depth of open inline elements that are out

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                link = " ".join(entities.unescape("".join(linked)).split())
                run = Node(TEXT, owner[-1], text, min(len(link), len(text)), state[1])
                owner[-1].parts.append(run)
                nodes.append(run)
            words.clear()
        linked.clear()
        state[1] = 0

    def close() -> None:
        nonlocal skip
        name = names.pop()
        count[name] -= 1
        if owner[-1] is not owner[-2]:
            flush()
        owner.pop()
        if name == "a":
            state[0] -= 1
        if skip > len(names):
            skip = 0

    for kind, tag, value in lex(page):
        if kind == "text":
            if not skip:
                words.append(value)
                if state[0]:
                    linked.append(value)
        elif kind == "open":
            # an unclosed b or i ends with its paragraph: paragraphs close over inline elements
            while names:
                k = len(names) - 1
                while k >= 0 and names[k] in INLINE and tag not in INLINE:
                    k -= 1
                if k >= 0 and tag in CLOSED_BY.get(names[k], ()):
                    while len(names) > k:
                        close()
                else:
                    break
            label = f"{tag} {value}".rstrip()
            if tag in INLINE:
                if tag == "br":
                    words.append(" ")
                if tag in VOID:
                    continue
                if tag == "a":
                    state[0] += 1
                    state[1] += 1
                names.append(tag)
                owner.append(owner[-1])
                if not skip and value and _marked(label, PLAIN_MARKS):
                    skip = len(names)
            else:
                flush()
                node = Node(label, owner[-1])
                owner[-1].parts.append(node)
                nodes.append(node)
                if tag in VOID or tag in RAW:
                    continue
                names.append(tag)
                owner.append(node)
            count[tag] = count.get(tag, 0) + 1
        elif count.get(tag):
            while names[-1] != tag:
                close()
            close()
    while names:
        close()
    flush()
    parent = {id(c): n for n in nodes for c in n.parts}
    for n in reversed(nodes[1:]):
        up = parent[id(n)]
        up.chars += n.chars
        up.link_chars += n.link_chars
        up.links += n.links
    return nodes


# -- expressions: a part is [label, parts, pages, chars, link chars, links, strings]; a group has the label "+"; of a slot strings are its texts' hashes and pages

def _hash(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    return f"{zlib.crc32(raw):08x}{zlib.adler32(raw) & 0xFFFF:04x}"


def expression(nodes: list[Node]) -> dict:
    """A page's expression: its parts, one page, and a hash of it."""
    root = nodes[0]

    def of(node: Node) -> list:
        if node.label == TEXT:
            return [TEXT, [], 1, node.chars, node.link_chars, node.links, {_hash(node.text): 1}]
        inside = [] if node.tag in OUT_TAGS or node.depth >= DEPTH else fold([of(c) for c in level(node)])
        return [node.label, inside, 1, node.chars, node.link_chars, node.links, {}]

    def level(node: Node) -> list[Node]:
        """The parts of a node; from DEPTH on with all that is below them, in page order."""
        if node.depth + 1 < DEPTH:
            return node.parts
        out, todo = [], list(reversed(node.parts))
        while todo:
            x = todo.pop()
            out.append(x)
            if x.tag not in OUT_TAGS:
                todo.extend(reversed(x.parts))
        return out

    return {"pages": 1, "kinds": [zlib.crc32("\n".join(n.text for n in nodes if n.label == TEXT).encode("utf-8", "surrogatepass"))], "chars": root.chars, "parts": fold([of(c) for c in root.parts])}


def _head(part: list) -> str:
    """What parts must have in common to be aligned: the label, or that of the first of a group."""
    while part[0] == GROUP:
        part = part[1][0]
    return part[0]


def _core(part: list) -> list:
    return part[1] if part[0] == GROUP else [part]


def fold(parts: list[list]) -> list[list]:
    """Neighbours that repeat, the shortest period first, become groups; a list of over WIDE parts that still doesn't is one loose group."""
    width = 1
    while 2 * width <= len(parts) and (width <= 16 or len(parts) <= WIDE):
        heads = [_head(p) for p in parts]
        if len(set(heads)) == len(heads):
            break
        n = len(parts)
        ahead = [0] * (n + 1)  # how many places from k on agree with those width later
        for k in range(n - width - 1, -1, -1):
            ahead[k] = ahead[k + 1] + 1 if heads[k] == heads[k + width] else 0
        out, k = [], 0
        while k < n:
            if ahead[k] >= width:
                times = ahead[k] // width + 1
                reps = [parts[k + i * width:k + (i + 1) * width] for i in range(times)]
                body = reps[0] if width > 1 else _core(reps[0][0])
                for r in reps[1:]:
                    body = merge(body, r if width > 1 else _core(r[0]), False)
                out.append(_group(body, [p for r in reps for p in r]))
                k += times * width
            else:
                out.append(parts[k])
                k += 1
        width = 1 if len(out) < n and width > 1 else width + 1
        parts = out
    return loose(parts, False)


def _group(body: list[list], parts: list[list]) -> list:
    return [GROUP, body, max(p[2] for p in parts), *(sum(p[i] for p in parts) for i in (3, 4, 5)), {}]


def loose(parts: list[list], across: bool) -> list[list]:
    """A list of over WIDE parts as (a? b? c?)+ , each head once; shorter ones as they are. Bounds the alignment's work."""
    if len(parts) <= WIDE or len({_head(p) for p in parts}) == len(parts):
        return parts
    body: dict[str, list] = {}
    for p in parts:
        for c in _core(p):
            h = _head(c)
            body[h] = _both(body[h], c, across) if h in body else c
    return [_group(list(body.values()), parts)]


def _strings(x: dict, y: dict, across: bool) -> dict:
    """Pages by string; the rarest give way, all counts less what the first beyond STRINGS has."""
    if not x or not y:
        out = dict(x or y)
    else:
        out = dict(x)
        for k, v in y.items():
            out[k] = out.get(k, 0) + v if across else max(out.get(k, 0), v)
    if len(out) > STRINGS:
        less = sorted(out.values(), reverse=True)[STRINGS]
        out = {k: v - less for k, v in out.items() if v > less} if across else dict(sorted(out.items())[:STRINGS])
    return out


def _both(x: list, y: list, across: bool) -> list:
    """Two aligned parts as one. across: of different pages."""
    stats = [x[2] + y[2] if across else max(x[2], y[2]), x[3] + y[3], x[4] + y[4], x[5] + y[5], _strings(x[6], y[6], across)]
    if x[0] == GROUP or y[0] == GROUP:
        return [GROUP, merge(_core(x), _core(y), across), *stats]
    return [x[0], merge(x[1], y[1], across), *stats]


def merge(a: list[list], b: list[list], across: bool = True) -> list[list]:
    """The least general parts found that cover both lists."""
    if not a or not b:
        return a or b
    heads = [_head(x) for x in a], [_head(x) for x in b]
    if heads[0] == heads[1]:
        return [_both(x, y, across) for x, y in zip(a, b, strict=True)]
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, *heads, autojunk=False).get_opcodes():
        if op == "equal":
            out += [_both(x, y, across) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [*a[i:j], *b[k:m]]
    squeezed: list = []
    for x in out:  # neighbours with one head are a group
        if squeezed and _head(squeezed[-1]) == _head(x):
            y = squeezed[-1]
            both = _both(y, x, True)
            both[2] = max(y[2], x[2])
            squeezed[-1] = both if both[0] == GROUP else [GROUP, [both], *both[2:6], {}]
        else:
            squeezed.append(x)
    return loose(squeezed, across)


def _size(parts: list[list]) -> int:
    return sum(1 + _size(p[1]) for p in parts)


def _without(parts: list[list], pages: int) -> list[list]:
    """Parts seen on more than that many pages."""
    kept = [[p[0], _without(p[1], pages), *p[2:]] for p in parts if p[2] > pages]
    return [p for p in kept if p[0] != GROUP or p[1]]


def align(x: dict | None, y: dict) -> dict:
    """The wrapper of what two wrappers cover."""
    if x is None:
        return y
    out = {"pages": x["pages"] + y["pages"], "kinds": sorted({*x["kinds"], *y["kinds"]})[:MIN_PAGES], "chars": x["chars"] + y["chars"], "parts": merge(x["parts"], y["parts"])}
    least = 1
    while _size(out["parts"]) > PARTS and least < out["pages"]:
        out["parts"] = _without(out["parts"], least)
        least *= 2
    return out


def regex(wrapper: dict) -> str:
    """The wrapper as a regular expression without unions: ( )+ repeats, ( )? is optional, "..." a template string, # a text slot."""
    def of(p: list, pages: int) -> str:
        inside = " ".join(of(c, p[2]) for c in p[1])
        if p[0] == GROUP:
            made = f"({inside})+"
        elif p[0] == TEXT:
            made = f'"{next(iter(p[6]))}"' if list(p[6].values()) == [p[2]] and p[2] > 1 else TEXT
        else:
            made = f"<{p[0]}>{inside}</>"
        return made if p[2] >= pages else f"({made})?"
    return " ".join(of(p, wrapper["pages"]) for p in wrapper["parts"])


class Rules:
    """What a wrapper says of its slots, by the crc of the labels on the way to them."""

    def __init__(self, wrapper: dict):
        self.template: dict[int, set[str]] = {}
        self.menus: set[int] = set()
        pages = wrapper["pages"]
        known = len(wrapper["kinds"]) >= MIN_PAGES
        stats: dict[int, list[int]] = {}

        def walk(parts: list[list], path: int) -> None:
            for p in parts:
                if p[0] == GROUP:
                    walk(p[1], path)
                    continue
                here = zlib.crc32(p[0].encode("utf-8", "surrogatepass"), path)
                if p[0] == TEXT:
                    if known and (often := {k for k, v in p[6].items() if v >= TEMPLATE * pages}):
                        self.template.setdefault(here, set()).update(often)
                    continue
                s = stats.setdefault(here, [0, 0, 0, 0])
                for i in range(4):
                    s[i] += p[2 + i]
                walk(p[1], here)

        walk(wrapper["parts"], 0)
        plain = sum(p[3] - p[4] for p in wrapper["parts"])
        self.known = known
        for here, (n, chars, link_chars, links) in stats.items():
            if links >= MENU_LINKS * n and link_chars >= MENU_SHARE * chars and 2 * (chars - link_chars) <= plain:
                self.menus.add(here)


def _roles(label: str) -> bool:
    return not OUT_ROLES.isdisjoint(label.split(" ")[1:])


def _teaser(article: Node) -> bool:
    """Whether the first run is a link from end to end."""
    todo = [article]
    while todo:
        x = todo.pop()
        if x.label == TEXT:
            return x.link_chars >= x.chars
        todo.extend(c for c in reversed(x.parts) if c.chars and c.tag not in OUT_TAGS)
    return False


def read_page(nodes: list[Node], rules: Rules) -> str:
    """The text of the slots that are in, block by block."""
    root = nodes[0]

    def main_inside(top: Node) -> list[Node]:
        """The outermost main blocks, or else the page's own articles, that have text."""
        found: dict[str, list[Node]] = {"main": [], "article": []}
        todo = [(c, True) for c in reversed(top.parts)]
        while todo:
            x, own = todo.pop()
            if x.label == TEXT or not x.chars or x.tag in OUT_TAGS or _roles(x.label):
                continue
            own = own and not _marked(x.label, OWN_ARTICLES, True)
            if x.tag == "main" or x.tag == "article" and own:
                found[x.tag].append(x)
            if x.tag != "main":
                todo += [(c, own and x.tag != "article") for c in reversed(x.parts)]
        return found["main"] or found["article"]

    mains = main_inside(root)
    if len(mains) > 1 and not all(teasers := [_teaser(m) for m in mains]):
        mains = [m for m, other in zip(mains, teasers, strict=True) if not other]
    holders = set()  # what holds a main block is never out for its marks
    up = {id(c): n for n in nodes for c in n.parts}
    for m in mains:
        x = m
        while x is not None and id(x) not in holders:
            holders.add(id(x))
            x = up.get(id(x))

    fixed = {id(n) for n in nodes if n.label == TEXT and n.path in rules.template and _hash(n.text) in rules.template[n.path]}
    # Of each node: runs that vary, their characters outside links, and template runs outside titles.
    varying, plain, notices = ({id(n): 0 for n in nodes} for _ in range(3))
    for n in reversed(nodes[1:]):
        me, above = id(n), id(up[id(n)])
        if n.label == TEXT:
            varying[me], plain[me], notices[me] = int(me not in fixed), 0 if me in fixed else n.chars - n.link_chars, int(me in fixed)
        elif n.tag in OUT_TAGS:
            continue
        varying[above] += varying[me]
        plain[above] += plain[me]
        notices[above] += 0 if n.tag in TITLES else notices[me]
    around: dict[int, tuple[set[int], set[int], set[int]]] = {}

    def beside(holder: Node) -> tuple[set[int], set[int], set[int]]:
        """Parts of a node before which text varies, after which it does, and titles that lead to such text."""
        if id(holder) not in around:
            before, after, leads = set(), set(), set()
            seen = False
            for c in holder.parts:
                if seen:
                    before.add(id(c))
                seen = seen or plain[id(c)] > 0 and c.tag not in TITLES
            seen, open_to = False, [False] * 10
            for c in reversed(holder.parts):
                if seen:
                    after.add(id(c))
                if c.tag in TITLES:
                    rank = int(c.tag[1]) if c.tag[0] == "h" else 7
                    if open_to[rank]:
                        leads.add(id(c))
                    open_to[rank:] = [False] * (10 - rank)  # what follows this title is hidden from lower ones before it
                elif plain[id(c)]:
                    seen, open_to = True, [True] * 10
            around[id(holder)] = before, after, leads
        return around[id(holder)]

    def own(run: Node) -> bool:
        """Whether a template run is the article's: a title that leads to varying text, or an unmarked paragraph inside such text."""
        block = up[id(run)]
        holder = up.get(id(block))
        if holder is None:
            return False
        before, after, leads = beside(holder)
        return id(block) in leads if block.tag in TITLES else " " not in block.label and block.tag not in CONTAINERS and id(block) in before and id(block) in after

    def references(node: Node) -> bool:
        """An unmarked list of varying links after varying text of the same block."""
        return node.tag in LISTS and " " not in node.label and varying[id(node)] > 0 and id(node) in beside(up[id(node)])[0]

    def notice(node: Node) -> bool:
        """An element of its own, of template alone, that isn't only titles."""
        return not varying[id(node)] and notices[id(node)] > 0 and node.tag not in TITLES and (node.tag in CONTAINERS or " " in node.label)

    def out(node: Node, inside: bool) -> bool:
        if node.tag in OUT_TAGS or _roles(node.label):
            return not (node.tag == "header" and inside and any(c.tag in HEADINGS for c in node.parts))
        if id(node) in holders:
            return False
        menu = node.path in rules.menus
        if menu and not inside:
            return True
        if " " not in node.label or 2 * node.chars > root.chars and not inside:
            return False
        if _marked(node.label, PLAIN_MARKS):
            return True
        if _marked(node.label, HINTS, node.tag in CONTAINERS):
            if menu or not varying[id(node)]:
                return True
            return not inside and node.chars < SMALL * root.chars and (not rules.known or _marked(node.label, HINTS) or _marked(node.label, OWN_ARTICLES, True))
        return False

    def collect(top: Node, inside: bool) -> list[tuple[str, bool]]:
        """Runs that are in, with whether they are template."""
        got: list[tuple[str, bool]] = []
        todo = [(c, False, False) for c in reversed(top.parts)]
        while todo:
            x, listed, noticed = todo.pop()
            if x.label == TEXT:
                got.append((x.text, noticed if inside else id(x) in fixed and not own(x)))
            elif x.chars:
                listed = listed or not inside and references(x)
                if not out(x, inside or listed):
                    noticed = noticed or inside and id(x) not in holders and notice(x)
                    todo.extend((c, listed, noticed) for c in reversed(x.parts))
        return got

    got = [x for m in mains or [root] for x in collect(m, bool(mains))]
    if sum(len(t) for t, x in got if x) > MOST * sum(len(t) for t, _ in got):
        return "\n".join(t for t, _ in got)
    return "\n".join(t for t, x in got if not x)


def fold_wrappers(exprs: list[str]) -> str:
    """Aligns wrappers, given as JSON, one after the other in a fixed order."""
    out: dict | None = None
    for e in sorted(exprs, key=lambda x: (len(x), x)):
        out = align(out, json.loads(e))
    return _dumps(out or {"pages": 0, "kinds": [], "chars": 0, "parts": []})


def _dumps(wrapper: dict) -> str:
    return json.dumps(wrapper, separators=(",", ":"), ensure_ascii=True)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def wrappers(pages: DataFrame, fan: int = FAN, hosts: int = 2000) -> DataFrame:
    """host, wrapper: the regular expression of each host as JSON. pages: url, html."""
    bounded_batches(pages.sparkSession)
    body = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, dict] = {}

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(map(_dumps, own.values()), pa.string())], ["host", "wrapper"])
            own.clear()
            return made

        for b in batches:
            for host, page in zip(*columns(b, "host", "html"), strict=True):
                own[host] = align(own.get(host), expression(parse(page)))
                if len(own) >= hosts:
                    yield full()
        if own:
            yield full()

    folded = F.pandas_udf(lambda s: s.map(lambda x: fold_wrappers(list(x))), "string")
    now = materialize(body.mapInArrow(run, "host string, wrapper string"), "partial")
    while True:
        counts = now.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now
        split = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / fan)).cast("int")
        grouped = now.join(counts, "host").groupBy("host", split.alias("part")).agg(F.collect_list("wrapper").alias("all"))
        now = materialize(grouped.select("host", folded("all").alias("wrapper")), "merged")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    bounded_batches(pages.sparkSession)
    body = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = wrappers(body)
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    keyed = body.withColumn("host", host_of(F.col("url")))
    joined = keyed.join(F.broadcast(found) if size <= BROADCAST else found, "host", "left").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Rules] = {}
        for b in batches:
            ids, url, page, wrapper = columns(b, "page_id", "url", "html", "wrapper")
            text = []
            for p, w in zip(page, wrapper, strict=True):
                if w not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[w] = Rules(json.loads(w))
                text.append(read_page(parse(p), known[w]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(url, pa.string()), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
