"""A small tolerant HTML tree on the standard library's parser, and the edits and readings made on it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from quire.functions.urls import resolve, safe_media

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Opening a key ends an open value, unless one of the fences lies between.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tbody"}, "tfoot": {"tr", "td", "th", "tbody"}} | {b: {"p"} for b in BLOCK}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"table", "td", "th", "button", "object"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}

# Peripheral parts of a page.
NON_CONTENT = (
    "script", "style", "noscript",
    ".ad", ".advertisement", '[class*="advert"]',
    ".social-share", ".share-buttons", ".share-icons", '[class*="social-"]',
    "#comments", ".comments", ".comment-section", ".comment-list", ".comment-thread", ".comment-form", '[id*="comment"]', '[class*="comment-"]',
    "#disqus_thread", ".disqus-comments",
    "#respond", ".wp-comments-area", ".post-comments",
    ".discussion", ".discussions", '[class*="discussion"]',
    ".related-posts", ".related-articles", ".recommended", ".recommendations", '[class*="related-"]', ".read-more", ".more-articles", ".you-may-like", ".also-read",
    ".newsletter-signup", ".newsletter", ".subscribe", '[class*="newsletter"]', '[class*="subscribe"]',
    "nav", "footer:not(.chapter footer)", "header:not(.chapter header)", ".sidebar", "aside",
    ".cookie-banner", ".cookie-consent", '[class*="cookie"]', ".popup", ".modal", ".overlay",
)
# Where the next page's address may stand, in order; lazy images' attributes; styles of code.
NEXT_PAGE = ("a.next", 'a[rel="next"]', 'a[aria-label*="next" i]', "a.pagination__next", "a.pagination-next", 'a[class*="next" i]', 'link[rel="next"]', ".pagination a:last-child")
LOAD_MORE_CONTROLS = ('[data-action="load-more"]', ".load-more", ".show-more", "button.expand", "button", "a[href]", '[role="button"]')
CONTENT_ROOTS = ("article", "main", '[role="main"]', ".content")
LAZY_SOURCES = ("data-src", "data-lazy-src", "data-original", "data-lazy")
PRE_STYLE = "; white-space: pre-wrap; font-family: monospace; background-color: #f5f5f5; padding: 10px; border-radius: 4px; overflow-x: auto;"
CODE_STYLE = "; white-space: pre; font-family: monospace; background-color: #f5f5f5; padding: 2px 4px; border-radius: 3px;"
# What stands for an embed.
EMBED_LABEL = "[Embedded Media]"
EMBED_LINK = {"target": "_blank", "rel": "noopener noreferrer"}


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], None

    def add(self, kid) -> None:
        if isinstance(kid, Node):
            kid.parent = self
        self.kids.append(kid)

    def place(self) -> int:
        return next(i for i, k in enumerate(self.parent.kids) if k is self)

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.kids[self.place()]
            self.parent = None

    def swap(self, new) -> None:
        parent, i = self.parent, self.place()
        parent.kids[i] = new
        if isinstance(new, Node):
            new.parent = parent
        self.parent = None

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; a fixed list, so edits don't disturb it."""
        out, todo = [], [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
        return iter(out)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, Node):
                todo += reversed(k.kids)
            elif not isinstance(k, Comment):
                out.append(k)
        return "".join(out)

    def above(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class Comment(str):
    pass


def exchange(pairs: list[tuple[Node, object]]) -> None:
    """Puts what is given in the place of each element, nothing for None; a parent's children are gone through once."""
    new = {id(e): x for e, x in pairs}
    for parent in {id(e.parent): e.parent for e, _ in pairs if e.parent is not None}.values():
        kids, parent.kids = parent.kids, []
        for k in kids:
            k = new[id(k)] if id(k) in new else k
            if k is not None:
                parent.add(k)
    for e, _ in pairs:
        e.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.count = Counter()

    def _end(self, i: int) -> None:
        self.count.subtract(n.tag for n in self.open[i:])
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1) if any(self.count[e] > 0 for e in ends) else ():
            name = self.open[i].tag
            if name in ends:
                self._end(i)
                continue
            if any(name in FENCES.get(e, ()) for e in ends) or (tag not in BLOCK and name in BLOCK and name not in ("p", "div")):
                break
        kept: dict[str, str] = {}
        for k, v in attrs:
            kept.setdefault(k, v or "")
        if tag in ("html", "body") and (seen := next((n for n in self.root.walk() if n.tag == tag), None)):
            seen.attrs = kept | seen.attrs
            return
        node = Node(tag, kept)
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] > 0 else ():
            if self.open[i].tag == tag:
                self._end(i)
                return
        if tag == "br":
            self.open[-1].add(Node("br"))

    def handle_data(self, data):
        self.open[-1].add(data)

    def handle_comment(self, data):
        self.open[-1].add(Comment(data))


def parse(html: str | None) -> Node:
    """The tree of a page or a fragment; never fails."""
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except (AssertionError, ValueError):
        pass
    return b.root


def body(root: Node) -> Node:
    return next(iter(root.find("body")), root)


def _attr(v: str) -> str:
    return v.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")


def inner_html(node: Node) -> str:
    out: list[str] = []
    todo: list = [("in", k, node.tag) for k in reversed(node.kids)]
    while todo:
        what, k, over = todo.pop()
        if what == "out":
            out.append(f"</{k}>")
        elif isinstance(k, Comment):
            out.append(f"<!--{k}-->")
        elif isinstance(k, Node):
            out.append(f"<{k.tag}" + "".join(f' {a}="{_attr(v)}"' for a, v in k.attrs.items()) + ">")
            if k.tag not in VOID:
                todo.append(("out", k.tag, ""))
                todo += [("in", x, k.tag) for x in reversed(k.kids)]
        else:
            out.append(k if over in ("script", "style", "noscript", "iframe", "xmp") else k.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
    return "".join(out)


# -- selectors ---------------------------------------------------------------------------------
_PART = re.compile(r"""^(?P<tag>[a-z0-9]+)?(?P<simple>(?:[.#][\w-]+)*)(?:\[(?P<name>[\w-]+)(?:(?P<how>[*]?=)"(?P<value>[^"]*)"(?P<fold>\ i)?)?\])?(?P<last>:last-child)?(?::not\(\.(?P<under>[\w-]+)\ (?P=tag)\))?$""", re.X)


def selector(text: str):
    """A predicate on elements for the forms used here; a blank means any ancestor."""
    *above, own = text.split(" ") if ":not(" not in text and "[" not in text else [text]
    m = _PART.match(own)
    if m is None:
        raise ValueError(f"no such selector: {text}")
    ids = re.findall(r"#([\w-]+)", m["simple"])
    classes = re.findall(r"\.([\w-]+)", m["simple"])
    higher = [selector(a) for a in above]

    def fits(n: Node) -> bool:
        a = n.attrs
        if m["tag"] and n.tag != m["tag"] or any(a.get("id") != i for i in ids):
            return False
        if classes and not set(classes) <= set(a.get("class", "").split()):
            return False
        if m["name"]:
            v, want = a.get(m["name"]), m["value"]
            if v is None:
                return False
            if want is None:
                want = v
            if m["fold"]:
                v, want = v.lower(), want.lower()
            if (want not in v) if m["how"] == "*=" else (v != want):
                return False
        if m["last"] and (n.parent is None or [k for k in n.parent.kids if isinstance(k, Node)][-1] is not n):
            return False
        if m["under"] and any(m["under"] in x.attrs.get("class", "").split() for x in n.above()):
            return False
        return all(any(h(x) for x in n.above()) for h in higher)

    return fits


class Ranks:
    """For elements: the place of the first selector of a list that fits, found by tag, id, classes and attributes instead of one selector after the other."""

    def __init__(self, selectors: tuple[str, ...]):
        self.by_tag: dict[str, list] = {}
        self.by_id: dict[str, int] = {}
        self.by_class: dict[str, int] = {}
        self.inside: dict[str, list[tuple[str, int]]] = {}
        for i, s in enumerate(selectors):
            if m := re.fullmatch(r"\.([\w-]+)", s):
                self.by_class.setdefault(m[1], i)
            elif m := re.fullmatch(r"#([\w-]+)", s):
                self.by_id.setdefault(m[1], i)
            elif m := re.fullmatch(r'\[([\w-]+)\*="([^"]*)"\]', s):
                self.inside.setdefault(m[1], []).append((m[2], i))
            else:
                self.by_tag.setdefault(re.match(r"[a-z0-9]+", s)[0], []).append((selector(s), i))

    def of(self, n: Node) -> int | None:
        found = [i for fits, i in self.by_tag.get(n.tag, ()) if fits(n)]
        if n.attrs:
            if (i := self.by_id.get(n.attrs.get("id"))) is not None:
                found.append(i)
            found += [i for c in n.attrs.get("class", "").split() if (i := self.by_class.get(c)) is not None]
            found += [i for name, parts in self.inside.items() if (v := n.attrs.get(name)) for part, i in parts if part in v]
        return min(found, default=None)


_NON_CONTENT = Ranks(NON_CONTENT)
_NEXT = [selector(s) for s in NEXT_PAGE]
_CONTROLS = [selector(s) for s in LOAD_MORE_CONTROLS]
_ROOTS = [selector(s) for s in CONTENT_ROOTS]


# -- edits, in place ------------------------------------------------------------------------------
def prune(root: Node) -> int:
    """Drops peripheral parts, then in one pass p, div and span without any child; the number of peripheral parts.

    Selectors take their turns in order, so a part counts unless one above it went in an earlier turn; one walk settles all.
    """
    n, gone, todo = 0, [], [(k, len(NON_CONTENT)) for k in reversed(root.kids) if isinstance(k, Node)]
    while todo:
        e, earliest = todo.pop()
        rank = _NON_CONTENT.of(e)
        if rank is not None:
            n += rank <= earliest
            if earliest == len(NON_CONTENT):
                gone.append(e)
            earliest = min(earliest, rank)
        todo += [(k, earliest) for k in reversed(e.kids) if isinstance(k, Node)]
    exchange([(e, None) for e in gone])
    exchange([(e, None) for e in root.find("p", "div", "span") if not [k for k in e.kids if not isinstance(k, Comment)]])
    return n


def style_code(root: Node) -> None:
    for e in root.find("pre", "code"):
        if e.tag == "pre":
            e.attrs["style"] = e.attrs.get("style", "") + PRE_STYLE
        elif not any(a.tag == "pre" for a in e.above()):
            e.attrs["style"] = e.attrs.get("style", "") + CODE_STYLE


def replace_iframes(root: Node, base: str) -> None:
    """Embeds become a marked paragraph with a link; unsafe ones go."""
    pairs: list[tuple[Node, object]] = []
    for e in root.find("iframe"):
        href = safe_media(e.attrs.get("src"), base)
        p, mark, link = Node("p"), Node("strong"), Node("a", {"href": href or ""} | EMBED_LINK)
        mark.add(EMBED_LABEL)
        link.add(href or "")
        for kid in (mark, " ", link):
            p.add(kid)
        pairs.append((e, p if href else None))
    exchange(pairs)


def strip_links(root: Node) -> int:
    """Links but those within the page become their text; how many."""
    links = [(e, e.text()) for e in root.find("a") if (href := e.attrs.get("href")) and not href.startswith("#")]
    exchange(links)
    return len(links)


def reveal_images(root: Node) -> int:
    """Lazy images get their address and lose the lazy mark; how many attributes changed."""
    n = 0
    for e in root.find("img"):
        if not e.attrs.get("src"):
            lazy = next((v for a in LAZY_SOURCES if (v := e.attrs.get(a))), None)
            if lazy:
                e.attrs["src"] = lazy
                n += 1
        if e.attrs.get("data-srcset"):
            e.attrs["srcset"] = e.attrs["data-srcset"]
            n += 1
        n += e.attrs.pop("loading", None) is not None
    return n


def absolutise(root: Node, base: str) -> None:
    """Addresses of images and links made absolute; one that can't be stays as it is."""
    for e in root.find("img", "a"):
        name = "src" if e.tag == "img" else "href"
        if v := e.attrs.get(name):
            new = resolve(v, base)
            if new is not None:
                e.attrs[name] = new
                if e.tag == "img":
                    e.attrs.pop("srcset", None)
                    e.attrs.pop("loading", None)


# As browsers count white space.
_SPACE = r"[\s\u00a0\ufeff]"


def tidy(html: str) -> str:
    for pattern, new in ((rf"\n{_SPACE}*\n{_SPACE}*\n", "\n\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " ")):
        html = re.sub(pattern, new, html)
    return html.strip().strip("\ufeff")


def absolute_html(html: str, base: str) -> str:
    root = parse(html)
    prune(root)
    absolutise(root, base)
    return tidy(inner_html(body(root)))


# -- readings -----------------------------------------------------------------------------------
def collapse(text: str) -> str:
    return re.sub(rf"{_SPACE}+", " ", text).strip()


def plain_text(html: str | None) -> str:
    return collapse(body(parse(html)).text())


def next_page(root: Node, base: str) -> str | None:
    """Address of the next page: by marked-up link in order of priority, else by a short label that starts with "next"."""
    for fits in _NEXT:
        e = next((e for e in root.walk() if fits(e)), None)
        if e is not None and e.tag in ("a", "link") and e.attrs.get("href") is not None and (out := resolve(e.attrs["href"], base)):
            return out
    for e in root.find("a"):
        label = collapse(e.text())
        if e.attrs.get("href") is not None and len(label) <= 40 and re.match(r"(?i)next(?![A-Za-z0-9_])", label) and (out := resolve(e.attrs["href"], base)):
            return out
    return None


def load_more_target(root: Node) -> str | None:
    """Label of the control that would be clicked for more content: in content roots, else the body, by kind of control, safe links only."""
    for place in [n for n in root.walk() if any(f(n) for f in _ROOTS)] or [body(root)]:
        for fits in _CONTROLS:
            for e in place.walk():
                label = collapse(e.text()) if fits(e) else ""
                unsafe = e.tag == "a" and re.match(r"(?i)(javascript|data|vbscript):", e.attrs.get("href", "").strip())
                if 0 < len(label) <= 80 and not unsafe and re.search(r"(?ai)\b(load more|show more|show all|expand|see more|view all)\b", label):
                    return label
    return None
