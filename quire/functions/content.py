"""The main content of a page by density of text: score, join what stands beside the winner, clean by ratios, retry with looser rules.

A page is measured once from the leaves up; scoring reads those figures, and only what is chosen is copied and
cleaned, so a page of any width costs time linear in its elements for each of at most four attempts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quire.functions import html
from quire.functions.html import BLOCK, Comment, Node, body, collapse, inner_html

# Words in classes and ids and scores of tags, chosen after the published Readability algorithm (Arc90, later Mozilla; Apache License 2.0).
LIKELY = re.compile(r"article|body|content|entry|hentry|main|page|post|story|text|blog|column", re.I)
UNLIKELY = re.compile(r"combx|contact|foot|masthead|media|meta|promo|shopping|tool|widget|menu|banner|breadcrumb|pager|pagination|sponsor|skyscraper|sidebar|share|related|login|gdpr", re.I)
ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog banner search".split())
START = {"article": 25, "main": 20, "section": 8, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "address": -3} | {f"h{i}": -5 for i in range(1, 7)}
BEARERS = frozenset("p pre td blockquote".split())
HOLDERS = frozenset("div section article main figure center".split())
CONTROLS = frozenset("button input select textarea object embed link meta form fieldset footer aside nav".split())
CONDITIONAL = frozenset("div section table ul ol dl header figure".split())
MEDIA = frozenset("img picture video audio svg canvas hr math".split())

#: Text of at least so many characters bears a score, and ends the attempts.
LEAST_BEARING, ENOUGH = 25, 500


@dataclass(frozen=True)
class Rules:
    """What an attempt still insists on."""

    unlikely: bool = True  # parts named like furniture are left out
    weigh: bool = True  # names of classes and ids count
    clean: bool = True  # what is chosen is cleaned by ratios


LADDER = (Rules(), Rules(unlikely=False), Rules(unlikely=False, weigh=False), Rules(False, False, False))


class Measures:
    """Figures of each element below a root, itself included: characters of text, those in links and in lists, commas, and counts of elements."""

    COUNTED = {"p": "paragraphs", "li": "items", "img": "images", "input": "inputs", "th": "heads", "caption": "heads", "tr": "rows"}

    def __init__(self, root: Node):
        self.nodes = [root, *root.walk()]
        self.at = {id(n): i for i, n in enumerate(self.nodes)}
        n = len(self.nodes)
        self.chars, self.linked, self.listed, self.commas = [0] * n, [0.0] * n, [0] * n, [0] * n
        self.counts = {name: [0] * n for name in set(self.COUNTED.values()) | {"media", "titles"}}
        for i, e in enumerate(self.nodes):
            for k in e.kids:
                if not isinstance(k, (Node, Comment)):
                    self.chars[i] += len(" ".join(k.split()))
                    self.commas[i] += sum(k.count(c) for c in ",،、，")
            if name := self.COUNTED.get(e.tag):
                self.counts[name][i] += 1
            if e.tag in MEDIA:
                self.counts["media"][i] += 1
            if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1].isdigit():
                self.counts["titles"][i] += 1
        tables = (self.chars, self.linked, self.listed, self.commas, *self.counts.values())
        for i in range(n - 1, -1, -1):
            e = self.nodes[i]
            if e.tag == "a":
                self.linked[i] = self.chars[i] * (0.3 if e.attrs.get("href", "").startswith("#") else 1)
            elif e.tag in ("ul", "ol"):
                self.listed[i] = self.chars[i]
            if i:
                up = self.at[id(e.parent)]
                for t in tables:
                    t[up] += t[i]

    def link_share(self, e: Node) -> float:
        i = self.at[id(e)]
        return min(1.0, self.linked[i] / self.chars[i]) if self.chars[i] else 0.0

    def of(self, name: str, e: Node) -> int:
        return (self.counts.get(name) or getattr(self, name))[self.at[id(e)]]


def hidden(e: Node) -> bool:
    style = e.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in e.attrs or "display:none" in style or "visibility:hidden" in style or e.attrs.get("aria-hidden") == "true" and "fallback-image" not in e.attrs.get("class", "")


def weight(e: Node) -> int:
    """What an element's names say for it or against it."""
    return sum(25 * bool(LIKELY.search(v)) - 25 * bool(UNLIKELY.search(v)) for a in ("class", "id") if (v := e.attrs.get(a)))


def furniture(e: Node) -> bool:
    names = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"
    return e.tag not in ("body", "a", "article", "main") and (e.attrs.get("role") in ROLES or bool(UNLIKELY.search(names)) and not LIKELY.search(names) and not any(a.tag in ("table", "code", "pre") for a in e.above()))


def _left_out(page: Node, rules: Rules) -> tuple[set[int], bool]:
    """Elements that take no part, with what is below them, and whether names were the reason for any."""
    out, named, todo = set(), False, [k for k in page.kids if isinstance(k, Node)]
    while todo:
        e = todo.pop()
        if hidden(e):
            out.add(id(e))
        elif rules.unlikely and furniture(e):
            out.add(id(e))
            named = True
        else:
            todo += [k for k in e.kids if isinstance(k, Node)]
    return out, named


def _scores(page: Node, m: Measures, skip: set[int], rules: Rules) -> dict[int, float]:
    """Scores of elements by their place: each bearer of text votes for those above it, nearer ones more, and links count against them."""
    votes: dict[int, float] = {}
    todo = [k for k in reversed(page.kids) if isinstance(k, Node)]
    while todo:
        e = todo.pop()
        if id(e) in skip:
            continue
        todo += [k for k in reversed(e.kids) if isinstance(k, Node)]
        if e.tag not in BEARERS and not (e.tag in HOLDERS and not any(isinstance(k, Node) and k.tag in BLOCK for k in e.kids)):
            continue
        i = m.at[id(e)]
        if m.chars[i] < LEAST_BEARING:
            continue
        worth = 1 + m.commas[i] + min(m.chars[i] // 100, 3)
        for depth, up in enumerate(a for a in e.above() if id(a) in m.at):
            if depth > 4:
                break
            at = m.at[id(up)]
            if at not in votes:
                votes[at] = START.get(up.tag, 0) + (weight(up) if rules.weigh else 0)
            votes[at] += worth / (1, 2, 6, 9, 12)[depth]
    return {i: v * (1 - m.link_share(m.nodes[i])) for i, v in votes.items()}


def _winner(m: Measures, scores: dict[int, float]) -> int:
    """The best element; the nearest one above it that holds three more of nearly its score; one above that scores more still, or holds nothing else."""
    best = max(scores, key=lambda i: (scores[i], -i))
    strong = {i for i in sorted(scores, key=lambda i: -scores[i])[1:6] if scores[i] >= 0.75 * scores[best]}
    above = lambda i: [m.at[id(a)] for a in m.nodes[i].above() if id(a) in m.at and m.at[id(a)]]
    if len(strong) >= 3:
        held = [set(above(i)) for i in strong]
        best = next((a for a in above(best) if sum(a in h for h in held) >= 3), best)
    last = scores.get(best, 0.0)
    for a in above(best):
        if scores.get(a, 0.0) < last / 3:
            break
        if scores[a] > last:
            best = a
            break
        last = scores[a]
    while (up := m.at.get(id(m.nodes[best].parent), 0)) and [k for k in m.nodes[up].kids if isinstance(k, Node) or k.strip()] == [m.nodes[best]]:
        best = up
    return best


def _joined(m: Measures, scores: dict[int, float], best: int, skip: set[int]) -> list[Node]:
    """The winner and what of its siblings belongs to it: well scored ones, and paragraphs of prose."""
    top = m.nodes[best]
    least, out = max(10.0, 0.2 * scores.get(best, 0.0)), []
    for e in top.parent.kids:
        if not isinstance(e, Node) or id(e) in skip:
            continue
        if e is top:
            out.append(e)
            continue
        i = m.at[id(e)]
        alike = 0.2 * scores.get(best, 0.0) if e.attrs.get("class") and e.attrs.get("class") == top.attrs.get("class") else 0
        share, chars = m.link_share(e), m.chars[i]
        prose = e.tag == "p" and (chars > 80 and share < 0.25 or 0 < chars <= 80 and not share and re.search(r"[.!?。]( |$)", collapse(e.text())))
        if scores.get(i, 0.0) + alike >= least or prose:
            out.append(e)
    return out


def _copied(chosen: list, skip: set[int]) -> Node:
    root = Node("div")
    todo: list[tuple[object, Node]] = [(e, root) for e in reversed(chosen)]
    while todo:
        k, into = todo.pop()
        if isinstance(k, Comment) or id(k) in skip:
            continue
        if isinstance(k, Node):
            new = Node(k.tag, dict(k.attrs))
            into.add(new)
            todo += [(x, new) for x in reversed(k.kids)]
        else:
            into.add(k)
    return root


def _data_table(e: Node, m: Measures) -> bool:
    if e.tag != "table" or e.attrs.get("role") == "presentation" or e.attrs.get("datatable") == "0" or any(x.tag == "table" for x in e.walk()):
        return False
    return bool(e.attrs.get("summary") or m.of("heads", e) or m.of("rows", e) >= 10 or m.of("rows", e) > 1 and m.of("paragraphs", e) == 0 and m.link_share(e) < 0.2)


def _worthless(e: Node, m: Measures, rules: Rules) -> bool:
    """By ratios: does a part of the chosen content look like lists of links, galleries or forms?"""
    own, chars, share = weight(e) if rules.weigh else 0, m.of("chars", e), m.link_share(e)
    if own < 0:
        return True
    if m.of("commas", e) >= 10:
        return False
    paragraphs, images = m.of("paragraphs", e), m.of("images", e)
    as_list = e.tag in ("ul", "ol", "dl") or chars and m.of("listed", e) / chars > 0.9
    if as_list:
        return share > 0.5
    if e.tag == "figure":
        return share > 0.5 and not images
    return (
        images > 1 and paragraphs / images < 0.5
        or m.of("items", e) - 100 > paragraphs
        or m.of("inputs", e) > paragraphs // 3
        or chars < LEAST_BEARING and m.of("media", e) != 1 and images != 1 and not m.of("titles", e) and not paragraphs and e.tag != "table"
        or own < 25 and share > 0.2 + 0.3 * (paragraphs > 2)
        or share > 0.5
    )


def _cleaned(root: Node, rules: Rules, title: str, chosen: bool) -> bool:
    """Controls, repeats of the title and empty parts go; by ratios whatever is worthless, but not what was chosen itself. Whether ratios were the reason for any."""
    m, gone, by_ratio = Measures(root), [], False
    todo = [k for k in reversed(root.kids) if isinstance(k, Node)]
    titled = False
    while todo:
        e = todo.pop()
        if e.tag in CONTROLS:
            gone.append(e)
            continue
        if e.tag in ("h1", "h2") and not titled and title and _same_title(collapse(e.text()), title):
            gone.append(e)
            titled = True
            continue
        if e.tag in CONDITIONAL and not (chosen and e.parent is root) and rules.clean and not _data_table(e, m) and _worthless(e, m, rules):
            gone.append(e)
            by_ratio = True
            continue
        if not _data_table(e, m) and e.tag not in ("pre", "code"):
            todo += [k for k in reversed(e.kids) if isinstance(k, Node)]
    html.exchange([(e, None) for e in gone])
    m = Measures(root)
    empty = [e for e in m.nodes[1:] if e.tag in ("p", "div", "section", "li", "span", "b", "i", "strong", "em", "header") and not m.of("chars", e) and not m.of("media", e)]
    html.exchange([(e, None) for e in empty])
    return by_ratio


def _same_title(heading: str, title: str) -> bool:
    """Whether nearly all words of a heading stand in the title, or the other way round."""
    a, b = re.findall(r"\w+", heading.lower()), re.findall(r"\w+", title.lower())
    common = len(set(a) & set(b))
    return bool(a and b) and common >= 0.75 * max(len(set(a)), 1) and common >= 0.5 * len(set(b))


def main_content(page: Node, title: str = "") -> Node | None:
    """The chosen content of a page in a new div; None if it holds no text.

    The first attempt with enough text wins; if none has, the one with most text outside links, the strictest of equals.
    """
    m, best, most = Measures(page), None, -1.0
    hinted = any("class" in e.attrs or "id" in e.attrs for e in m.nodes)
    named = by_ratio = True
    for n, rules in enumerate(LADDER):
        if n and not (named, hinted, by_ratio)[n - 1]:  # what this attempt gives up made no difference
            continue
        skip, left = _left_out(page, rules)
        named = left if not n else named
        scores = _scores(page, m, skip, rules)
        best_at = _winner(m, scores) if scores else 0
        found = _copied(_joined(m, scores, best_at, skip) if best_at else page.kids, skip)
        by_ratio = _cleaned(found, rules, title, bool(best_at))
        got = Measures(found)
        if got.chars[0] >= ENOUGH:
            return found
        if got.chars[0] and got.chars[0] - got.linked[0] > most:
            best, most = found, got.chars[0] - got.linked[0]
    return best


# What parts a page's title from its site's name.
_PARTED = re.compile(r"(.+?)\s[|\-–—»/]\s[^|\-–—»/]+$")


def page_title(root: Node, meta: dict[str, str]) -> str:
    title = meta.get("og:title") or next((collapse(t.text()) for t in root.find("title")), "")
    if cut := _PARTED.match(title):
        title = cut[1] if len(cut[1].split()) >= 3 else title
    return title


def readable(root: Node) -> dict | None:
    """The nine readable fields of a page; None if no text is found."""
    page = body(root)
    meta = {(m.attrs.get("property") or m.attrs.get("name") or "").lower(): m.attrs.get("content", "") for m in root.find("meta")}
    title = page_title(root, meta)
    heads = [collapse(h.text()) for h in page.find("h1")]
    title = title or (heads[0] if heads else "")
    found = main_content(page, title)
    text = found.text().strip() if found is not None else ""
    if not text:
        return None
    top = next(iter(root.find("html")), None)
    first = next((collapse(p.text()) for p in found.find("p") if collapse(p.text())), "")
    by = next((t for e in page.walk() if (e.attrs.get("rel") == "author" or "author" in e.attrs.get("itemprop", "") or re.search(r"\b(byline|author)\b", e.attrs.get("class", ""))) and 0 < len(t := collapse(e.text())) < 100), None)
    turned = next((e for e in page.walk() if e.attrs.get("dir")), None)
    return {
        "title": title,
        "content": f'<div id="readability-page-1" class="page">{inner_html(found)}</div>',
        "text_content": text,
        "length": len(text),
        "excerpt": meta.get("description") or meta.get("og:description") or first,
        "byline": meta.get("author") or by,
        "dir": page.attrs.get("dir") or (top.attrs.get("dir") if top is not None else None) or (turned.attrs["dir"] if turned is not None else None),
        "site_name": meta.get("og:site_name") or None,
        "lang": (top.attrs.get("lang") if top is not None else None) or None,
    }


def prepare(page: str | None, base: str) -> Node:
    root = html.parse(page)
    html.style_code(root)
    html.replace_iframes(root, base)
    html.prune(root)
    return root


def extract(page: str | None) -> dict | None:
    """Readable content of a page without an address."""
    return readable(prepare(page, "https://example.com"))


def extract_article(page: str | None, url: str, keep_links: bool = False, reveal: bool = True) -> dict | None:
    """Title and tidied content of a captured page; None if there is none."""
    root = html.parse(page)
    if reveal:
        html.reveal_images(root)
    html.style_code(root)
    html.replace_iframes(root, url)
    html.prune(root)
    if not keep_links:
        html.strip_links(root)
    found = readable(root)
    return found and {"title": found["title"], "content_html": html.absolute_html(found["content"], url)}
