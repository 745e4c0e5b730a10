"""Text rules as native column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a browser counts as white space, and word edges that are ASCII as in a browser.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Phrases, patterns and limits of the rules.
LOAD_MORE = "load more|show more|show all|expand|see more|view all"
ERROR_TITLE = r"404|not\s+found|page\s+not\s+found|access\s+denied|forbidden|error"
LOGIN_TITLE = r"login|sign\s*in|sign\s*up|register"
UNSAFE_SCHEME = "javascript|data|vbscript"
UNSAFE_CSS_URL = "file:|data:|javascript:|vbscript:|chrome:|chrome-extension:"
BLOCKED_TYPES = ("image", "stylesheet", "font", "media", "websocket", "manifest", "other")
BLOCKED_TOKENS = ("google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.com", "facebook.net", "twitter.com", "linkedin.com", "analytics", "ads", "tracking")
TOO_SHORT = "Too short (under %d characters of text)"
ERROR_PAGE = "Error page detected (title pattern)"
LOGIN_WALL = "Login wall detected (title pattern)"
NAVIGATION = "Navigation-heavy page (link text dominates)"
DUPLICATE = "Duplicate content (same body as a prior article)"
UNTITLED = "(untitled)"
DEFAULT_MODELS = {"openai": "gpt-4o-mini", "anthropic": "claude-haiku-4", "gemini": "gemini-2.0-flash"}


def _gsub(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, pattern, F.lit(new))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(_gsub(c, f"{SPACE}+", " "))


def trim_all(c: Column) -> Column:
    return _gsub(c, f"^{SPACE}+|{SPACE}+$", "")


def unescape(c: Column) -> Column:
    """The entities of flat fragments, with or without their semicolon as in browsers; the ampersand last."""
    for name, char in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#039", "'"), ("&copy", "©"), ("&middot", "·"), ("&nbsp", "\u00a0"), ("&amp", "&")):
        c = _gsub(c, f"{name};?", char)
    return c


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def flat_text(html: Column) -> Column:
    """Plain text of a fragment without comments or raw-text elements: tags go, entities are read, white space collapses."""
    return collapse(unescape(_gsub(F.coalesce(html, F.lit("")), "<[^>]*>", "")))


def content_hash(plain: Column) -> Column:
    return F.sha2(F.lower(collapse(plain)), 256)


def link_ratio(html: Column, plain: Column) -> Column:
    """Characters inside anchors over those of the collapsed text; may pass 1."""
    inside = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    total = F.aggregate(inside, F.lit(0), lambda n, a: n + F.length(unescape(_gsub(a, "<[^>]*>", ""))))
    return total.cast("double") / F.greatest(F.lit(1), F.length(plain))


def tidy_html(html: Column) -> Column:
    """Blank lines and blanks around line ends thinned out, in four passes."""
    for pattern, new in ((rf"\n{SPACE}*\n{SPACE}*\n", "\n\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " ")):
        html = _gsub(html, pattern, new)
    return trim_all(html)


def tidy_epub(html: Column) -> Column:
    """tidy_html, then pairs of line breaks to one, and empty p and div dropped; one pass, so three breaks leave two."""
    html = tidy_html(html)
    for pattern, new in ((rf"(?i)<br{SPACE}*/?>{SPACE}*<br{SPACE}*/?>", "<br>"), (rf"(?i)<p>{SPACE}*</p>", ""), (rf"(?i)<div>{SPACE}*</div>", "")):
        html = _gsub(html, pattern, new)
    return trim_all(html)


def titled(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(UNTITLED))


def rule_reason(title: Column, plain: Column, html: Column, min_length: int = 100, patterns: bool = True, ratio: bool = True, link_share: Column | None = None) -> Column:
    """Why the rules omit an article, null if they keep it; the first rule that fits wins."""
    t = trim_all(title)
    out = F.when(F.length(plain) < min_length, F.lit(TOO_SHORT % min_length))
    if patterns:
        out = out.when(t.rlike(f"(?i)({ERROR_TITLE})"), F.lit(ERROR_PAGE))
        out = out.when(t.rlike(f"(?i){EDGE}({LOGIN_TITLE}){EDGE}"), F.lit(LOGIN_WALL))
    if ratio:
        share = link_ratio(html, plain) if link_share is None else link_share
        out = out.when((F.length(plain) > 0) & (share > 0.6), F.lit(NAVIGATION))
    return out


def is_load_more(label: Column) -> Column:
    t = collapse(label)
    return F.coalesce((t != "") & (F.length(t) <= 80) & t.rlike(f"(?i){EDGE}({LOAD_MORE}){EDGE}"), F.lit(False))


def is_unsafe_href(href: Column) -> Column:
    return F.coalesce(trim_all(href).rlike(f"(?i)^({UNSAFE_SCHEME}):"), F.lit(False))


def is_blocked(url: Column, kind: Column) -> Column:
    """Requests dropped by type, or by a token anywhere in the address ("ads" in "downloads" too)."""
    low, out = F.lower(url), kind.isin(*BLOCKED_TYPES)
    for token in BLOCKED_TOKENS:
        out = out | F.contains(low, F.lit(token))
    return out


def strip_fences(raw: Column) -> Column:
    return trim_all(F.replace(_gsub(raw, "(?i)```css", ""), F.lit("```"), F.lit("")))


def css_is_valid(css: Column) -> Column:
    """Long enough, no markup or fences, the three selectors, balanced braces, no imports, no unsafe addresses."""
    opened, closed = F.regexp_count(css, F.lit(r"\{")), F.regexp_count(css, F.lit(r"\}"))
    ok = (F.length(trim_all(css)) >= 100) & ~F.contains(css, F.lit("<")) & ~F.contains(css, F.lit("```"))
    for selector in ("body", ".toc", ".chapter"):
        ok = ok & F.contains(css, F.lit(selector))
    ok = ok & (opened == closed) & (opened >= 5) & ~css.rlike(rf"(?i)@import{EDGE}")
    return F.coalesce(ok & ~css.rlike(rf"""(?i)url{SPACE}*\({SPACE}*['"]?{SPACE}*({UNSAFE_CSS_URL})"""), F.lit(False))


def book_title(url: Column) -> Column:
    """Title from an address: the first label of the host without "www.", capitalised."""
    host = F.try_parse_url(url, F.lit("HOST"))
    label = F.split_part(_gsub(F.lower(host), r"^(.*?)www\.", "$1"), F.lit("."), F.lit(1))
    made = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30), F.lit(" Collection"))
    return F.when(host.isNull() | (host == ""), F.lit("Blog Collection")).otherwise(made)


def default_model(provider: Column) -> Column:
    out = F.when(provider == "openai", F.lit(DEFAULT_MODELS["openai"])).when(provider == "anthropic", F.lit(DEFAULT_MODELS["anthropic"]))
    return out.otherwise(F.lit(DEFAULT_MODELS["gemini"]))
