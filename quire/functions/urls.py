"""Addresses as browsers read them: resolving, normalising, and the article-link predicate."""

from __future__ import annotations

import re
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes with hosts and their usual ports, and stems, suffixes and shapes of paths.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
DENY_STEMS = ("author", "user", "profile", "about", "contact", "privacy", "terms", "tag", "category", "archive", "page", "search", "login", "signup", "register", "account", "dashboard", "feed", "rss", "api", "wp-json", "wp-admin")
DENY_SUFFIXES = ("jpg", "jpeg", "png", "gif", "pdf", "zip", "xml")
DENY = rf"/({'|'.join(DENY_STEMS)})|\.({'|'.join(DENY_SUFFIXES)})$|^/$"
ACCEPT = r"/\d{4}/\d{2}/\d{2}/|/blog/|/post/|/article/|/[^/]+/?$"

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_PATH_SAFE = "!$%&'()*+,-./:;=@[]_~|\\^"
_QUERY_SAFE = "!$%&()*+,-./:;=?@[]_~`{}|\\^'"


def _host(raw: str) -> str | None:
    host = raw.lower()
    if host.startswith("["):
        return host if re.fullmatch(r"\[[0-9a-f:.]+\]", host) else None
    if not host or re.search(r"[\s#%/:<>?@\[\\\]^|]", host):
        return None
    try:
        return host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None


def _walk(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        dots = re.sub("(?i)%2e", ".", part)
        if dots == "..":
            if out:
                out.pop()
        elif dots != ".":
            out.append(part)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def resolve(href: str | None, base: str | None = None) -> str | None:
    """The absolute address a browser makes of href on a page at base; None if it can't."""
    if href is None:
        return None
    href = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(33)))))
    found = _SCHEME.match(href)
    scheme = found[1].lower() if found else None
    if scheme and scheme not in PORTS:
        if scheme == "file":
            return None
        return f"{scheme}:{quote(href[found.end():], safe=_PATH_SAFE + '?#' + _QUERY_SAFE)}"
    rest, anchor, fragment = (href[found.end() :] if scheme else href).partition("#")
    rest, ask, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    home = None
    if base is not None and not (scheme and rest.startswith("/")):
        absolute = resolve(base)
        home = urlsplit(absolute) if absolute else None
        if home is not None and scheme and scheme != home.scheme:
            home = None
    if scheme and (rest.startswith("/") or home is None):
        rest = "//" + rest.lstrip("/")
    elif home is None or home.scheme not in PORTS:
        return None
    scheme = scheme or home.scheme
    if rest.startswith("//"):
        place, slash, path = rest.lstrip("/").partition("/")
        user, at, place = place.rpartition("@")
        name, colon, port = place.rpartition(":") if re.search(r":\d*$", place) else (place, "", "")
        if ":" in name and not name.startswith("["):
            return None
        host = _host(name)
        if host is None or (port and int(port) > 65535):
            return None
        port = str(int(port)) if port else ""
        place = (quote(user, safe=":!$%&'()*+,-.;=_~") + "@" if at else "") + host + (f":{port}" if port and port != PORTS[scheme] else "")
        path = slash + path
    else:
        place, path = home.netloc, rest
        if not path:
            path = home.path
            if not ask:
                ask, query = ("?", home.query) if home.query else ("", "")
        elif not path.startswith("/"):
            path = home.path.rpartition("/")[0] + "/" + path
    path = quote(_walk(path or "/"), safe=_PATH_SAFE)
    query = quote(query, safe=_QUERY_SAFE).replace("'", "%27") if ask else ""
    return f"{scheme}://{place}{path}{ask}{query}" + (anchor + quote(fragment, safe=_QUERY_SAFE + "#") if anchor else "")


def safe_media(src: str | None, base: str) -> str | None:
    """An embed's address if it is http or https once resolved."""
    src = (src or "").strip()
    if not src or re.match(r"(?i)(javascript|vbscript):", src):
        return None
    out = resolve(src, base)
    return out if out and out.startswith(("http://", "https://")) else None


def _resolve_series(href: pd.Series, base: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([known[p] if p in known else known.setdefault(p, resolve(*p)) for p in zip(href, base, strict=True)], dtype=object)


def _safe_series(src: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([safe_media(s, b) for s, b in zip(src, base, strict=True)], dtype=object)


def resolved(href: Column, base: Column) -> Column:
    return F.pandas_udf(_resolve_series, "string")(href, base)


def safe_media_url(src: Column, base: Column) -> Column:
    return F.pandas_udf(_safe_series, "string")(src, base)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", F.lit(""))


def host_of(url: Column) -> Column:
    """Host, lower-case, without port; null for addresses without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_article_link(url: Column, base: Column) -> Column:
    """For absolute addresses: the same host as base, no denied path, an accepted shape of path."""
    path = F.lower(path_of(url))
    return F.coalesce((host_of(url) == host_of(base)) & ~path.rlike(f"(?i){DENY}") & path.rlike(ACCEPT), F.lit(False))
