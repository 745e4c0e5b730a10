"""Books from kept articles: contents, chapters, master documents, EPUB files."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as tree
from quire.functions import text

AUTHOR = "Auto-generated"
#: The book's own look in print; a layout's style sheet may replace it.
STYLE = """<style>
body { font: 11pt/1.45 Georgia, serif; color: #1b1b1b; }
.toc, .chapter { page-break-before: always; }
.toc-list { list-style: none; padding: 0; }
.toc-item { padding: 0.2em 0; }
.toc-item a { color: inherit; text-decoration: none; }
h1, h2, h3 { font-family: Helvetica, Arial, sans-serif; line-height: 1.2; page-break-after: avoid; }
img { max-width: 100%; }
pre { white-space: pre-wrap; background: #f2f2f2; padding: 0.5em; }
table { border-collapse: collapse; } th, td { border: 1px solid #bbb; padding: 0.2em 0.5em; }
blockquote { margin: 0.5em 1.5em; font-style: italic; }
</style>"""


def numbered(kept: DataFrame) -> DataFrame:
    """Adds chapter, 1-based over the kept articles of a book."""
    return kept.withColumn("chapter", F.row_number().over(Window.partitionBy("book_id").orderBy("seq")).cast("long"))


def chapters_of(kept: DataFrame) -> DataFrame:
    """(book_id, chapter, toc_item, body): each chapter's line of the contents and its HTML; titles are escaped, content is not."""
    # The markup of contents and chapters.
    rows = numbered(kept)
    anchor, title = F.concat(F.lit("chapter-"), (F.col("chapter") - 1).cast("string")), text.escape_html(F.col("title"))
    item = F.concat(F.lit('<li class="toc-item"><a href="#'), anchor, F.lit('"><span class="toc-item-number">'), F.col("chapter").cast("string"), F.lit(".</span> "), title, F.lit("</a></li>"))
    body = F.concat(F.lit('<div class="chapter" id="'), anchor, F.lit('"><h1>'), title, F.lit("</h1>\n"), F.col("content_html"), F.lit("\n</div>"))
    return rows.select("book_id", "chapter", item.alias("toc_item"), body.alias("body"))


def books(kept: DataFrame, css: str | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """(book_id, toc, chapters, master_html): one row per book, joined in order; a book is one row by nature.

    A book's style is its sheet in layouts(book_id, css), else css, else STYLE.
    """
    joined = chapters_of(kept).groupBy("book_id").agg(
        F.expr("listagg(toc_item, '\n') within group (order by chapter)").alias("items"),
        F.expr("listagg(body, '\n') within group (order by chapter)").alias("chapters"),
    )
    toc = F.concat(F.lit('<div class="toc"><h1>Table of Contents</h1><ul class="toc-list">\n'), F.col("items"), F.lit("\n</ul></div>"))
    # The page head.
    head = '<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>eBook Collection</title>\n'
    style = F.lit(f"<style>\n{css}\n</style>" if css else STYLE)
    if layouts is not None:
        joined = joined.join(layouts.select("book_id", F.col("css").alias("_css")), "book_id", "left")
        style = F.coalesce(F.concat(F.lit("<style>\n"), F.nullif("_css", F.lit("")), F.lit("\n</style>")), style)
    master = F.concat(F.lit(head), style, F.lit("\n</head>\n<body>\n"), F.col("toc"), F.lit("\n"), F.col("chapters"), F.lit("\n</body>\n</html>"))
    return joined.withColumn("toc", toc).withColumn("master_html", master).select("book_id", "toc", "chapters", "master_html")


def _xhtml(fragment: str) -> str:
    """A fragment as well-formed XML: elements closed, attributes with plain names only."""
    out: list[str] = []

    def write(node):
        for k in node.kids:
            if isinstance(k, tree.Comment):
                continue
            if not isinstance(k, tree.Node):
                out.append(escape("".join(c for c in k if c >= " " or c in "\t\n\r"), quote=False))
                continue
            names = "".join(f' {a}="{escape(v)}"' for a, v in k.attrs.items() if a.replace("-", "").replace("_", "").isalnum() and a[0].isalpha())
            if k.tag in tree.VOID:
                out.append(f"<{k.tag}{names}/>")
            else:
                out.append(f"<{k.tag}{names}>")
                write(k)
                out.append(f"</{k.tag}>")

    write(tree.body(tree.parse(fragment)))
    return "".join(out)


def epub_bytes(title: str, chapters: list[tuple[str, str]], author: str = AUTHOR) -> bytes:
    """An EPUB 3 file of (title, HTML) chapters; the same input gives the same bytes."""
    if not chapters:
        raise ValueError("no articles for the book")
    if not title:
        raise ValueError("a book needs a title")
    page = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"{}><head><title>{}</title></head><body>{}</body></html>'
    names = [f"chapter-{i}.xhtml" for i in range(1, len(chapters) + 1)]
    listed = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    parts = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/content.opf": '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:quire:{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>en</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata><manifest>'
        '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        + "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        + "</manifest><spine>"
        + "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
        + "</spine></package>",
        "OEBPS/nav.xhtml": page.format(' xmlns:epub="http://www.idpf.org/2007/ops"', escape(title), f'<nav epub:type="toc"><ol>{listed}</ol></nav>'),
    }
    for n, (t, body) in zip(names, chapters, strict=True):
        parts[f"OEBPS/{n}"] = page.format("", escape(t), f"<h1>{escape(t)}</h1>{_xhtml(body)}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        for name, content in parts.items():
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def epubs(kept: DataFrame) -> DataFrame:
    """(book_id, title, chapters, epub): a file per book, made where the book's rows meet."""
    title = text.book_title(F.first("url"))
    listed = F.array_sort(F.collect_list(F.struct("chapter", "title", text.tidy_epub(F.col("content_html")).alias("html"))))
    rows = numbered(kept).groupBy("book_id").agg(title.alias("title"), F.count("*").alias("chapters"), listed.alias("parts"))

    def run(titles: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([epub_bytes(t, [(p["title"], p["html"]) for p in ps]) for t, ps in zip(titles, parts, strict=True)], dtype=object)

    return rows.select("book_id", "title", "chapters", F.pandas_udf(run, "binary")("title", "parts").alias("epub"))
