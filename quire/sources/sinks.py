"""Writers of finished books; only a finished book ever reaches the driver."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import assemble
from quire.sources import book_files


def with_extension(path: str, kind: str) -> str:
    """The path with the format's extension in place of any other; compared as written."""
    base, ext = os.path.splitext(path)
    return path if ext == f".{kind}" else f"{base}.{kind}"


def _target(path: str) -> Path:
    if not path:
        raise ValueError("an output path is needed")
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    return out


def _one(books: DataFrame) -> list:
    """The row of the only book; none or several are refused."""
    rows = books.take(2)
    if len(rows) != 1:
        raise ValueError("no articles for the book" if not rows else "articles of several books; write_books() writes them all")
    return rows


def write_epub(kept: DataFrame, path: str) -> int:
    """One book's articles as an EPUB file; the number of chapters."""
    rows = _one(assemble.epubs(kept))
    _target(path).write_bytes(bytes(rows[0]["epub"]))
    return rows[0]["chapters"]


def write_document(kept: DataFrame, path: str, css: str | None = None, render: Callable[[str, Path], None] | None = None) -> None:
    """One book's master HTML; with `render` (HTML, target) a PDF or whatever it prints, else the HTML itself beside the path."""
    rows = _one(assemble.books(kept, css))
    target = _target(path)
    if render is None:
        target.with_suffix(".html").write_text(rows[0]["master_html"], encoding="utf-8")
    else:
        render(rows[0]["master_html"], target)


def write_books(kept: DataFrame, path: str, mode: str = "append") -> None:
    """All books as EPUB files in a folder, one each, written by the tasks that make them; a job that fails leaves none."""
    name = F.pandas_udf(lambda ids: ids.map(lambda i: book_files.file_name(i, "epub")), "string")
    books = assemble.epubs(kept)
    book_files.write_files(books.select(name("book_id").alias("name"), F.col("epub").alias("content")), path, mode)


def write_documents(kept: DataFrame, path: str, css: str | None = None, layouts: DataFrame | None = None, render: Callable[[str], bytes] | None = None, extension: str = "html", mode: str = "append") -> None:
    """All books' master HTML in a folder, one file each; with `render` (HTML to bytes, run in tasks) what it makes of it, under its extension. layouts(book_id, css) as in assemble.books()."""
    name = F.pandas_udf(lambda ids: ids.map(lambda i: book_files.file_name(i, extension)), "string")
    content = F.col("master_html").cast("binary")
    if render is not None:
        content = F.pandas_udf(lambda pages: pages.map(render), "binary")("master_html")
    books = assemble.books(kept, css, layouts)
    book_files.write_files(books.select(name("book_id").alias("name"), content.alias("content")), path, mode)


def write_book_table(kept: DataFrame, path: str) -> None:
    """All books as a Parquet table of EPUB files."""
    assemble.epubs(kept).write.mode("overwrite").parquet(path)
