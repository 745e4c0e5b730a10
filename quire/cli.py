"""Command line: one book from a table of captured pages."""

from __future__ import annotations

import argparse
import functools
import inspect
import os
import re
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from quire.functions.urls import resolve
from quire.operators import extract, filtering
from quire.plans import book
from quire.plans.layout import layout
from quire.sources import pages, sinks
from quire.sources.staging import owned, release, written


def _leading_int(value: str) -> int | None:
    found = re.match(r"\s*([+-]?\d+)", value)
    return int(found[1]) if found else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Turn captured blog posts into an EPUB or a printable document")
    p.add_argument("-u", "--url", required=True, help="address of the blog")
    p.add_argument("-o", "--out", required=True, help="output file")
    p.add_argument("-p", "--pages", required=True, help="Parquet table of captured pages (page_id, url, html)")
    p.add_argument("-f", "--format", default="pdf")
    p.add_argument("-m", "--max", default="10")
    p.add_argument("-l", "--layout-mode", default="static")
    p.add_argument("--ai-provider", default="gemini")
    p.add_argument("--ai-model")
    p.add_argument("--ai-api-key", help="passed on to the injected clients; better given in the environment as QUIRE_AI_API_KEY")
    p.add_argument("--no-strip-links", dest="strip_links", action="store_false")
    p.add_argument("--no-filter", dest="filter", action="store_false")
    p.add_argument("--lazy-load-timeout", default="20000", help="accepted; captures have no live page to wait for")
    p.add_argument("--no-lazy-load", dest="lazy_load", action="store_false")
    p.add_argument("--no-cache", dest="cache", action="store_false", help="ask for a new layout although one is kept for the content")
    p.add_argument("--cache-dir", default=str(Path.home() / ".cache" / "quire" / "layouts"))
    return p


def validated(args: argparse.Namespace) -> argparse.Namespace:
    """Checks options as given and fills in numbers; raises ValueError."""
    args.format, args.layout_mode, args.ai_provider = args.format.lower(), args.layout_mode.lower(), args.ai_provider.lower()
    if args.format not in ("pdf", "epub"):
        raise ValueError('--format must be "pdf" or "epub"')
    args.max, args.lazy_load_timeout = _leading_int(args.max), _leading_int(args.lazy_load_timeout)
    if args.max is None or args.max < 1:
        raise ValueError("--max must be a positive number")
    if args.lazy_load_timeout is None or args.lazy_load_timeout < 0:
        raise ValueError("--lazy-load-timeout must not be negative")
    if args.layout_mode not in ("static", "ai"):
        raise ValueError('--layout-mode must be "static" or "ai"')
    if args.ai_provider not in ("gemini", "openai", "anthropic"):
        raise ValueError('--ai-provider must be "gemini", "openai" or "anthropic"')
    args.out = sinks.with_extension(args.out, args.format)
    return args


def _key_name(provider: str) -> str:
    return f"QUIRE_{provider.upper()}_API_KEY"


def _with_access(client, access: dict):
    """The client with those of the options that it takes by name."""
    if client is None:
        return None
    taken = inspect.signature(client).parameters
    return functools.partial(client, **{k: v for k, v in access.items() if k in taken})


def main(argv: list[str] | None = None, spark: SparkSession | None = None, judge=None, designer=None, render=None) -> int:
    """Exit code: 0 for a book or when nothing is linked, 1 otherwise.

    judge, designer and render are injected clients; the first two get provider, model and api_key by name if they take them.
    """
    try:
        args = validated(parser().parse_args(argv))
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if args.ai_api_key:
        print(f"Deprecated: a key on the command line is seen by others; {_key_name(args.ai_provider)} or QUIRE_AI_API_KEY takes it", file=sys.stderr)
    key = args.ai_api_key or os.environ.get(_key_name(args.ai_provider)) or os.environ.get("QUIRE_AI_API_KEY")
    access = {"provider": args.ai_provider, "model": args.ai_model, "api_key": key}
    judge, designer = _with_access(judge, access), _with_access(designer, access)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    owner = f"cli-{uuid.uuid4().hex}"
    try:
        with owned(owner):
            return _run(args, spark, judge, designer, render)
    finally:
        release(spark, owner)


def _run(args: argparse.Namespace, spark: SparkSession, judge, designer, render) -> int:
    captured = pages.read_pages(spark, args.pages)
    seed = resolve(args.url) or args.url
    seeds = pages.with_book(spark.createDataFrame([(0, args.url, "")], "page_id long, url string, html string")).select("book_id", "url")
    options = book.BookOptions(args.max, extraction=extract.ExtractionOptions(args.strip_links, args.lazy_load), filter=filtering.FilterOptions() if args.filter else None, judge=judge)
    classified, seen = filtering.counted(book.classified_articles(captured, seeds, options))
    rows = written(classified, "book")
    counts = seen.get
    if not counts["extracted"]:
        print(f"Nothing to read at {seed}", file=sys.stderr)
        return 0 if not book.discover.discover(captured, seeds, options.max_pages).take(1) else 1
    if counts["omitted"]:
        for r in filtering.omitted(rows).orderBy("seq").collect():
            print(f'Omitted: "{r["title"]}" ({r["url"]}): {r["reason"]}', file=sys.stderr)
    if counts["omitted"] == counts["extracted"]:
        print("All pages were omitted; --no-filter includes them", file=sys.stderr)
        return 1
    kept = filtering.kept(rows)
    if args.format == "epub":
        if args.layout_mode == "ai":
            print("Designed layouts are for documents; the EPUB has the static one", file=sys.stderr)
        sinks.write_epub(kept, args.out)
    else:
        css = None
        if args.layout_mode == "ai" and designer is not None:
            css = layout(kept, designer, args.ai_provider, args.ai_model, args.cache_dir, fresh=not args.cache)
        if args.layout_mode == "ai" and css is None:
            print("No designed layout (no client, no answer in time, or an unsafe sheet); the static one is used", file=sys.stderr)
        sinks.write_document(kept, args.out, css, render)
    n = counts["extracted"] - counts["omitted"]
    print(f"{args.out}: {n} articles ({args.format})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
