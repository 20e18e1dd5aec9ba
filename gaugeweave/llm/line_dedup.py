"""Boilerplate lines of a site: lines on too large a share of their host's pages.

A line is a block of visible text. For each host and line the pages that hold it are counted and divided by the
host's pages; lines above ``ratio`` that are on ``least_pages`` pages or more are dropped from every page of the host.
Counts are by host *and* line and are added up before they are moved, so a host with a third of all pages spreads
over all tasks. Markup is read once; the lines are written under ``spark.checkpoint.dir`` for both uses.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.html import blocks
from gaugeweave.llm.html_extraction import host
from gaugeweave.llm.tables import columns, rows
from gaugeweave.session import materialize

RATIO, LEAST_PAGES = 0.1, 3


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def page_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, text)``: the lines of each page, joined by line feeds, which no line holds; None without lines."""

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, out = batch.slice(start, 128), []
                for *page, source in zip(*(part[c].to_pylist() for c in ("page_id", "url", "host", "html"))):
                    out.append((*page, "\n".join(b.text for b in blocks(source)) or None))
                yield out

    return rows(pages, work, "page_id long, url string, host string, text string")


def page_lines(texts: DataFrame) -> DataFrame:
    """``(host, line)``: each distinct line of each page once, as a hash."""

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, out = batch.slice(start, 128), []
                for name, text in zip(part["host"].to_pylist(), part["text"].to_pylist()):
                    out += [(name, h) for h in set(map(_digest, text.split("\n")))]
                yield out

    return rows(texts.select("host", "text").where("text IS NOT NULL"), work, "host string, line long")


def frequent_lines(texts: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, lines)``: hashes of the lines to drop. Fewer than lines of a page / ratio for each host."""
    totals = texts.groupBy("host").agg(F.count("*").alias("total"))
    counts = page_lines(texts).groupBy("host", "line").agg(F.count("*").alias("n")).where(f"n >= {least_pages}")
    found = counts.join(totals, "host").where(f"n > {ratio} * total")
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_frequent_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_lines, n_dropped`` of every row; the lines that stay are joined by line feeds.

    Null and empty pages have no lines. Pages without a host form one site. A line that a page repeats counts once
    for the ratio and stays or goes in all its places. Repeated rows each count as a page.
    """
    pages = columns(pages, page_id="page_id", url="url", html="html").withColumn("host", host(F.col("url")))
    texts = materialize(page_texts(pages.select("page_id", "url", "host", "html")), "page-texts")
    known = materialize(frequent_lines(texts, ratio, least_pages), "frequent-lines")
    joined = texts.join(known, "host", "left").select("page_id", "url", "text", "lines")

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, out = batch.slice(start, 128), []
                for page, url, text, lines in zip(*(part[c].to_pylist() for c in ("page_id", "url", "text", "lines"))):
                    own, drop = text.split("\n") if text else [], set(lines or ())
                    kept = [t for t in own if _digest(t) not in drop]
                    out.append((page, url, "\n".join(kept), len(own), len(own) - len(kept)))
                yield out

    return rows(joined, work, "page_id long, url string, text string, n_lines long, n_dropped long")
