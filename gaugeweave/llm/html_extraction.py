"""Main text of pages by a site style tree.

The element trees of a host's pages are merged: elements with the same chain of tags and class names are one branch.
For each branch it is counted which contents (all text below it) and which presentations (sequence of the branches
below) its pages show.
Importance is the larger of the two entropies, to the base of the number of pages: 0 if all pages look alike there, 1
if no two do. Branches below 0.2 that at least four pages have are removed, however small a part of the host they are.

Entropy alone cannot find menus, adverts and footers whose words differ on every page, nor keep an article that many
pages repeat. So elements have a prior: navigation, footers, forms and the like (by tag, or by class, id and role
names) have importance 0 and articles 1; the measured importance decides on everything else. If a page has an article
or main element that is not itself in such a place, only what is in it can be main text, and the tree judges the
branches below it. There it counts each different article once, so that copies of a whole article do not make its
parts look like boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.llm.html import Block, blocks
from gaugeweave.llm.tables import BITMAP_WORDS, columns, marks, rows
from gaugeweave.session import materialize

IMPORTANT, LEAST_PAGES = 0.2, 4
ARTICLE = r"/(article|main)(\.[^/]*)?$"
FLUSH = 50_000


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def candidates(source: str | None) -> list[Block]:
    """The blocks that can be main text by their elements alone."""
    return main_blocks(list(blocks(source)))


def main_blocks(every: list[Block]) -> list[Block]:
    """Names alone do not make a whole page noise: if nothing else is left, only elements count."""
    kept = [b for b in every if not b.noise] or [b for b in every if b.named]
    return [b for b in kept if b.article] or kept


def branches(block: Block) -> Iterator[str]:
    """The branches that hold a block, up to the article around it."""
    path = block.path
    while len(path) > len(block.article):
        yield path
        path = path.rpartition("/")[0]


def style_tree(pages: DataFrame) -> DataFrame:
    """``(host, path, pages, importance)`` of every branch, from ``pages(host, html)``.

    A page adds one feature of each kind to each of its branches; equal ones are added up in the task first. Below
    an article a feature carries the article's digest and counts once for each.
    """

    def work(batches):
        counts: dict[tuple, int] = {}
        for batch in batches:
            for name, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                kept = list(blocks(source))
                main = [b.text for b in main_blocks(kept) if b.article]
                article = xxhash.xxh3_64_intdigest("\n".join(main)) - 2**63 if main else 0
                inside: set[str] = set()
                contents: dict[str, list[str]] = {}
                shapes: dict[str, list[str]] = {}
                for b in kept:
                    if main and b.article:
                        inside.update(branches(b))
                    path = b.path
                    while path:
                        contents.setdefault(path, []).append(b.text)
                        upper = path.rpartition("/")[0]
                        below = shapes.setdefault(upper, [])
                        if not below or below[-1] != path:
                            below.append(path)
                        path = upper
                for kind, table in ((0, contents), (1, shapes)):
                    for path, items in table.items():
                        key = name, path, kind, xxhash.xxh3_64_intdigest("\n".join(items)) - 2**63, article if path in inside else None
                        counts[key] = counts.get(key, 0) + 1
            if len(counts) > FLUSH:
                yield [(*k, n) for k, n in counts.items()]
                counts = {}
        yield [(*k, n) for k, n in counts.items()]

    features = rows(pages, work, "host string, path string, kind int, feature long, article long, n long")
    features = features.groupBy("host", "path", "kind", "feature", "article").agg(F.sum("n").alias("n"))
    features = features.withColumn("n", F.expr("CASE WHEN article IS NULL THEN n ELSE 1 END"))
    features = features.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    kinds = features.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.expr("n * ln(n)")).alias("inner"))
    entropy = F.expr("CASE WHEN pages > 1 THEN (ln(pages) - inner / pages) / ln(pages) ELSE 1D END")
    return kinds.withColumn("entropy", entropy).groupBy("host", "path").agg(
        F.max("pages").alias("pages"), F.max("entropy").alias("importance")
    )


def unimportant(pages: DataFrame) -> DataFrame:
    """``(host, path)`` of the branches to remove."""
    low = style_tree(pages).where(f"importance < {IMPORTANT} AND pages >= {LEAST_PAGES}").where(~F.col("path").rlike(ARTICLE))
    return low.select("host", "path")


def removals(pages: DataFrame, low: DataFrame) -> DataFrame:
    """``(host, digest, low)``: of the branches of each different page of a host those in ``low(host, path)``.

    The join is by host and path, so a list holds branches of its page only. Tasks receive a bitmap of a fixed size that
    saves moving branches that are not in ``low``.
    """
    places = low.select(F.pmod(F.xxhash64(F.concat_ws("\n", "host", "path")), F.lit(BITMAP_WORDS * 64)).alias("at"))
    wanted = pages.sparkSession.sparkContext.broadcast(marks(places))

    def work(batches):
        marked = wanted.value
        for batch in batches:
            out = []
            for name, digest, source in zip(*(batch[c].to_pylist() for c in ("host", "digest", "html"))):
                for path in {p for b in candidates(source) for p in branches(b)}:
                    at = xxhash.xxh64_intdigest(f"{name}\n{path}".encode(), 42) % (BITMAP_WORDS * 64)
                    if int(marked[at >> 6]) >> (at & 63) & 1:
                        out.append((name, digest, path))
            yield out

    found = rows(pages.select("host", "digest", "html"), work, "host string, digest binary, path string").distinct()
    return found.join(low, ["host", "path"]).groupBy("host", "digest").agg(F.sort_array(F.collect_list("path")).alias("low"))


def main_text(source: str | None, low: list[str] | None) -> str:
    if not low:
        return "\n".join(b.text for b in candidates(source))
    removed = set(low)
    return "\n".join(b.text for b in candidates(source) if removed.isdisjoint(branches(b)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without text, give an empty text. Pages without a host form one site. Broken and
    unclosed markup is read as far as it goes. Repeated rows each count as a page. Other columns are not read.
    """
    pages = columns(pages, page_id="page_id", url="url", html="html").withColumn("host", host(F.col("url")))
    low = materialize(unimportant(pages.select("host", "html")), "unimportant")
    pages = pages.withColumn("digest", F.unhex(F.md5(F.coalesce("html", F.lit("")))))
    removed = materialize(removals(pages, low), "removals")
    joined = pages.join(removed, ["host", "digest"], "left").select("page_id", "url", "html", "low")

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256), []
                for page, url, source, low in zip(*(part[c].to_pylist() for c in ("page_id", "url", "html", "low"))):
                    text = main_text(source, low)
                    out.append((page, url, text, len(text)))
                yield out

    return rows(joined, work, "page_id long, url string, text string, n_chars long")
