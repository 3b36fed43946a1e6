"""Choosing and grouping the links of pages. Links are rows ``page, pos, raw, href, label``; ``pos`` is their order on the page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.urls import common_path_prefix, host, is_pdf, path, segments, slug_shape

#: Words that documents' links use, in order of preference (fixed values).
DOC_WORDS = [
    "minutes", "agenda", "notice", "report", "packet", "resolution", "bid", "tender", "rfp", "filing", "transcript", "meeting", "session", "hearing", "budget", "contract", "proceedings",
]


def links_of(pages: DataFrame, page: str, read: str = "read") -> DataFrame:
    """Links of pages read by ``functions.html.read_page``."""
    return pages.select(F.col(page).alias("page"), F.explode(f"{read}.links").alias("l")).select("page", "l.pos", "l.raw", "l.href", "l.label")


def first_of_each(links: DataFrame) -> DataFrame:
    """The first link of each address on a page, with its label. Rows are brought together by page, so that later steps by page need no shuffle of their own."""
    links = links.repartition("page")
    w = Window.partitionBy("page", "href").orderBy("pos")
    return links.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_on_page(links: DataFrame, limit: int, *order: Column) -> DataFrame:
    """At most ``limit`` links of each page, in ``order`` and then page order; ``rank`` from 1."""
    return links.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(*order, "pos"))).filter(F.col("rank") <= limit)


def pdf_links(links: DataFrame, include: str | None = None, exclude: str | None = None, limit: int = 3) -> DataFrame:
    """Links that contain ``include``, or else end in .pdf, and do not contain ``exclude``."""
    wanted = F.col("href").contains(include) if include else is_pdf("href")
    if exclude:
        wanted &= ~F.col("href").contains(exclude)
    return first_on_page(first_of_each(links.filter(wanted)), limit)


def document_pages(links: DataFrame, needle: str = "minutes", limit: int = 3) -> DataFrame:
    """Links whose address or label has ``needle`` in any case, but for attachments."""
    n = needle.lower()
    wanted = F.lower("href").contains(n) | F.lower("label").contains(n)
    return first_on_page(first_of_each(links.filter(wanted & ~F.lower("href").rlike(r"\.(pdf|doc|docx)$"))), limit)


def document_pages_or_index(pages: DataFrame, links: DataFrame, needle: str = "minutes", limit: int = 3) -> DataFrame:
    """``page, href, label, rank``: matching links, and for pages without any the page itself."""
    chosen = document_pages(links, needle, limit).select("page", "href", "label", "rank")
    alone = pages.select("page").distinct().join(chosen.select("page").distinct(), "page", "left_anti")
    return chosen.unionByName(alone.select("page", F.col("page").alias("href"), F.lit(None).cast("string").alias("label"), F.lit(1).alias("rank")))


def listing(links: DataFrame, pattern: str, limit: int = 3) -> DataFrame:
    """Detail pages whose raw address matches ``pattern``: by the number it captures (of any length), newest first, if every link of the page has one, else in page order."""
    found = re.compile(pattern).groups
    key = F.nullif(F.regexp_extract("raw", pattern, 1), F.lit("")) if found else F.lit(None).cast("string")
    key = F.when(key.rlike(r"^[0-9]+$"), F.regexp_replace(key, r"^0+(?=[0-9])", ""))
    rows = first_of_each(links.filter(F.col("raw").rlike(pattern))).withColumn("key", key)
    w = Window.partitionBy("page")
    rows = rows.withColumn("_numbered", F.count("key").over(w) == F.count("*").over(w))
    # Numbers without leading zeros compare by their length, then as texts.
    order = [F.when(F.col("_numbered"), F.length("key")).desc(), F.when(F.col("_numbered"), F.col("key")).desc()]
    return first_on_page(rows, limit, *order).drop("_numbered")


def detail_files(listed: DataFrame, links: DataFrame, keyword: str | None = None) -> DataFrame:
    """``page, rank, href, file, label``: of each listed detail page (from ``listing``) its first matching file; detail pages without one give no row.

    The join of an index with its detail pages: ``links`` are those of the detail pages, by address.
    """
    files = first_pdf(links, keyword).select(F.col("page").alias("href"), F.col("href").alias("file"), F.col("label").alias("file_label"))
    return listed.select("page", "rank", "href").join(files, "href").select("page", "rank", "href", "file", F.col("file_label").alias("label"))


def first_pdf(links: DataFrame, keyword: str | None = None) -> DataFrame:
    """The first .pdf link of each (detail) page, with ``keyword`` in its raw address or label if given."""
    wanted = is_pdf("raw")
    if keyword:
        k = keyword.lower()
        wanted &= F.lower("raw").contains(k) | F.lower("label").contains(k)
    return first_on_page(links.filter(wanted), 1)


def rendered_pdf_links(links: DataFrame, label_keyword: str | None = None, url_keyword: str | None = None, limit: int = 3) -> DataFrame:
    """Links of a rendered page: those with ``label_keyword`` in the label if given, else ``.pdf`` at the end or before a query, with ``url_keyword`` in them if given."""
    if label_keyword:
        wanted = F.lower("label").contains(label_keyword.lower())
    else:
        wanted = F.lower("href").rlike(r"\.pdf(\?|$)")
        if url_keyword:
            wanted &= F.lower("href").contains(url_keyword.lower())
    return first_on_page(first_of_each(links.filter(wanted)), limit)


def hosted_links(links: DataFrame, pattern: str | None = None, keyword: str | None = None, limit: int = 3) -> DataFrame:
    """Links that contain ``pattern`` and have ``keyword`` in address or label; with neither, ``.pdf``."""
    wanted = F.lit(True)
    if pattern:
        wanted &= F.col("href").contains(pattern)
    if keyword:
        wanted &= F.lower("href").contains(keyword.lower()) | F.lower("label").contains(keyword.lower())
    if not pattern and not keyword:
        wanted = F.lower("href").contains(".pdf")
    return first_on_page(first_of_each(links.filter(wanted)), limit)


def _top(groups: DataFrame, key: str, least: int) -> DataFrame:
    """The largest group of each page, the one met first among equals."""
    w = Window.partitionBy("page").orderBy(F.col("n").desc(), "first_pos")
    return groups.withColumn("_r", F.row_number().over(w)).filter(f"_r = 1 and n >= {least}").select("page", key, "n")


def route_shapes(links: DataFrame) -> DataFrame:
    """``page, shape, n, first_pos, hrefs``: same-site links by the shape of their route, of shapes with a varying part. Each group is of one page."""
    same = (host("href") == host("page")) & (F.trim(path("href"), F.lit("/")) != "")
    shaped = links.filter(same).withColumn("shape", slug_shape(path("href"))).filter(F.col("shape").contains("<n>") | F.col("shape").contains("<slug>"))
    return shaped.groupBy("page", "shape").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]).alias("hrefs")
    )


def top_route(links: DataFrame, least: int = 3) -> DataFrame:
    """The most common route shape of each page."""
    return _top(route_shapes(links), "shape", least)


def top_folder(links: DataFrame, least: int = 1) -> DataFrame:
    """The folder most .pdf links of a page are in."""
    folder = F.regexp_extract("href", r"^(.*)/[^/]*$", 1)
    return _top(links.filter(is_pdf("href", strip_query=True)).groupBy("page", folder.alias("folder")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")), "folder", least)


def doc_word(text: Column) -> Column:
    """The first of ``DOC_WORDS`` that a text contains, else null."""
    return F.get(F.filter(F.array(*map(F.lit, DOC_WORDS)), lambda w: text.contains(w)), 0)


def top_word(links: DataFrame, least: int = 2) -> DataFrame:
    """The document word most links of a page mention, attachments aside."""
    worded = links.filter(~F.split_part(F.lower("href"), F.lit("?"), F.lit(1)).rlike(r"\.(pdf|doc|docx)$")).withColumn("word", doc_word(F.lower(F.concat_ws(" ", "href", "label"))))
    return _top(worded.filter("word is not null").groupBy("page", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")), "word", least)


def common_prefix(urls: DataFrame, group: str, url: str) -> DataFrame:
    """``group, prefix``: leading path segments that all addresses of a group share, as ``/a/b/``; empty where none is shared.

    What the least and the greatest address share, all share, so two of each group are kept, not all.
    """
    parts = segments(path(url))
    ends = urls.groupBy(group).agg(F.min(parts).alias("_lo"), F.max(parts).alias("_hi"))
    both = F.array(*(F.concat(F.lit("/"), F.array_join(F.coalesce(c, F.array().cast("array<string>")), "/")) for c in ("_lo", "_hi")))
    return ends.select(group, common_path_prefix(both).alias("prefix"))
