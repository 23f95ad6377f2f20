"""Line dedup by site-relative frequency.

A page's lines are what stands between line breaks and block tags, without other tags and outer
blanks; empty ones do not count. Per host, a line's ratio is the pages that hold it divided by the
host's pages. Lines above ``RATIO`` that stand on at least ``LEAST_PAGES`` pages are boilerplate and
are dropped from every page of the host.

A host has at most (mean different lines a page / ``RATIO``) such lines, whatever its size, so they
travel to its pages as one array; the pages themselves are not grouped. Counts combine in the map
tasks, so a host with a third of all pages costs no more than others.

A null or malformed ``url`` is host ''. Null ``html`` is a page without lines. Repeated rows count
as pages of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import cut_lineage

RATIO = 0.3
LEAST_PAGES = 3
BREAK = (
    "(?i)[\\n\\r]+|</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|td|th|table|h[1-6]|nav|header|footer"
    "|main|aside|article|section|form|title|head|body|html|script|style|pre|blockquote)"
    "(?:[ /][^>]*)?>"
)
TAG = "<[^>]*>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def lines_of(html: str = "html") -> Column:
    """The lines of a page, in order."""
    pieces = F.split(F.coalesce(F.col(html), F.lit("")), BREAK, -1)
    clean = F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, TAG, "")))
    return F.filter(clean, lambda x: x != "")


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", host_of().alias("host"), lines_of().alias("lines"))


def boilerplate(
    pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``host, common``: keys of the lines to drop, one row per host that has any."""
    rows = page_lines(pages)
    keys = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    # key null stands for the page itself, so one aggregation gives both counts
    counted = (
        rows.select("host", F.explode(F.array_append(keys, F.lit(None).cast("long"))).alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= least_pages) | F.col("key").isNull())
    )
    counted = cut_lineage(counted)
    totals = counted.where("key IS NULL").select("host", F.col("n").alias("pages"))
    common = (
        counted.where("key IS NOT NULL")
        .join(totals, "host")
        .where(F.col("n") > ratio * F.col("pages"))
    )
    return cut_lineage(common.groupBy("host").agg(F.collect_list("key").alias("common")))


def drop_boilerplate(
    pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text``; ``text`` joins the lines that stay."""
    rows = page_lines(pages).join(boilerplate(pages, ratio, least_pages), "host", "left")
    here = "array_intersect(transform(lines, x -> xxhash64(x)), coalesce(common, array()))"
    kept = F.expr("filter(lines, x -> NOT array_contains(here, xxhash64(x)))")
    return (
        rows.withColumn("here", F.expr(here))
        .withColumn("kept", kept)
        .select(
            "page_id",
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )
