"""Sitemaps: location, parsing, and the crawl filter over their URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import urls as ux

SITEMAP_NAME = "sitemap.xml"


def sitemap_location(base: DataFrame, base_url: str = "base_url", name: str = SITEMAP_NAME) -> DataFrame:
    return base.withColumn("sitemap_url", ux.resolve(F.col(base_url), F.lit(name)))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """All ``loc`` texts of fetched sitemaps (base_url, status, xml) as (base_url, url).

    Namespaces do not matter. A 404 stands for the base URL itself; another error status and
    malformed XML fail the job. Sitemap files are limited to 50,000 URLs by their standard.
    """
    located = F.xpath(F.col("xml"), F.lit("//*[local-name()='loc']/text()"))
    home = F.array(F.regexp_replace("base_url", "/+$", ""))
    failed = F.raise_error(F.concat(F.lit("failed to fetch sitemap of "), F.col("base_url")))
    found = (
        F.when(F.col("status") == 404, home)
        .when(F.col("status") >= 400, failed.cast("array<string>"))
        .otherwise(located)
    )
    return sitemaps.select("base_url", F.explode(found).alias("url"))


def crawlable(urls: DataFrame) -> DataFrame:
    return urls.filter(ux.should_crawl(F.col("url")))


def filter_report(urls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """URLs kept by the crawl filter and in total."""
    return urls.groupBy(*(by or [])).agg(
        F.count_if(ux.should_crawl(F.col("url"))).alias("kept"),
        F.count(F.lit(1)).alias("total"),
    )


def sitemap_pages(sitemaps: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the snapshot that a sitemap lists and the crawl filter accepts."""
    wanted = crawlable(sitemap_urls(sitemaps)).select("url").distinct()
    return pages.join(wanted, "url", "left_semi")
