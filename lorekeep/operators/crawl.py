"""Link discovery over a crawl snapshot, for many root URLs in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import urls as ux
from lorekeep.operators.html import extract_links, resolve_links
from lorekeep.session import cut_lineage, tasks_for

MAX_DEPTH = 2
MAX_URLS = 50
# Rows of links or reached pages that a task sorts or groups.
TASK_ROWS = 250_000


def build_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst): accepted same-site links of every page, built once for all roots."""
    return accepted_edges(resolve_links(extract_links(pages)).select(F.col("url").alias("src"), F.col("target").alias("dst")))


def pages_to_read(pages: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pages whose links a crawl from ``roots`` can follow, picked before any page is parsed: with two
    levels the roots' own pages, with more the pages of the roots' sites, since links lead nowhere else."""
    if max_depth <= 2:
        return pages.join(roots.select(F.col("root").alias("url")).distinct(), "url", "left_semi")
    sites = roots.select(ux.site(F.col("root")).alias("_site")).distinct()
    return pages.withColumn("_site", ux.site(F.col("url"))).join(sites, "_site", "left_semi").drop("_site")


def accepted_edges(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct accepted links, told apart in so many ``tasks`` if their number is known."""
    kept = links.filter(ux.same_site(F.col("dst"), F.col("src")) & ux.should_crawl(F.col("dst"))).select("src", "dst")
    return (kept.repartition(tasks, "src", "dst") if tasks else kept).distinct()


def new_links(candidates: DataFrame, visited: DataFrame, on: list[str], tasks: int | None = None) -> DataFrame:
    """Candidates that were not visited, each once, in so many ``tasks`` if the number of candidates is known."""
    if tasks:
        candidates = candidates.select(*on).repartition(tasks, *on)
    return candidates.select(*on).distinct().join(visited.select(*on), on, "left_anti")


def reachable(
    roots: DataFrame,
    edges: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_urls: int | None = MAX_URLS,
    dedupe: str = "exact",
) -> DataFrame:
    """URLs a crawl from each root collects: (root, url, depth).

    ``roots`` has one column ``root``. One equi-join per level, all roots together: the frontier
    carries each (root, url) once, so a page reached over many links joins only once. Pages of level
    d are fetched only while d < ``max_depth`` and the root's count before that level is below
    ``max_urls``; a level is taken whole, never cut. Every level is written to the shared folder, which
    keeps plans short and lets a lost executor be replaced. With more than two levels links and reached pages
    are counted where they are written, and where the session's shuffle partitions would hold more than
    ``TASK_ROWS`` rows a level is dealt out to more. With ``dedupe='canonical'`` the www and plain
    spellings of one page count as one and the smaller spelling is kept.
    """
    links = 0
    if max_depth > 2:
        edges = cut_lineage(edges)
        links = edges.count()
    frontier = cut_lineage(roots.select("root", F.col("root").alias("url"), F.lit(0).alias("depth")).distinct())
    visited, counts = frontier, frontier.select("root", F.lit(1).cast("bigint").alias("_n"))
    for depth in range(1, max_depth):
        tasks = _tasks(visited, links) if links else None
        open_pages = frontier
        if max_urls is not None:
            # Where a side of a join is dealt out, Spark deals the other out alike; it is the smaller one, which may be broadcast.
            open_pages = frontier.join(_in(tasks, counts.filter(F.col("_n") < max_urls), "root"), "root", "left_semi")
        stepped = _in(tasks, open_pages.select("root", F.col("url").alias("src")), "src").join(edges, "src").select("root", F.col("dst").alias("url"), F.lit(depth).alias("depth"))
        frontier = cut_lineage(_first_seen(stepped, visited, depth, dedupe, tasks))
        if depth + 1 == max_depth or frontier.isEmpty():
            visited = visited.unionByName(frontier)
            break
        visited = visited.unionByName(frontier)
        if max_urls is not None:
            # A running table of one row for each root; what was counted before is not counted again.
            grown = counts.unionByName(frontier.groupBy("root").agg(F.count(F.lit(1)).alias("_n")))
            counts = cut_lineage(grown.groupBy("root").agg(F.sum("_n").alias("_n")))
    return visited


def _tasks(visited: DataFrame, links: int) -> int | None:
    """How many tasks a level is dealt out to; None where the session's shuffle partitions are enough."""
    least = int(visited.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-(visited.count() + links) // TASK_ROWS)
    return wanted if wanted > least else None


def _in(tasks: int | None, rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.repartition(tasks, *keys) if tasks else rows


def _first_seen(stepped: DataFrame, visited: DataFrame, depth: int, dedupe: str, tasks: int | None) -> DataFrame:
    """Of the pages reached at ``depth`` those that were not visited, each once: one aggregation that both sides meet in,
    instead of a distinct and an anti-join with an exchange of their own. Both are combined in the map tasks, unless the rows
    are dealt out before, since a map task may read any number of visited pages."""
    both = stepped.unionByName(visited)
    if dedupe != "canonical":
        met = _in(tasks, both, "root", "url").groupBy("root", "url").agg(F.min("depth").alias("depth"))
        return met.filter(F.col("depth") == depth)
    here = F.min(F.when(F.col("depth") == depth, F.col("url")))
    keyed = _in(tasks, both.withColumn("_k", ux.canonical(F.col("url"))), "root", "_k")
    met = keyed.groupBy("root", "_k").agg(F.min("depth").alias("depth"), here.alias("url"))
    return met.filter(F.col("depth") == depth).select("root", "url", "depth")


def listing(crawled: DataFrame) -> DataFrame:
    """In order, range by range; ``crawled`` is counted first."""
    return crawled.repartitionByRange(tasks_for(crawled, TASK_ROWS), "root", "url").sortWithinPartitions("root", "url")


def budget(crawled: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """Hard cap per root, nearest pages first. Only the leading rows of each root leave a map task, which reads a range of
    the pages, so that it sorts no more than its share and meets most of its roots whole. ``crawled`` is counted first."""
    ranges = crawled.repartitionByRange(tasks_for(crawled, TASK_ROWS), "root", "depth", "url")
    rank = F.row_number().over(Window.partitionBy("root").orderBy("depth", "url"))
    return ranges.withColumn("_rank", rank).filter(F.col("_rank") <= max_urls).drop("_rank")
