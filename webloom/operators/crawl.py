"""Site maps: sitemap entries and links as edges, a frontier that widens level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import urls as U
from webloom.operators.pages import links
from webloom.sources import content
from webloom.sources.shared import stored
from webloom.sources.tables import per_text

# URLs and depth by default and at most.
URLS, MOST_URLS = 200, 2000
DEPTH, MOST_DEPTH = 2, 5
#: Sitemap files that a site reads at most, and how deep indexes may name others. Fixed values.
MOST_FILES, MOST_FILE_DEPTH = 50, 3


def _settled(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder, so that a level is computed once."""
    return stored(df, "crawl")


def _step(pre: Column, url: Column) -> Column:
    """One step of the path that found a URL; paths of a level sort as the crawl goes."""
    return F.array(F.struct(pre.cast("long").alias("pre"), url.alias("url")))


def site_of(url: Column) -> Column:
    """Scheme and authority, as the address has them."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def edges(pages: DataFrame) -> DataFrame:
    """url, pre, target: links to the same scheme and authority, without fragments."""
    found = links(pages).join(pages.select("page_id", F.col("url").alias("_from")), "page_id")
    out = found.select(U.normalised(F.col("_from")).alias("url"), "pre", U.normalised(F.col("href")).alias("target"))
    return out.where((F.col("target") != "") & (site_of(F.col("target")) == site_of(F.col("url"))))


def site_map(seeds: DataFrame, edges: DataFrame, listed: DataFrame | None = None, most_urls: int | None = 0, most_depth: int = 0) -> DataFrame:
    """origin, place, url, source, depth, truncated: the URLs of each seed's site, in the order found.

    ``seeds``: url, one an origin. ``edges``: url, pre, target. ``listed``: url, place of sitemap entries. The seed comes first, then
    sitemap entries of its origin, then what the crawl reaches, breadth first; the first source of a URL wins, and entries of a
    sitemap are crawled too. A level is one equi-join with the frontier and one anti join with what was reached. A site can use no
    more than ``2 * most_urls`` rows of a level (sitemap entries take no place again), so each level is cut there by a group limit
    that runs before the shuffle: a hot site stays small. With ``most_urls=None`` sites are mapped whole: a URL's place in its level
    is the path that found it, so that no level is numbered by site; only who selects the final ``place`` pays for it.
    """
    n = None if most_urls is None else min(most_urls, MOST_URLS) if most_urls > 0 else URLS
    depths = min(most_depth, MOST_DEPTH) if most_depth > 0 else DEPTH
    start = seeds.select(U.normalised(F.col("url")).alias("url")).where("url <> ''").distinct().select(site_of(F.col("url")).alias("origin"), "url", F.lit(0).alias("depth"), _step(F.lit(1), F.lit("")).alias("place"))
    frontier = reached = _settled(start)
    for depth in range(1, depths + 1):
        first = F.min(F.concat("place", _step(F.col("pre"), F.col("target")))).alias("place")
        found = frontier.join(edges, "url").groupBy("origin", F.col("target").alias("url")).agg(first).join(reached.select("origin", "url"), ["origin", "url"], "left_anti")
        if n is not None:
            found = found.withColumn("_at", F.row_number().over(Window.partitionBy("origin").orderBy("place"))).where(F.col("_at") <= 2 * n)
        frontier = _settled(found.select("origin", "url", F.lit(depth).alias("depth"), "place"))
        reached = reached.unionByName(frontier)
    rows = reached.select("origin", "url", "depth", F.lit("crawl").alias("source"), F.when(F.col("depth") == 0, 0).otherwise(2).alias("_rank"), "place")
    if listed is not None:
        own = listed.select(U.normalised(F.col("url")).alias("url"), "place").withColumn("origin", site_of(F.col("url"))).where("url <> ''")
        own = own.join(start.select("origin").distinct(), "origin", "left_semi").groupBy("origin", "url").agg(F.min("place").alias("place"))
        rows = rows.unionByName(own.select("origin", "url", F.lit(0).alias("depth"), F.lit("sitemap").alias("source"), F.lit(1).alias("_rank"), _step(F.col("place"), F.lit("")).alias("place")))
    order = ["_rank", "depth", "place", "url"]
    best = rows.groupBy("origin", "url").agg(F.min(F.struct(*order[:3], "source")).alias("b")).select("origin", "url", "b.*")
    ranked = best.withColumn("_at", F.row_number().over(Window.partitionBy("origin").orderBy(*order)))
    if n is None:
        return ranked.select("origin", F.col("_at").alias("place"), "url", "source", "depth", F.lit(False).alias("truncated"))
    # one row beyond the cut tells that there are more
    ranked = ranked.where(F.col("_at") <= n + 1)
    whole = ranked.withColumn("truncated", F.max("_at").over(Window.partitionBy("origin")) > n)
    return whole.where(F.col("_at") <= n).select("origin", F.col("_at").alias("place"), "url", "source", "depth", "truncated")


def expanded(starts: DataFrame, resources: DataFrame, most_files: int = MOST_FILES, most_depth: int = MOST_FILE_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(locs, files) of sites by their sitemap files, indexes followed.

    ``starts``: origin, place, url of the first files (as robots files name them, and the usual one). ``resources``: url, status, body (bytes, gzipped or not).
    A level is one equi-join of the files to read with the resources, one parse, and one anti join with what was queued before, which
    ends loops. A site reads ``most_files`` files in the order of its queue (level by level; what can't be fetched counts too); the
    group limit by site runs before the shuffle. ``locs``: origin, file, place, url, lastmod, of the own site only; ``files``: origin, place, url, depth, kind (null: not read), error, truncated.
    """
    page = Window.partitionBy("origin")
    queued = starts.select("origin", U.normalised(F.col("url")).alias("url"), "place").where("url <> ''").groupBy("origin", "url").agg(F.min("place").alias("place"))
    known, levels, found = None, [], []
    for depth in range(most_depth + 1):
        have = known.groupBy("origin").agg(F.count(F.lit(1)).alias("_have")) if known is not None else None
        ranked = queued.join(have, "origin", "left") if have is not None else queued.withColumn("_have", F.lit(0))
        ranked = ranked.withColumn("_at", F.coalesce("_have", F.lit(0)) + F.row_number().over(page.orderBy("place", "url")))
        # one file beyond the cut tells that there are more
        level = ranked.where(F.col("_at") <= most_files + 1).select("origin", "url", F.col("_at").alias("place"), F.lit(depth).alias("depth"))
        level = level.where(F.col("place") <= most_files + 1)
        read = level.where(F.col("place") <= most_files).join(resources.where("status BETWEEN 200 AND 299").select("url", F.col("body").cast("binary").alias("body")), "url", "left")

        def kernel(body: bytes | None) -> list[dict]:
            if body is None:
                return [{}]
            kind, entries = content.sitemap(bytes(body))
            return [{"kind": kind}] + [{"kind": kind, "at": i, "loc": loc, "lastmod": mod} for i, (loc, mod) in enumerate(entries)]

        rows = stored(per_text(read.select(F.struct("origin", "url", "place", "depth").alias("file"), "body"), kernel, "kind string, at int, loc string, lastmod string", "file", "body"), "sitemaps")
        over = level.where(F.col("place") > most_files)
        levels.append(rows.where("at IS NULL").select("file.origin", "file.place", "file.url", "file.depth", "kind", "error").unionByName(over.select("origin", "place", "url", "depth", F.lit(None).cast("string").alias("kind"), F.lit("beyond the limit of files").alias("error"))))
        found.append(rows.where("kind = 'urlset' AND at IS NOT NULL").select("file.origin", F.col("file.place").alias("file"), F.col("at").alias("place"), F.col("loc").alias("url"), "lastmod"))
        known = levels[-1] if known is None else known.unionByName(levels[-1])
        below = rows.where("kind = 'sitemapindex' AND at IS NOT NULL").select("file.origin", U.normalised(F.col("loc")).alias("url"), F.struct("file.place", "at").alias("p")).where("url <> ''").groupBy("origin", "url").agg(F.min("p").alias("p"))
        fresh = below.join(known.select("origin", "url"), ["origin", "url"], "left_anti")
        queued = fresh.select("origin", "url", F.row_number().over(page.orderBy("p", "url")).alias("place"))
    locs, files = found[0], levels[0]
    for x, y in zip(found[1:], levels[1:], strict=True):
        locs, files = locs.unionByName(x), files.unionByName(y)
    files = files.withColumn("truncated", F.max("place").over(page) > most_files)
    return locs.where(site_of(F.col("url")) == F.col("origin")), files.where(F.col("place") <= most_files)
