"""Page addresses below sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from nightjar.functions import html

# fixed values: words that name a child worth reading first; children read of one index, sitemaps read beyond them, pages kept
CHILD_HINT = "event|koncert|show|program|arrangement|kalender"
CHILDREN, BEYOND, MOST = 25, 5, 400


def locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), html.decode_xml)


def read_maps(files: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """(map, is_index, locs): each sitemap's addresses in its order.  Of several files of one url the least in order of text stands; null text lists nothing."""
    text = F.coalesce(F.col(xml), F.lit(""))
    maps = files.filter(F.col(url).isNotNull()).select(F.col(url).alias("map"), F.struct(text.rlike("(?i)<sitemapindex").alias("is_index"), locations(text).alias("locs")).alias("m"))
    return maps.groupBy("map").agg(F.min("m").alias("m")).select("map", "m.*")


def _first(locs: Column, n: Column) -> Column:
    """The first ``n``, hinted ones before the others."""
    hinted = lambda u: F.lower(u).rlike(CHILD_HINT)
    return F.slice(F.concat(F.filter(locs, hinted), F.filter(locs, lambda u: ~hinted(u))), 1, n)


def sitemap_visits(maps: DataFrame, roots: DataFrame) -> DataFrame:
    """(source_id, nth, map, listed): sitemaps in the order of a walk in depth from each source's root, each once.

    ``listed`` is true where a sitemap's addresses are pages: of all but opened indexes.  A root and its children are
    opened if they are indexes; an index met two levels down isn't, even if a later child names it again.  At most
    ``children`` are tried of an index, and ``children`` + 5 sitemaps of a source, missing ones counted.

    The maps meet their parents in two equi-joins; the walk itself is a fold over one source's children, which these bounds
    keep to a few hundred addresses.  Circular maps end by the fold, as a sitemap that has been seen is passed over.
    """
    index = maps.select("map", "is_index", F.when(F.col("is_index"), F.col("locs")).alias("kids"))
    top = roots.join(index, F.col("sitemap") == F.col("map"), "left").select("source_id", "sitemap", "children", _first("kids", F.col("children")).alias("kids"))
    child = top.select("source_id", "children", F.posexplode("kids").alias("pos", "child"))
    below = child.join(index, F.col("child") == F.col("map"), "left").select("source_id", F.struct("pos", "child", _first("kids", F.col("children")).alias("kids")).alias("c"))
    gathered = below.groupBy("source_id").agg(F.array_sort(F.collect_list("c")).alias("below"))
    start = F.struct(F.array("sitemap").alias("seen"), F.array("sitemap").alias("opened"))
    told = lambda w: F.transform(w["seen"], lambda m: F.struct(m.alias("map"), F.array_contains(w["opened"], m).alias("opened")))

    def step(acc: Column, c: Column) -> Column:
        walked = F.struct(F.array_union(acc["seen"], F.concat(F.array(c["child"]), F.coalesce(c["kids"], F.array().cast("array<string>")))).alias("seen"), F.array_append(acc["opened"], c["child"]).alias("opened"))
        return F.when(F.array_contains(acc["seen"], c["child"]), acc).otherwise(walked)

    none = F.array().cast("array<struct<pos:int,child:string,kids:array<string>>>")
    walk = top.join(gathered, "source_id", "left").select("source_id", F.slice(F.aggregate(F.coalesce("below", none), start, step, told), 1, F.col("children") + BEYOND).alias("walk"))
    visits = walk.select("source_id", F.posexplode("walk").alias("nth", "v")).select("source_id", "nth", "v.map", "v.opened")
    return visits.join(maps.select("map", "is_index"), "map").select("source_id", "nth", "map", (~(F.col("is_index") & F.col("opened"))).alias("listed"))


def sitemap_pages(files: DataFrame, roots: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """(source_id, place, page): distinct page addresses below each source's sitemap, in the order of the walk.

    ``roots``: source_id (unique), sitemap, and if a source has its own: patterns (array; a page contains one of them, none or null: any), children and most (pages kept).
    Addresses are made distinct before the patterns.  A source without a sitemap, or whose sitemap is missing, has no rows.
    """
    given = {"patterns": F.array().cast("array<string>"), "children": F.lit(CHILDREN), "most": F.lit(MOST)}
    roots = roots.filter("sitemap IS NOT NULL").select("source_id", "sitemap", *(F.coalesce(F.col(c).cast(kind), v).alias(c) if c in roots.columns else v.alias(c) for (c, v), kind in zip(given.items(), ("array<string>", "int", "int"), strict=True)))
    maps = read_maps(files, url, xml)
    listed = sitemap_visits(maps, roots).filter("listed").join(maps.select("map", "locs"), "map").select("source_id", "nth", F.posexplode("locs").alias("pos", "page"))
    first = listed.groupBy("source_id", "page").agg(F.min(F.struct("nth", "pos")).alias("at"))
    wanted = first.join(roots.select("source_id", "patterns", "most"), "source_id").filter((F.size("patterns") == 0) | F.exists("patterns", lambda p: F.contains(F.col("page"), p)))
    return wanted.withColumn("place", F.row_number().over(W.partitionBy("source_id").orderBy("at"))).filter(F.col("place") <= F.col("most")).select("source_id", "place", "page")
