"""Sinks: documents, append-only archives and feeds. Each writes in parallel; only a feed, a short list, is one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayledger.functions.rules import xml_escape
from wayledger.sources.landed import exists


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a dataset, as parquet or as JSON lines."""
    df.write.mode("overwrite").format(kind).save(path)


def append_archive(rows: DataFrame, path: str, key: str, archived_at: Column) -> int:
    """Adds the rows whose key the archive lacks, one a key, stamped with archived_at; how many, as counted while writing.
    The archive is only appended to, so nothing that is there is rewritten."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    seen = Observation()
    rows.dropDuplicates([key]).withColumn("archived_at", archived_at).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def left_register(rows: DataFrame, start_ms: str, now_ms: int, reason: str) -> DataFrame:
    """rows with completed_ms, actual_duration_days (whole days since the start, null without one) and archived_reason."""
    days = F.floor((F.lit(now_ms) - F.col(start_ms)) / 86_400_000).cast("long")
    return rows.withColumns({"completed_ms": F.lit(now_ms).cast("long"), "actual_duration_days": days, "archived_reason": F.lit(reason)})


def analytics_document(blocks: dict[str, DataFrame], path: str, generated: str, counts: dict[str, int]) -> None:
    """An analytics document as a folder: each block as JSON lines under its name, and meta with the time and counts."""
    spark = next(iter(blocks.values())).sparkSession
    for name, block in blocks.items():
        overwrite(block, f"{path}/{name}", "json")
    meta = spark.range(1).select(F.lit(generated).alias("generated"), *[F.lit(n).cast("long").alias(k) for k, n in counts.items()])
    overwrite(meta.coalesce(1), f"{path}/meta", "json")


def _newest(articles: DataFrame, limit: int | None) -> DataFrame:
    top = articles.where(~F.col("draft"))
    return top if limit is None else top.orderBy(F.desc("date"), "id").limit(limit)


def feed_items(articles: DataFrame, site: str, limit: int | None = None) -> DataFrame:
    """(ord, xml): items of a news feed; tags as categories. limit: only so many of the newest."""
    link = F.concat(F.lit(site.rstrip("/") + "/news/"), F.col("id"), F.lit("/"))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<category>"), xml_escape(t), F.lit("</category>"))), "")
    xml = F.concat(F.lit("<item><title>"), xml_escape("title"), F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate><description>"), xml_escape(F.coalesce("description", F.lit(""))), F.lit("</description>"), tags, F.lit("</item>"))
    return _newest(articles, limit).select(F.struct(F.col("date"), F.col("id")).alias("ord"), xml.alias("xml"))


def feed(articles: DataFrame, site: str, title: str, limit: int | None = None) -> DataFrame:
    """One row: the feed's XML, newest first."""
    items = feed_items(articles, site, limit).agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("ord", "xml")))), lambda x: x["xml"]), "").alias("items"))
    return items.select(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{site}</link>'), "items", F.lit("</channel></rss>")).alias("value"))


def sitemap(articles: DataFrame, site: str, publication: str = "News", language: str = "en", limit: int | None = None) -> DataFrame:
    """One row: a news sitemap's XML, newest first, with publication, keywords from the tags, and the last change."""
    link = F.concat(F.lit(site.rstrip("/") + "/news/"), F.col("id"), F.lit("/"))
    day = F.date_format("date", "yyyy-MM-dd")
    words = F.when(F.size("tags") > 0, F.concat(F.lit("<news:keywords>"), xml_escape(F.array_join("tags", ", ")), F.lit("</news:keywords>"))).otherwise("")
    xml = F.concat(F.lit("<url><loc>"), link, F.lit("</loc><lastmod>"), day, F.lit("</lastmod><news:news><news:publication><news:name>"), xml_escape(F.lit(publication)), F.lit(f"</news:name><news:language>{language}</news:language></news:publication><news:publication_date>"), day, F.lit("</news:publication_date><news:title>"), xml_escape("title"), F.lit("</news:title>"), words, F.lit("</news:news></url>"))
    top = _newest(articles, limit).select("date", "id", xml.alias("xml"))
    body = top.agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("date", "id", "xml")))), lambda x: x["xml"]), "").alias("items"))
    return body.select(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'), "items", F.lit("</urlset>")).alias("value"))
