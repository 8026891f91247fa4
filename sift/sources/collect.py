"""Landed source payloads -> post rows.

Collection over the network is outside the library; payloads are landed as
files and read with explicit schemas (never inferred). Each reader returns
``text, source, url`` rows; ``with_post_id`` adds a stable key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.functions import text as X

LISTING = T.StructType([T.StructField("data", T.StructType([T.StructField("children", T.ArrayType(
    T.StructType([T.StructField("data", T.StructType([
        T.StructField("title", T.StringType()), T.StructField("selftext", T.StringType()),
        T.StructField("permalink", T.StringType())]))])))]))])

# Feeds, read without namespaces: RSS 2 (channel/item), RSS 1 (item) and Atom (entry).
_VALUE = "struct<_VALUE: string, _type: string>"
_ITEM = "struct<title: string, link: string, description: string, summary: string, encoded: string>"
_ENTRY = f"struct<title: {_VALUE}, link: array<struct<_href: string, _rel: string>>, summary: {_VALUE}, content: array<{_VALUE}>>"
FEED = f"channel struct<item: array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ENTRY}>"

COMMENTS = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("items", T.ArrayType(
    T.StructType([T.StructField("snippet", T.StructType([T.StructField("topLevelComment", T.StructType([
        T.StructField("snippet", T.StructType([T.StructField("textDisplay", T.StringType())]))]))]))])))])

VIDEOS = T.StructType([T.StructField("id", T.StructType([T.StructField("videoId", T.StringType())])),
                       T.StructField("snippet", T.StructType([T.StructField("title", T.StringType())]))])


def with_post_id(df: DataFrame) -> DataFrame:
    """Stable key: first 16 hex digits of sha256(source || url || text)."""
    return df.withColumn("post_id", F.substring(F.sha2(F.concat_ws("\u0001", "source", "url", "text"), 256), 1, 16))


def forum_listing(spark: SparkSession, path: str, base_url: str, listing_url: str,
                  source: str = "forum") -> DataFrame:
    """children[].data -> "title. selftext" (or title), len > 15,
    url = base + permalink or the listing url."""
    d = spark.read.schema(LISTING).json(path)
    posts = d.select(F.explode("data.children").alias("c")).select("c.data.*")
    text = X.title_body(F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit("")))
    url = F.when(F.coalesce(F.col("permalink"), F.lit("")) != "", F.concat(F.lit(base_url), F.col("permalink"))) \
        .otherwise(F.lit(listing_url))
    return (posts.select(text.alias("text"), F.lit(source).alias("source"), url.alias("url"))
            .filter(F.length("text") > 15))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files, one payload a file: ``path, payload``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def feed_items(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Items of RSS and Atom payloads: the input's other columns and ``ord, title, summary, content,
    link``. The summary is an item's summary or description, the content its first
    content (``content:encoded`` in RSS), the link ``link`` or the ``href`` of the first
    ``alternate`` link, else of the first link. A payload that is not XML gives no items."""
    keep = [c for c in payloads.columns if c != payload_col]
    f = F.from_xml(F.col(payload_col), FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})

    def rss(items):
        return F.transform(items, lambda i: F.struct(
            i["title"].alias("title"), F.coalesce(i["summary"], i["description"]).alias("summary"), i["encoded"].alias("content"), i["link"].alias("link")))

    def entry(e):
        first = lambda links: F.try_element_at(links, F.lit(1))["_href"]
        own = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(e["title"]["_VALUE"].alias("title"), e["summary"]["_VALUE"].alias("summary"),
                        F.try_element_at(e["content"], F.lit(1))["_VALUE"].alias("content"), F.coalesce(first(own), first(e["link"])).alias("link"))

    empty = F.array().cast("array<struct<title:string,summary:string,content:string,link:string>>")
    d = payloads.select(*keep, f.alias("__f"))
    items = [rss(F.col("__f.channel.item")), rss(F.col("__f.item")), F.transform("__f.entry", entry)]
    d = d.select(*keep, F.concat(*[F.coalesce(x, empty) for x in items]).alias("__items"))
    return d.select(*keep, F.posexplode("__items").alias("ord", "__i")).select(*keep, "ord", "__i.*")


def rss_posts(items: DataFrame, name: str, feed_url: str) -> DataFrame:
    """Title + tag-stripped summary; len > 20; source "RSS: name"; url = link or feed url."""
    title, summary = X.strip_u(F.coalesce("title", F.lit(""))), X.strip_html(X.strip_u(F.coalesce("summary", F.lit(""))))
    text = F.when(summary != "", F.concat(title, F.lit(". "), summary)).otherwise(title)
    keep = [c for c in items.columns if c not in ("title", "summary", "content", "link")]
    return (items.select(*keep, text.alias("text"), F.lit(f"RSS: {name}").alias("source"), F.coalesce("link", F.lit(feed_url)).alias("url"))
            .filter(F.length("text") > 20))


def forum_posts(items: DataFrame, source: str, feed_url: str, max_chars: int = 500) -> DataFrame:
    """body = first content value else summary (or description), tag-stripped; appended
    only if longer than 10; combined len > 15; cut to ``max_chars``."""
    body = X.strip_u(X.strip_html(F.coalesce("content", "summary", F.lit(""))))
    title = X.strip_u(F.coalesce("title", F.lit("")))
    text = F.when(F.length(body) > 10, F.concat(title, F.lit(". "), body)).otherwise(title)
    keep = [c for c in items.columns if c not in ("title", "summary", "content", "link")]
    return (items.select(*keep, text.alias("text"), F.lit(source).alias("source"), F.coalesce("link", F.lit(feed_url)).alias("url"))
            .filter(F.length("text") > 15)
            .withColumn("text", F.substring("text", 1, max_chars)))


def rss_items(spark: SparkSession, path: str, name: str, feed_url: str) -> DataFrame:
    """A7 over landed files."""
    return rss_posts(feed_items(read_payloads(spark, path)), name, feed_url).select("text", "source", "url")


def forum_rss(spark: SparkSession, path: str, source: str, feed_url: str, max_chars: int = 500) -> DataFrame:
    """A8 over landed files."""
    return forum_posts(feed_items(read_payloads(spark, path)), source, feed_url, max_chars).select("text", "source", "url")


def comment_threads(spark: SparkSession, videos_path: str, comments_path: str, source: str = "video",
                    url_prefix: str = "https://www.youtube.com/watch?v=") -> DataFrame:
    """Videos joined to their comment threads; tag-stripped top-level
    comments longer than 15."""
    v = spark.read.schema(VIDEOS).json(videos_path).select(F.col("id.videoId").alias("video_id"),
                                                             F.col("snippet.title").alias("title"))
    c = spark.read.schema(COMMENTS).json(comments_path)
    com = c.select("video_id", F.explode("items").alias("it")).select(
        "video_id", X.strip_u(X.strip_html(F.col("it.snippet.topLevelComment.snippet.textDisplay"))).alias("text"))
    return (v.join(com, "video_id")
            .select("text", F.lit(source).alias("source"), F.concat(F.lit(url_prefix), F.col("video_id")).alias("url"))
            .filter(F.length("text") > 15))


def uploaded_texts(spark: SparkSession, path: str, kind: str = "txt", source: str = "upload") -> DataFrame:
    """A5: CSV -> first column, non-null, cast to string, non-blank; TXT ->
    one text per non-blank stripped line. url = ""."""
    if kind == "csv":
        d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        first = d.columns[0]
        t = d.select(F.col(first).cast("string").alias("text")).filter(F.col("text").isNotNull())
        t = t.filter(X.strip_u("text") != "")
    else:
        t = spark.read.text(path).select(X.strip_u("value").alias("text")).filter(F.col("text") != "")
    return t.select("text", F.lit(source).alias("source"), F.lit("").alias("url"))


def fallback(primary: DataFrame, secondary: DataFrame, target: str) -> DataFrame:
    """A10: primary rows per target; secondary rows only for targets the
    primary did not produce (left-anti join on the distinct targets)."""
    have = primary.select(target).distinct()
    return primary.unionByName(secondary.join(have, target, "left_anti"))


def union_clean(frames: list[DataFrame], default_source: str = "OSINT") -> DataFrame:
    """Union in order (missing columns allowed), drop texts that are
    blank after stripping, default source and url."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    for c in ("source", "url"):
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None).cast("string"))
    return (u.filter(F.coalesce(X.strip_u("text"), F.lit("")) != "")
            .withColumn("source", F.coalesce(F.col("source"), F.lit(default_source)))
            .withColumn("url", F.coalesce(F.col("url"), F.lit(""))))
