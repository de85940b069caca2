"""Feeds, payloads and subscription lists: text columns that hold XML or JSON, read into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnframe.functions.exprs import strip
from dawnframe.operators.topk import first_k

CHANNEL = "channel struct<item: array<struct<title: string, link: string, pubDate: string, source: string>>>"
#: Fixed value: the text for what is missing.
DEFAULT_SOURCE = "Google News"


def _items(feeds: DataFrame, key: str, raw: str) -> DataFrame:
    """Every item of every feed in order; a malformed feed has none.

    The array is asked for by element name, so feeds with one item or thousands read alike.
    """
    parsed = F.from_xml(F.col(raw), CHANNEL, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    return feeds.select(key, F.posexplode(parsed.channel.item).alias("position", "item"))


def rss_items(feeds: DataFrame, key: str, raw: str, most: int) -> DataFrame:
    """(key, position, title, link, pub_date): of the first ``most`` items of each feed those with a title, stripped."""
    text = lambda name: strip(F.coalesce(F.col(f"item.{name}"), F.lit("")))
    rows = _items(feeds, key, raw).where(F.col("position") < most)
    rows = rows.select(key, F.col("position").cast("long").alias("position"), text("title").alias("title"), text("link").alias("link"), text("pubDate").alias("pub_date"))
    return rows.where("title <> ''")


def rss_items_with_source(feeds: DataFrame, key: str, raw: str, most: int = 5) -> DataFrame:
    """(key, position, title, link, source): the first ``most`` items that have both a title and a link."""
    rows = _items(feeds, key, raw).where("coalesce(item.title, '') <> '' and coalesce(item.link, '') <> ''")
    kept = first_k(rows, [key], ["position"], most)
    return kept.select(key, F.col("position").cast("long").alias("position"), "item.title", "item.link", F.coalesce("item.source", F.lit(DEFAULT_SOURCE)).alias("source"))


ITEM = "title string, link string, source string, pubDate string"
REJECTED = "_rejected"


def feed_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Feed files of any size as (items, rejected).

    Records end with ``</item>``, so Spark splits large files among tasks, and an item that isn't well formed spoils no other.  Items: (title,
    link, source, pub_date), stripped, with a title.  Rejected: ``record``, the text of an element that can't be read.
    """
    end = "</item>"
    records = spark.read.option("lineSep", end).text(path).where(F.col("value").rlike("<item[\\s>]"))
    record = F.concat(F.regexp_extract("value", "(?s)<item[\\s>].*", 0), F.lit(end))
    parsed = F.from_xml(record, f"{ITEM}, {REJECTED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED, "ignoreSurroundingSpaces": "false"})
    rows = records.select(record.alias("record"), parsed.alias("item"))
    text = lambda name: strip(F.coalesce(F.col(f"item.{name}"), F.lit("")))
    bad = F.col("item").isNull() | F.col(f"item.{REJECTED}").isNotNull()
    items = rows.where(~bad).select(text("title").alias("title"), text("link").alias("link"), F.coalesce("item.source", F.lit(DEFAULT_SOURCE)).alias("source"), text("pubDate").alias("pub_date"))
    return items.where("title <> ''"), rows.where(bad).select("record")


def json_field_scan(rows: DataFrame, text: str, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """``rows`` with one column for each field of a JSON text: (type, default for a missing or unreadable one)."""
    parsed = F.from_json(text, "struct<" + ", ".join(f"`{n}`: {kind}" for n, (kind, _) in fields.items()) + ">")
    return rows.withColumns({n: F.coalesce(parsed[n], F.lit(default).cast(kind)) for n, (kind, default) in fields.items()})


FORECAST = """records struct<location: array<struct<locationName: string, weatherElement: array<struct<elementName: string,
  time: array<struct<startTime: string, parameter: struct<parameterName: string>>>>>>>>"""


def forecast_elements(payloads: DataFrame, raw: str) -> DataFrame:
    """(location, element, idx, start, value) of nested forecast payloads."""
    parsed = F.from_json(raw, f"struct<{FORECAST}>")
    places = payloads.select(F.explode(parsed.records.location).alias("l"))
    elements = places.select(F.col("l.locationName").alias("location"), F.explode("l.weatherElement").alias("e"))
    times = elements.select("location", F.col("e.elementName").alias("element"), F.posexplode("e.time").alias("idx", "t"))
    return times.select("location", "element", F.col("idx").cast("long").alias("idx"), F.col("t.startTime").alias("start"), F.col("t.parameter.parameterName").alias("value"))


def topics_explode(subscriptions: DataFrame, lists: str) -> DataFrame:
    """(account, position, topic) of a column ``map<account, array<topic>>``."""
    accounts = subscriptions.select(F.explode(lists).alias("account", "topics"))
    return accounts.select("account", F.posexplode("topics").alias("position", "topic")).withColumn("position", F.col("position").cast("long"))


def xml_text(x: Column) -> Column:
    """A text with the characters that XML reserves escaped."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(raw), F.lit(escaped))
    return x


def plain_text(x: Column) -> Column:
    """A text with its references to marks decoded, each once; a bare or cut one stays as it is."""
    for escaped, raw in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(escaped), F.lit(raw))
    return x


#: What begins a text that is carried percent-encoded, or stands for null.
ENCODED, NO_TEXT = "encoded:", "null:"
#: Texts that XML gives back as they are: no other control characters than tab and line feed, white space at neither end, and not empty.
PLAIN = r"[^\s\x00-\x1F\uFFFE\uFFFF]([^\x00-\x08\x0B-\x1F\uFFFE\uFFFF]*[^\s\x00-\x1F\uFFFE\uFFFF])?"


def carried(x: Column) -> Column:
    """Any text, null too, as one that an XML element gives back whole; ``uncarried`` undoes it."""
    plain = x.rlike(rf"\A{PLAIN}\z") & ~x.startswith(ENCODED) & ~x.startswith(NO_TEXT)
    return F.when(x.isNull(), NO_TEXT).when(plain, x).otherwise(F.concat(F.lit(ENCODED), F.url_encode(x)))


def uncarried(x: Column) -> Column:
    return F.when(x.startswith(ENCODED), F.url_decode(F.substr(x, F.lit(len(ENCODED) + 1)))).when(x != NO_TEXT, x)
