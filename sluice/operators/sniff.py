"""Network calls of a page: which to keep, how they rank, what they suggest; and JSON listings as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.dates import date_from_iso_prefix
from sluice.functions.jsons import describe_json, dig, json_items, synthesize

#: Suffixes of static files (fixed values).
STATIC = ["js", "css", "png", "jpg", "jpeg", "gif", "svg", "woff", "woff2", "ttf", "ico", "webp", "mp4"]
#: Parts of an error that say a service is busy, not that the request is wrong (fixed values).
TRANSIENT = ["429", "500", "502", "503", "529", "overloaded", "unavailable", "rate_limit", "rate limit", "resource_exhausted", "resource exhausted", "quota", "timeout", "timed out", "deadline", "internal error", "high demand", "capacity"]


def is_static(url: Column) -> Column:
    return F.split_part(F.lower(url), F.lit("?"), F.lit(1)).rlike(r"\.(" + "|".join(STATIC) + ")$")


def looks_json(content_type: Column, body: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("json"), F.lit(False)) | F.substring(F.ltrim(body), 1, 1).isin("{", "[")


def is_transient(error: Column) -> Column:
    found = F.lit(False)
    for part in TRANSIENT:
        found |= F.lower(error).contains(part)
    return F.coalesce(found, F.lit(False))


def rank_calls(calls: DataFrame, preview: int = 4_000) -> DataFrame:
    """Calls (``page, pos, method, url, content_type, body``) that carry JSON, listings first, larger first, else in order."""
    kept = calls.filter(~is_static(F.col("url")) & looks_json(F.col("content_type"), F.col("body"))).withColumn("d", describe_json("body"))
    c = kept.select("page", "pos", "method", "url", F.col("d.shape").alias("json_shape"), F.coalesce("d.item_count", F.lit(0)).alias("item_count"), F.coalesce("d.item_keys", F.array().cast("array<string>")).alias("item_keys"), F.coalesce("d.is_listing", F.lit(False)).alias("is_listing"), F.when(F.col("d").isNull(), F.substring("body", 1, 200)).otherwise(F.substring("body", 1, preview)).alias("preview"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.col("is_listing").desc(), F.col("item_count").desc(), "pos")))


def suggest(ranked: DataFrame) -> DataFrame:
    """``page, n_calls, api_url, query, items_key, note`` of each page from its ranked calls."""
    top = F.min_by(F.struct("method", "url", "json_shape", "is_listing"), "rank").alias("top")
    x = ranked.groupBy("page").agg(F.count("*").alias("n_calls"), top)
    listing = F.col("top.is_listing")
    base = F.split_part("top.url", F.lit("?"), F.lit(1))
    query = F.nullif(F.expr("substring(top.url, length(split_part(top.url, '?', 1)) + 1)"), F.lit(""))
    note = F.when(~listing & (F.col("n_calls") <= 2), "almost no requests: the page may have served a stub").when(~listing, "calls were seen but none returned a list").when(F.col("top.method") != "GET", F.concat(F.lit("the listing call is a "), F.col("top.method")))
    return x.select("page", "n_calls", F.when(listing, base).alias("api_url"), F.when(listing, query).alias("query"), F.when(listing, F.nullif(F.regexp_extract("top.json_shape", "^object with '(.*)' array$", 1), F.lit(""))).alias("items_key"), note.alias("note"))


def metadata_items(payloads: DataFrame, api_url: str, payload: str = "payload", items_key: str | None = "items", fields: list[tuple[str, str]] = (), date_field: str = "date", id_field: str = "id", filter_path: str | None = "category.key", filter_value: str | None = None, limit: int = 3) -> DataFrame:
    """Documents of JSON listings (``api_url`` and ``payload`` columns): filtered, then the first ``limit``, with a synthesized text.

    A missing, null, false, zero or empty id is ``unknown``. The filter compares strings only: a number is never equal.
    """
    x = payloads.select(F.col(api_url).alias("api_url"), F.posexplode(json_items(payload, items_key)).alias("pos", "item"))
    if filter_path and filter_value:
        value = F.try_variant_get(F.try_parse_json("item"), "$" + "".join(f"['{p}']" for p in filter_path.split(".")), "variant")
        x = x.filter((F.schema_of_variant(value) == "STRING") & (value.cast("string") == filter_value))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("api_url").orderBy("pos"))).filter(F.col("rank") <= limit)
    i = dig("item", id_field)
    bad = i.isNull() | i.isin("", "0", "0.0", "false")
    return x.select("api_url", "rank", F.concat("api_url", F.lit("/"), F.when(bad, "unknown").otherwise(i)).alias("source_url"), date_from_iso_prefix(dig("item", date_field)).alias("doc_date"), synthesize("item", list(fields)).alias("raw_html"))


def media_items(payloads: DataFrame, api_url: str, payload: str = "payload", url_field: str = "source_url", date_field: str = "date", downloaded: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """Files of media listings: .pdf items, then the first ``limit`` that could be downloaded (all, without ``downloaded``: ``source_url``)."""
    x = payloads.select(F.col(api_url).alias("api_url"), F.posexplode(json_items(payload, None)).alias("pos", "item")).withColumn("source_url", dig("item", url_field))
    x = x.filter(F.endswith(F.lower("source_url"), F.lit(".pdf")))
    if downloaded is not None:
        x = x.join(downloaded.select("source_url").distinct(), "source_url", "left_semi")
    w = Window.partitionBy("api_url").orderBy("pos")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("api_url", "rank", "source_url", date_from_iso_prefix(dig("item", date_field)).alias("doc_date"))
