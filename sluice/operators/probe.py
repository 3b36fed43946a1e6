"""Which adapter fits a page: candidates with confidence, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.html import LINKS
from sluice.functions.urls import common_path_prefix, host, is_pdf, path, platform_of, shape_pattern, slug_shape
from sluice.operators import links as L

#: A page of so little text behind so many scripts fills itself in later.
SHELL_TEXT, SHELL_SCRIPTS = 600, 5
USEFUL_CHARS = 500
#: What to try for each kind of block (fixed keys).
NEXT_STEPS = {
    "waf": "Try a hosted browser before accepting this as blocked.",
    "ip_blocked": "Datacenter addresses are refused; a hosted browser with a residential exit may pass.",
    "captcha": "Needs a person or an agreement with the site.",
    "login_required": "Needs credentials or an agreement with the site.",
    "paywall": "Needs a subscription that allows automated access.",
    "no_public_archive": "Poll the listing on a schedule to catch documents as they appear.",
}
#: Advice for platforms without an adapter of their own.
PLATFORM_HINTS = {
    "boarddocs": "It has a public JSON interface on every site; write an adapter for that.",
    "granicus": "Its pages are server-rendered tables with file links; a direct or listing adapter often works.",
    "legistar": "It has a documented public REST interface; prefer that.",
    "civicclerk": "It loads JSON; sniff the calls for the endpoint and use the JSON adapter.",
}


def next_step_for(reason: Column) -> Column:
    """Advice for a block reason, with a default."""
    known = F.create_map(*(F.lit(x) for kv in NEXT_STEPS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, reason), F.lit("No known way through. Revisit if the site changes."))


def is_shell(text_chars: Column, script_tags: Column) -> Column:
    return (text_chars < SHELL_TEXT) & (script_tags >= SHELL_SCRIPTS)


def unreachable(status: Column, error: Column) -> Column:
    """``platform, source_type, confidence, proxy`` for a page that was not fetched."""
    refused, silent = F.coalesce(status.isin(401, 403, 406, 429, 503), F.lit(False)), F.coalesce(error.contains("timeout") | error.contains("connection failed"), F.lit(False))
    gone = F.coalesce(status == 404, F.lit(False))
    blocked = refused | (~gone & silent)
    return F.struct(
        F.when(blocked, "blocked").otherwise("unreachable").alias("platform"),
        F.when(blocked, "cloud_render").alias("source_type"),
        F.when(refused, "medium").when(blocked, "low").alias("confidence"),
        (blocked & ~refused).alias("proxy"),
    )


def _first_of_most(values: Column, least: int) -> Column:
    """``n, v``: the most common of an array's values, the one met first among equals; null where it comes fewer than ``least`` times."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("v"))
    best = F.aggregate(counted, none, lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return F.when(best["n"] >= least, best)


def candidates(pages: DataFrame, content_types: DataFrame | None = None, read: str = "read", page: str = "page") -> DataFrame:
    """``page, rank, source_type, platform, confidence, evidence_count, detail, config, evidence, next_step``: candidates of each page, best first.

    ``pages`` has each ``page`` (an address) once with ``read_page``'s struct, links in page order; ``content_types`` (``href,
    content_type``) says what links serve, for documents without an extension. Candidates are
    made in a fixed order and ranked by confidence, equals in that order. All comes from a page's own row: nothing is
    shuffled but, with ``content_types``, the one link of each page that is asked for.
    """
    r = F.col(read)
    none = F.lit(None).cast("string")
    lower_path = lambda l: F.lower(F.split_part(l["href"], F.lit("?"), F.lit(1)))
    is_doc = lambda l: lower_path(l).rlike(r"\.(pdf|doc|docx)$")
    same = lambda l: (host(l["href"]) == host(F.col("page"))) & (F.trim(path(l["href"]), F.lit("/")) != "")
    x = pages.select(F.col(page).alias("page"), r.alias("read")).select(
        "page", platform_of("page").alias("platform"), *(F.col(f"read.{c}").alias(c) for c in ("text_chars", "script_tags", "wp_api")),
        F.coalesce("read.links", F.array().cast(LINKS)).alias("links"),
    )
    pdf = F.filter("links", lambda l: is_pdf(l["href"], strip_query=True))
    routes = F.filter(F.transform(F.filter("links", same), lambda l: F.struct(slug_shape(path(l["href"])).alias("shape"), l["href"].alias("href"))), lambda l: l["shape"].contains("<n>") | l["shape"].contains("<slug>"))
    worded = F.filter("links", lambda l: ~is_doc(l))
    words = F.filter(F.transform(worded, lambda l: F.struct(L.doc_word(F.lower(F.concat_ws(" ", l["href"], l["label"]))).alias("word"), l["href"].alias("href"))), lambda l: l["word"].isNotNull())
    x = x.select("page", "platform", "text_chars", "script_tags", "wp_api", F.transform(pdf, lambda l: F.regexp_extract(l["href"], r"^(.*)/[^/]*$", 1)).alias("folders"), routes.alias("routes"), words.alias("words"))
    x = x.withColumn("n_pdf", F.size("folders")).withColumn("folder", _first_of_most(F.col("folders"), 1)["v"])
    x = x.withColumn("route", _first_of_most(F.col("routes.shape"), 3)).withColumn("word", _first_of_most(F.col("words.word"), 2))
    if content_types is not None:
        # Of pages with few plain files, what the first link of the likeliest group serves.
        mine = F.when(F.col("route").isNotNull(), F.transform(F.filter("routes", lambda l: l["shape"] == F.col("route")["v"]), lambda l: l["href"])).otherwise(F.col("words.href"))
        x = x.withColumn("asked", F.when((F.col("n_pdf") < 3) & (F.size(mine) > 0), mine)).drop("routes", "words", "folders")
        serves = content_types.groupBy(F.col("href").alias("_asked")).agg(F.max("content_type").alias("serves"))
        x = x.withColumn("_asked", F.get("asked", 0)).join(serves, "_asked", "left").drop("_asked")
        hidden = F.coalesce(F.lower("serves").contains("application/pdf"), F.lit(False))
        folder = common_path_prefix(F.transform("asked", path))
    else:
        x = x.drop("routes", "words", "folders").withColumn("asked", F.lit(None).cast("array<string>"))
        hidden, folder = F.lit(False), none
    generic = F.when(F.col("platform") == "unknown", "generic_html").otherwise(F.col("platform"))
    as_json = lambda **kv: F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in kv.items())), {"ignoreNullFields": "true"})

    def made(when: Column, order: int, source_type, platform, confidence, count, detail, config: Column, evidence: Column, step: Column = none) -> Column:
        c = lambda v: v if isinstance(v, Column) else F.lit(v)
        level = F.when(c(confidence) == "high", 0).when(c(confidence) == "medium", 1).otherwise(2)
        return F.when(when, F.struct(
            level.alias("level"), F.lit(order).alias("made"), c(source_type).cast("string").alias("source_type"), c(platform).alias("platform"), c(confidence).alias("confidence"),
            c(count).cast("bigint").alias("evidence_count"), c(detail).cast("string").alias("detail"), config.alias("config"), evidence.alias("evidence"), step.alias("next_step"),
        ))

    media = F.concat(F.regexp_replace("wp_api", "/+$", ""), F.lit("/wp/v2/media"))
    few = F.col("n_pdf") < 3
    pattern = shape_pattern(F.col("route")["v"])
    found = F.array(
        made(F.col("wp_api").isNotNull(), 0, "json_api", "wordpress", "high", 1, media, as_json(api_url=media, mode="wp_rest_media"), F.concat(F.lit("the page names the REST root "), "wp_api")),
        made(F.col("n_pdf") > 0, 1, "pdf_direct", generic, F.when(F.col("n_pdf") >= 3, "high").otherwise("medium"), F.col("n_pdf"), None, as_json(page_url=F.col("page")),
             F.concat(F.col("n_pdf").cast("string"), F.lit(" links end in .pdf, most under "), F.col("folder"))),
        made(hidden, 2, "pdf_direct", generic, "high", F.size("asked"), folder, as_json(page_url=F.col("page"), pdf_link_pattern=F.nullif(folder, F.lit(""))),
             F.concat(F.get("asked", 0), F.lit(" serves application/pdf without the extension"))),
        made(F.col("route").isNotNull() & few & ~hidden, 3, "pdf_listing", generic, "medium", F.col("route")["n"], pattern, as_json(index_url=F.col("page"), detail_link_pattern=pattern),
             F.concat(F.col("route")["n"].cast("string"), F.lit(" links share the route "), F.col("route")["v"])),
        made(F.col("word").isNotNull(), 4, "html_page", generic, F.when(F.col("word")["n"] >= 4, "medium").otherwise("low"), F.col("word")["n"], F.col("word")["v"], as_json(page_url=F.col("page"), link_pattern=F.col("word")["v"]),
             F.concat(F.col("word")["n"].cast("string"), F.lit(" links mention "), F.col("word")["v"])),
        made(is_shell(F.col("text_chars"), F.col("script_tags")), 5, "playwright_render", "spa", "medium", F.col("script_tags"), None, as_json(page_url=F.col("page")),
             F.concat(F.lit("little text ("), F.col("text_chars").cast("string"), F.lit(" characters) behind "), F.col("script_tags").cast("string"), F.lit(" scripts"))),
    )
    hints = F.create_map(*(F.lit(v) for kv in PLATFORM_HINTS.items() for v in kv))
    hint = F.coalesce(F.try_element_at(hints, F.col("platform")), F.lit("Inspect the network traffic for a JSON interface and write an adapter."))
    x = x.select("page", "platform", F.filter(found, lambda c: c.isNotNull()).alias("found"))
    known = made((F.col("platform") != "unknown") & ~F.exists("found", lambda c: c["confidence"] == "high"), 6, none, F.col("platform"), "high", 1, hint, none, F.concat(F.lit("known platform "), F.col("platform")), hint)
    x = x.select("page", F.array_sort(F.concat("found", F.filter(F.array(known), lambda c: c.isNotNull()))).alias("found"))
    x = x.select("page", F.posexplode("found").alias("at", "c"))
    return x.select("page", F.col("c.source_type"), "c.platform", "c.confidence", "c.evidence_count", "c.detail", "c.config", "c.evidence", "c.next_step", (F.col("at") + 1).alias("rank"))


def verified(ranked: DataFrame, tried: DataFrame, attempts: int = 3) -> DataFrame:
    """Candidates after a trial of the first ``attempts`` with an adapter: the first that gave useful text comes first.

    ``tried`` is ``page, source_type, text_chars``. ``verified`` is null for candidates not reached.
    """
    t = tried.groupBy("page", "source_type").agg(F.max("text_chars").alias("text_chars"))
    w = Window.partitionBy("page").orderBy("rank")
    x = ranked.join(t, ["page", "source_type"], "left").withColumn("_turn", F.when(F.col("source_type").isNotNull(), F.sum(F.col("source_type").isNotNull().cast("int")).over(w)))
    good = (F.col("_turn") <= attempts) & (F.coalesce("text_chars", F.lit(0)) >= USEFUL_CHARS)
    first = F.min(F.when(good, F.col("rank"))).over(Window.partitionBy("page"))
    x = x.withColumn("_first", first).withColumn("verified", F.when((F.col("_turn") <= attempts) & (F.col("_first").isNull() | (F.col("rank") <= F.col("_first"))), good))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy((F.col("rank") != F.coalesce("_first", F.lit(-1))).cast("int"), "rank"))).drop("_turn", "_first", "text_chars")
