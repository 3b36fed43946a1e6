"""The query catalogue of the core package: every operator over the whole tables, with SQL of the same result.

Inputs that the tables lack (dated prose, listings, file links) are derived from base columns by
the same expression on both sides; where the SQL says *generative*, it computes the answer from
the base columns instead of reading the derived text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import canonical, dates, html, jsons, truncate, urls
from sluice.operators import analysis, links, probe, runs, sniff
from sluice.operators.scale import first_rows

#: Stands for today in every query, so that results do not change with the clock.
AS_OF = dates.DateProfile(as_of_year=2026)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _fetched(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_rows(_t(spark, d, "fetched"), "fetch_id", *columns)


# ── addresses and file names ────────────────────────────────────────────


@query(r"""select distinct fetch_id, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host from fetched""")
def url_host(spark, d):
    return _fetched(spark, d, "source_url").select("fetch_id", urls.host("source_url").alias("host"))


_PATH = r"regexp_extract(source_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_SHAPE = rf"""'/' || array_to_string(list_transform(list_filter(string_split({_PATH}, '/'), lambda s: s <> ''),
    lambda s: case when regexp_matches(s, '^[0-9]+$') then '<n>' when regexp_matches(s, '^[a-zA-Z0-9]+(-[a-zA-Z0-9]+)+$') then '<slug>' else s end), '/')"""


@query(f"select distinct fetch_id, {_SHAPE} as shape from fetched")
def slug_shape(spark, d):
    return _fetched(spark, d, "source_url").select("fetch_id", urls.slug_shape(urls.path("source_url")).alias("shape"))


_ESC = r"regexp_replace({x}, '([\\.^$*+?{{}}\[\]|()\-#&~\s])', '\\\1', 'g')"


@query(
    f"""with s as (select distinct {_SHAPE} as shape from fetched),
    p as (select shape, list_filter(string_split(shape, '/'), lambda x: x <> '') as a from s),
    q as (select shape, a, coalesce(list_max(list_transform(a, lambda x, i: case when x in ('<n>', '<slug>') then i else 0 end)), 0) as last from p)
    select shape, '/' || array_to_string(list_transform(a, lambda x, i: case when x not in ('<n>', '<slug>') then {_ESC.format(x="x")}
      else (case when i = last then '(' else '(?:' end) || (case when x = '<n>' then '\\d+' else '[a-zA-Z0-9-]+' end) || ')' end), '/') as pattern from q""".replace("\\\\d", "\\d")
)
def shape_pattern(spark, d):
    shapes = _t(spark, d, "fetched").select(urls.slug_shape(urls.path("source_url")).alias("shape")).distinct()
    return shapes.select("shape", urls.shape_pattern("shape").alias("pattern"))


_SKELETON = r"'^' || replace(replace(" + _ESC.format(x=r"regexp_replace(regexp_replace(source_url, '[0-9a-fA-F]{{8,}}', chr(1), 'g'), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}}|[0-9]+', chr(2), 'g')").replace("{{", "{").replace("}}", "}") + r", chr(1), '[0-9a-fA-F]+'), chr(2), '[0-9-]+') || '$'"


@query(f"select distinct fetch_id, {_SKELETON} as skeleton from fetched")
def url_skeleton(spark, d):
    return _fetched(spark, d, "source_url").select("fetch_id", urls.url_skeleton("source_url").alias("skeleton"))


@query(
    r"""select distinct fetch_id, case when coalesce(s, '') = '' then 'document' else s end as file_name from
    (select fetch_id, substr(regexp_replace(regexp_replace(title, '(?s)[?#].*$', ''), '[^a-zA-Z0-9._-]', '_', 'g'), 1, 200) as s from fetched)"""
)
def sanitize_filename(spark, d):
    return _fetched(spark, d, "title").select("fetch_id", urls.sanitize_filename("title").alias("file_name"))


_HOSTS = ", ".join(f"'{h}'" for h, _ in urls.KNOWN_HOSTS)
_NAMES = ", ".join(f"'{n}'" for _, n in urls.KNOWN_HOSTS)


@query(f"""select c_custkey, case when c_custkey % 13 < 10 then ([{_NAMES}])[(c_custkey % 13 + 1)::int] else 'unknown' end as platform from customer""")
def platform_of_host(spark, d):
    """Hosts of known platforms by key; the SQL is generative."""
    known = F.array(*(F.lit(h) for h, _ in urls.KNOWN_HOSTS))
    k = (F.col("c_custkey") % 13).cast("int")
    host = F.when(k < 10, F.concat(F.lit("Body-"), F.col("c_custkey").cast("string"), F.lit("."), F.get(known, k))).otherwise("town.example")
    return _t(spark, d, "customer").select("c_custkey", urls.platform_of(F.concat(F.lit("https://"), host, F.lit("/meetings?x=1"))).alias("platform"))


@query(
    r"""select content_type, count(*) as n, count(*) filter (lower(source_url) like '%.pdf') as plain, count(*) filter (split_part(lower(source_url), '?', 1) like '%.pdf') as without_query
    from (select distinct fetch_id, content_type, source_url from fetched) group by content_type"""
)
def pdf_address_tests(spark, d):
    f = _fetched(spark, d, "content_type", "source_url")
    return f.groupBy("content_type").agg(F.count("*").alias("n"), F.count_if(urls.is_pdf("source_url")).alias("plain"), F.count_if(urls.is_pdf("source_url", strip_query=True)).alias("without_query"))


@query(
    rf"""with s as (select run_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') as a from (select distinct fetch_id, run_id, source_url from fetched)),
    m as (select run_id, min(a) as lo, max(a) as hi, min(len(a)) as n from s group by run_id),
    k as (select run_id, lo, coalesce(list_min(list_filter(list_transform(range(1, least(len(lo), len(hi)) + 1), lambda i: case when lo[i] = hi[i] then null else i end), lambda i: i is not null)) - 1, least(len(lo), len(hi))) as k from m)
    select run_id, case when k > 0 then '/' || array_to_string(lo[1:k], '/') || '/' else '' end as prefix from k"""
)
def common_path_prefix(spark, d):
    """Shared leading segments of the addresses of each run; SQL compares the least and the greatest only."""
    return links.common_prefix(_fetched(spark, d, "run_id", "source_url"), "run_id", "source_url")


@query()
def canonical_address(spark, d):
    """Addresses and the key under which those leading to the same place are equal."""
    return _fetched(spark, d, "source_url").select("fetch_id", canonical.canonical_url("source_url").alias("url_key"))


# ── dates ────────────────────────────────────────────────────────────────

_DAY = "cast(o_orderdate + interval 25 year as date)"


def _orders(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", F.to_date(F.expr("o_orderdate + interval 25 year")).alias("day"))


@query(r"select distinct record_id, try_cast(nullif(regexp_extract(doc_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') as date) as day from doc_records")
def date_iso_prefix(spark, d):
    r = first_rows(_t(spark, d, "doc_records"), "record_id", "doc_date")
    return r.select("record_id", dates.date_from_iso_prefix("doc_date").alias("day"))


@query(f"select o_orderkey, {_DAY} as day from orders")
def date_from_url(spark, d):
    """Three ways of writing a date in an address, by key; generative."""
    o, k = _orders(spark, d), F.col("o_orderkey") % 3
    f = lambda p: F.date_format("day", p)
    url = F.concat(F.lit("https://town.example/docs/"), F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("MM/dd/yyyy")).otherwise(f("MMMM-dd-yyyy")), F.lit("_agenda.pdf"))
    return o.select("o_orderkey", dates.date_from_url(url, AS_OF).alias("day"))


@query(f"select o_orderkey, case when o_orderkey % 7 = 6 then cast(date_trunc('month', {_DAY}) as date) else {_DAY} end as day from orders")
def date_from_text(spark, d):
    """Seven ways of writing a date in prose, by key; generative."""
    o, k = _orders(spark, d), F.col("o_orderkey") % 7
    f = lambda p: F.date_format("day", p)
    say = (
        F.when(k == 0, F.concat(F.lit("Minutes of the board.\nHeld on "), f("MMMM d, yyyy"), F.lit(" in the hall.")))
        .when(k == 1, F.concat(F.lit("Session "), f("MMM. d yyyy"), F.lit(", room 4")))
        .when(k == 2, F.concat(F.lit("Posted "), f("yyyy-M-d"), F.lit(" by the clerk")))
        .when(k == 3, F.concat(F.lit("Received "), f("M/d/yy"), F.lit(" by the clerk")))
        .when(k == 4, F.concat(F.lit("Wednesday, "), f("MMMM d"), F.lit("th\nThe board met. Copyright "), f("yyyy")))
        .when(k == 5, F.concat(F.lit("TITLE: Paper\nDATE: "), f("yyyy-MM-dd"), F.lit("\nMarch 3, 2019 is mentioned too.")))
        .otherwise(F.concat(F.lit("Budget report, "), f("MMMM yyyy")))
    )
    return o.select("o_orderkey", dates.date_from_text(say, AS_OF).alias("day"))


@query(f"select o_orderkey, case when o_orderkey % 5 = 4 and year(cast({_DAY} + interval 40 day as date)) <= 2026 then cast({_DAY} + interval 40 day as date) else {_DAY} end as day from orders")
def date_excludes_context(spark, d):
    """Dates of deadlines and coming events are passed over, with context rules off the first plausible one counts; generative."""
    o = _orders(spark, d).withColumn("other", F.date_add("day", 40))
    k, f = F.col("o_orderkey") % 5, lambda c: F.date_format(c, "MMMM d, yyyy")
    lead = F.when(k == 0, "For the fiscal year ended ").when(k == 1, "Rates are effective ").when(k == 2, "The next meeting is set for ").otherwise("Offers are due by ")
    text = F.concat(lead, f("other"), F.lit(".\nAdopted "), f("day"), F.lit(" by vote."))
    return o.select("o_orderkey", F.when(k == 4, dates.date_from_text(text, AS_OF.plain())).otherwise(dates.date_from_text(text, AS_OF)).alias("day"))


@query(f"""select o_orderkey, {_DAY} as day, ['adapter', 'title', 'url', 'text'][(o_orderkey % 4 + 1)::int] as date_source from orders""")
def date_fallback_chain(spark, d):
    """The date of the first of adapter, title, address and text that has one; generative."""
    o, k = _orders(spark, d), F.col("o_orderkey") % 4
    iso = F.date_format("day", "yyyy-MM-dd")
    day, source = dates.date_with_source(
        F.when(k == 0, F.col("day")), F.when(k <= 1, F.concat(iso, F.lit(" Regular meeting"))).otherwise("Regular meeting"),
        F.when(k <= 2, F.concat(F.lit("https://town.example/"), iso, F.lit("/a.pdf"))).otherwise("https://town.example/a.pdf"), F.concat(F.lit("Held on "), iso, F.lit(" here")), AS_OF,
    )
    return o.select("o_orderkey", day.alias("day"), source.alias("date_source"))


# ── pages and their links ───────────────────────────────────────────────

_STRIP = r"[\t\n\x0b\f\r\x1c-\x1f \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    rf"""select doc_id, md5(coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(regexp_replace(l, '^{_STRIP}+', ''), '{_STRIP}+$', '')), lambda l: l <> ''), chr(10)), '')) as text_md5
    from documents where text is not null"""
)
def html_text(spark, d):
    """Texts wrapped in a page with menu, side box and footer come out as they went in, line by line; generative."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit('<!doctype html><html><head><title>T</title><script>var p = "</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="Page-Sidebar">x<p>y</div><main><p>'),
        esc(F.col("text")), F.lit("</p></main><footer>F</footer></body></html>"),
    )
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(html.html_text(page).cast("binary")).alias("text_md5"))


@query()
def page_text(spark, d):
    """Main text of every fetched page."""
    return _fetched(spark, d, "raw_html").filter(F.length("raw_html") > 0).select("fetch_id", html.html_text("raw_html").alias("text"))


def _read(spark, d) -> DataFrame:
    return _fetched(spark, d, "raw_html").filter(F.length("raw_html") > 0).select("fetch_id", html.read_page("raw_html").alias("read"))


_LINKS = r"""pages as (select distinct fetch_id, regexp_replace(raw_html, '(?is)<(script|style|noscript)\b[^<>]*>.*?</(script|style|noscript)\s*>|<!--.*?-->', '', 'g') as h from fetched where length(raw_html) > 0),
    hits as (select fetch_id, unnest(x) as raw, generate_subscripts(x, 1) as k from (select fetch_id, regexp_extract_all(h, '(?is)<a\b[^<>]*?href="([^"]*)"', 1) as x from pages)),
    found as (select fetch_id, raw, (row_number() over (partition by fetch_id order by min(k)) - 1)::int as pos from hits group by fetch_id, raw)"""


@query(
    rf"""with {_LINKS}, n as (select fetch_id, count(*) as n from found group by fetch_id)
    select distinct f.fetch_id, length(raw_html) as html_chars, len(regexp_extract_all(raw_html, '(?i)<script\b'))::int as script_tags, coalesce(n, 0)::int as n_links,
      contains(raw_html, '/wp-content/') or contains(raw_html, 'api.w.org') as wordpress from fetched f left join n on f.fetch_id = n.fetch_id where length(raw_html) > 0"""
)
def page_stats(spark, d):
    return _read(spark, d).select("fetch_id", "read.html_chars", "read.script_tags", F.size("read.links").alias("n_links"), F.col("read.wp_api").isNotNull().alias("wordpress"))


@query(f"with {_LINKS} select fetch_id, pos, raw, case when starts_with(raw, '/') and not starts_with(raw, '//') then 'https://h.example' || raw end as absolute from found")
def page_links(spark, d):
    """Links as written, and as absolute addresses where they are written from the root."""
    pages = _fetched(spark, d, "raw_html").filter(F.length("raw_html") > 0).select("fetch_id", html.read_page("raw_html", F.lit("https://h.example/a/b")).alias("read"))
    x = pages.select("fetch_id", F.explode("read.links").alias("l")).select("fetch_id", "l.pos", "l.raw", "l.href")
    return x.select("fetch_id", "pos", "raw", F.when(F.col("raw").startswith("/") & ~F.col("raw").startswith("//"), F.col("href")).alias("absolute"))


# Links with files, numbered details and minutes among them, derived from the pages' own.
_DERIVED = _LINKS + r""",
    named as (select fetch_id, pos, substr(raw, 2) as r from found),
    made as (select fetch_id, pos, r, case pos % 4 when 0 then '/files/y' || (pos % 3) || '/' || r || '.pdf' when 1 then '/details/' || (fetch_id * 100 + pos) when 2 then '/news/annual-' || r || '-minutes' else '/' || r end as raw from named),
    links as (select 'https://h' || (fetch_id % 7) || '.example/i' || fetch_id as page, pos, raw, 'https://h' || (fetch_id % 7) || '.example' || raw as href, case when pos % 5 = 0 then 'Agenda ' || r else r end as label from made)"""


def _derived(spark, d) -> DataFrame:
    x = _read(spark, d).select("fetch_id", F.explode("read.links").alias("l")).select("fetch_id", "l.pos", F.expr("substring(l.raw, 2)").alias("r"))
    raw = F.expr(
        """case pos % 4 when 0 then '/files/y' || cast(pos % 3 as string) || '/' || r || '.pdf' when 1 then '/details/' || cast(fetch_id * 100 + pos as string)
        when 2 then '/news/annual-' || r || '-minutes' else '/' || r end"""
    )
    site = F.expr("'https://h' || cast(fetch_id % 7 as string) || '.example'")
    x = x.withColumn("raw", raw)
    return x.select(F.concat(site, F.lit("/i"), F.col("fetch_id").cast("string")).alias("page"), "pos", "raw", F.concat(site, "raw").alias("href"), F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Agenda "), "r")).otherwise(F.col("r")).alias("label"))


def _ranked(where: str, order: str = "pos", limit: int = 3, columns: str = "page, href, label") -> str:
    once = f"select *, row_number() over (partition by page, href order by pos) as n from links where {where}"
    return f"with {_DERIVED}, once as ({once}), ranked as (select *, row_number() over (partition by page order by {order}) as rank from once where n = 1) select {columns}, rank::int as rank from ranked where rank <= {limit}"


@query(_ranked("href like '%.pdf' and href not like '%/y2/%'"))
def links_pdf(spark, d):
    return links.pdf_links(_derived(spark, d), exclude="/y2/").select("page", "href", "label", "rank")


@query(_ranked("(lower(href) like '%minutes%' or lower(label) like '%minutes%') and not regexp_matches(lower(href), '\\.(pdf|doc|docx)$')"))
def links_document_pages(spark, d):
    return links.document_pages(_derived(spark, d)).select("page", "href", "label", "rank")


@query(
    f"""with {_DERIVED}, once as (select *, row_number() over (partition by page, href order by pos) as n from links where lower(label) like '%agenda lo%' and href not like '%.pdf'),
    ranked as (select *, row_number() over (partition by page order by pos) as rank from once where n = 1)
    select page, href, label, rank::int as rank from ranked where rank <= 3 union all
    select distinct page, page, null, 1 from links where page not in (select page from ranked)"""
)
def links_or_index(spark, d):
    """Pages without a matching link stand for themselves."""
    x = _derived(spark, d)
    return links.document_pages_or_index(x.select("page"), x, "agenda lo")


@query(_ranked("regexp_matches(raw, '/details/(\\d+)')", "-cast(regexp_extract(raw, '/details/(\\d+)', 1) as bigint)"))
def links_listing(spark, d):
    """Numbered detail pages, newest first."""
    return links.listing(_derived(spark, d), r"/details/(\d+)").select("page", "href", "label", "rank")


@query(
    f"""with l as ({_SQL["links_listing"]}) select page, rank, href, href || '/' || case when length(href) % 2 = 0 then 'minutes' else 'b' end || '.pdf' as file, 'Minutes' as label from l where length(href) % 3 <> 0"""
)
def links_detail_files(spark, d):
    """Of each listed detail page its first file that mentions minutes, by a join of the index with the details; generative."""
    x = _derived(spark, d)
    file = F.concat(F.lit("/"), F.when(F.length("href") % 2 == 0, "minutes").otherwise("b"), F.lit(".pdf"))
    own = x.filter(F.col("raw").rlike("^/details/")).select(F.col("href").alias("page"), F.posexplode(F.array(
        F.struct(F.lit("notes.html").alias("raw"), F.lit("Minutes").alias("label")), F.struct(F.lit("/agenda.pdf").alias("raw"), F.lit("Agenda").alias("label")),
        F.struct(F.when(F.length("href") % 3 == 0, "/other.pdf").otherwise(file).alias("raw"), F.when(F.length("href") % 3 == 0, "Other").otherwise("Minutes").alias("label")),
    )).alias("pos", "l")).select("page", "pos", "l.raw", F.concat("page", "l.raw").alias("href"), "l.label")
    return links.detail_files(links.listing(x, r"/details/(\d+)"), own, "minutes")


@query(_ranked("regexp_matches(raw, '/(?:details/(\\d+)|news/)')"))
def links_listing_unnumbered(spark, d):
    """Where not every link has a number, page order stays."""
    return links.listing(_derived(spark, d), r"/(?:details/(\d+)|news/)").select("page", "href", "label", "rank")


@query(_ranked("raw like '%.pdf' and (lower(raw) like '%agenda%' or lower(label) like '%agenda%')", limit=1))
def links_first_pdf(spark, d):
    return links.first_pdf(_derived(spark, d), "agenda").select("page", "href", "label", "rank")


@query(_ranked("regexp_matches(lower(href), '\\.pdf(\\?|$)') and lower(href) like '%y1%'"))
def links_rendered(spark, d):
    return links.rendered_pdf_links(_derived(spark, d), url_keyword="y1").select("page", "href", "label", "rank")


@query(_ranked("href like '%/news/%' and (lower(href) like '%minutes%' or lower(label) like '%minutes%')", limit=2))
def links_hosted(spark, d):
    return links.hosted_links(_derived(spark, d), "/news/", "minutes", 2).select("page", "href", "label", "rank")


_ROUTE = _DERIVED + rf""",
    shaped as (select page, pos, href, {_SHAPE.replace('source_url', 'href')} as shape from links),
    groups as (select page, shape, count(*) as n, min(pos) as first_pos, array_to_string(list(href order by pos), ' ') as hrefs from shaped where shape like '%<n>%' or shape like '%<slug>%' group by page, shape)"""


@query(f"with {_ROUTE} select page, shape, n, first_pos, hrefs from groups")
def route_groups(spark, d):
    return links.route_shapes(_derived(spark, d)).select("page", "shape", "n", "first_pos", F.array_join("hrefs", " ").alias("hrefs"))


@query(f"with {_ROUTE} select page, shape, n from (select *, row_number() over (partition by page order by n desc, first_pos) as r from groups) where r = 1 and n >= 3")
def top_route(spark, d):
    return links.top_route(_derived(spark, d))


@query(
    f"""with {_DERIVED}, g as (select page, regexp_extract(href, '^(.*)/[^/]*$', 1) as folder, count(*) as n, min(pos) as p from links where href like '%.pdf' group by 1, 2)
    select page, folder, n from (select *, row_number() over (partition by page order by n desc, p) as r from g) where r = 1"""
)
def top_folder(spark, d):
    return links.top_folder(_derived(spark, d))


_DOC_WORDS = "[" + ", ".join(f"'{w}'" for w in links.DOC_WORDS) + "]"


@query(
    f"""with {_DERIVED}, w as (select page, pos, list_filter({_DOC_WORDS}, lambda w: contains(lower(href || ' ' || label), w))[1] as word from links where href not like '%.pdf'),
    g as (select page, word, count(*) as n, min(pos) as p from w where word is not null group by page, word)
    select page, word, n from (select *, row_number() over (partition by page order by n desc, p) as r from g) where r = 1 and n >= 2"""
)
def keyword_histogram(spark, d):
    return links.top_word(_derived(spark, d))


# ── probe ────────────────────────────────────────────────────────────────


@query(
    f"""with {_ROUTE},
    p as (select page, sum(case when href like '%.pdf' then 1 else 0 end)::bigint as n_pdf, max(pos) as m, count(*) as k from links group by page),
    routes as (select page, n from (select *, row_number() over (partition by page order by n desc, first_pos) as r from groups) where r = 1 and n >= 3),
    w as (select page, pos, list_filter({_DOC_WORDS}, lambda w: contains(lower(href || ' ' || label), w))[1] as word from links where href not like '%.pdf'),
    ww as (select page, n from (select page, n, row_number() over (partition by page order by n desc, p) as r from (select page, word, count(*) as n, min(pos) as p from w where word is not null group by page, word)) where r = 1 and n >= 2),
    c as (
      select page, 0 as made, 'json_api' as source_type, 'high' as confidence, 1::bigint as evidence_count from p where k % 5 = 0 union all
      select page, 1, 'pdf_direct', case when n_pdf >= 3 then 'high' else 'medium' end, n_pdf from p where n_pdf > 0 union all
      select page, 3, 'pdf_listing', 'medium', n from routes join p using (page) where n_pdf < 3 union all
      select page, 4, 'html_page', case when n >= 4 then 'medium' else 'low' end, n from ww union all
      select page, 5, 'playwright_render', 'medium', k % 11 from p where k * 40 < 600 and k % 11 >= 5)
    select page, source_type, confidence, evidence_count, row_number() over (partition by page order by case confidence when 'high' then 0 when 'medium' then 1 else 2 end, made)::int as rank from c"""
)
def probe_candidates(spark, d):
    """Ranked adapter candidates of pages with derived links and statistics."""
    return probe.candidates(_probed(spark, d)).select("page", "source_type", "confidence", "evidence_count", "rank")


def _probed(spark, d) -> DataFrame:
    x = _derived(spark, d)
    p = x.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "href", "label"))).alias("links"), F.count("*").alias("k"))
    wp = F.when(F.col("k") % 5 == 0, F.concat("page", F.lit("/wp-json/")))
    return p.select("page", F.struct("links", (F.col("k") * 40).alias("text_chars"), (F.col("k") % 11).cast("int").alias("script_tags"), wp.alias("wp_api")).alias("read"))


@query()
def probe_verified(spark, d):
    """Candidates after trying the first three: the first with useful text leads."""
    ranked = probe.candidates(_probed(spark, d))
    tried = ranked.select("page", "source_type", ((F.length("page") * 37 + F.length("source_type") * 101) % 1000).alias("text_chars"))
    return probe.verified(ranked, tried).select("page", "source_type", "rank", "verified")


_SQL["probe_verified"] = f"""with ranked as ({_SQL["probe_candidates"]}),
    t as (select *, (length(page) * 37 + length(source_type) * 101) % 1000 >= 500 as good from ranked),
    f as (select page, min(rank) as first from t where rank <= 3 and good group by page)
    select page, source_type, row_number() over (partition by page order by (rank <> coalesce(first, -1))::int, rank)::int as rank, case when rank <= 3 and (first is null or rank <= first) then good end as verified
    from t left join f using (page)"""


_STATUS = "case event_id % 9 when 0 then 401 when 1 then 403 when 2 then 404 when 3 then 429 when 4 then 500 when 5 then 503 when 6 then 406 else null end"


@query(
    f"""with e as (select event_id, {_STATUS} as s, case event_id % 9 when 7 then 'timeout after 30s' when 8 then (case when event_id % 2 = 0 then 'connection failed' else 'bad address' end) else null end as err from events),
    b as (select *, coalesce(s in (401, 403, 406, 429, 503), false) as refused, coalesce(contains(err, 'timeout') or contains(err, 'connection failed'), false) as silent from e)
    select event_id, case when refused or silent then 'blocked' else 'unreachable' end as platform, case when refused or silent then 'cloud_render' end as source_type,
      case when refused then 'medium' when silent then 'low' end as confidence, silent and not refused as proxy from b"""
)
def unreachable_decision(spark, d):
    e = _t(spark, d, "events").select("event_id", F.expr(_STATUS).alias("s"), F.expr("case event_id % 9 when 7 then 'timeout after 30s' when 8 then (case when event_id % 2 = 0 then 'connection failed' else 'bad address' end) else null end").alias("err"))
    return e.select("event_id", probe.unreachable(F.col("s"), F.col("err")).alias("u")).select("event_id", "u.*")


_REASONS = ["waf", "ip_blocked", "captcha", "login_required", "paywall", "no_public_archive", "other"]


@query(
    "select n_nationkey, case n_nationkey % 7 "
    + " ".join(f"when {i} then '{probe.NEXT_STEPS.get(r, 'No known way through. Revisit if the site changes.')}'" for i, r in enumerate(_REASONS))
    + " end as next_step from nation"
)
def blocked_next_step(spark, d):
    reason = F.get(F.array(*map(F.lit, _REASONS)), (F.col("n_nationkey") % 7).cast("int"))
    return _t(spark, d, "nation").select("n_nationkey", probe.next_step_for(reason).alias("next_step"))


# ── runs, memory, recipes ───────────────────────────────────────────────

_RUNS = """runs as (select run_id, min(lower(trim(source_id))) as source_id, min(status) as status, min(error) as error, min(started_at) as started_at, min(batch_no) as batch_no from (select distinct * from run_journal) group by run_id)"""
_RECORDS = "records as (select distinct record_id, run_id, text_chars from doc_records)"


def _runs(spark, d) -> DataFrame:
    """Each run once, with a clean source."""
    r = _t(spark, d, "run_journal").withColumn("source_id", F.lower(F.trim("source_id")))
    return r.groupBy("run_id").agg(*(F.min(c).alias(c) for c in ("source_id", "status", "error", "started_at", "batch_no")))


@query(
    f"""with {_RUNS}, {_RECORDS}, k as (select run_id, count(*) as n, count(*) filter (coalesce(text_chars, 0) >= 500) as u from records group by run_id)
    select runs.run_id, coalesce(n, 0) as n_documents, coalesce(u, 0) as n_usable, case when error is not null then 'error' when n is null then 'empty' when n = u then 'ok' else 'partial' end as status
    from runs left join k using (run_id)"""
)
def run_statuses(spark, d):
    records = first_rows(_t(spark, d, "doc_records"), "record_id", "run_id", "text_chars")
    return runs.statuses(_runs(spark, d), records)


@query(f"with {_RUNS} select source_id, status, count(*) as n_runs from runs group by source_id, status")
def run_status_by_source(spark, d):
    return _runs(spark, d).groupBy("source_id", "status").agg(F.count("*").alias("n_runs"))


@query(f"with {_RUNS} select status, count(*) as n_runs from runs group by status")
def run_summary(spark, d):
    return runs.summary(_runs(spark, d))


@query(
    f"""with {_RUNS} select count(*) as n_runs, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'ok') = count(*) as all_clean,
    case when count(*) filter (status = 'ok') = count(*) then 0 else 2 end as exit_code from runs"""
)
def all_clean(spark, d):
    return runs.all_clean(_runs(spark, d))


_FOLD = (
    _RUNS
    + """,
    i as (select *, (status = 'ok')::int as ok, case when run_id % 4 <> 0 then '^https://h' || (run_id % 3) || '/[0-9]+$' end as pattern, sum((status = 'ok')::int) over (partition by source_id order by started_at nulls first, run_id rows unbounded preceding) as island,
      row_number() over (partition by source_id order by started_at desc nulls last, run_id desc) as back from runs where source_id is not null),
    m as (select source_id, max(island) as top from i group by source_id),
    f as (select i.source_id, sum(ok)::bigint as success_count, sum(1 - ok)::bigint as failure_count, (count(*) filter (island = top and ok = 0)) as consecutive_failures,
      max(status) filter (back = 1) as last_status, max(started_at) filter (island = top and ok = 1) as last_ok_at, max(started_at) filter (back = 1) as last_run_at,
      max(case when ok = 0 then error end) filter (back = 1) as last_error, arg_min(pattern, back) filter (ok = 1 and pattern is not null) as doc_url_pattern,
      coalesce(max(case when ok = 1 then pattern end) filter (back = 1) <> arg_min(pattern, back) filter (back > 1 and ok = 1 and pattern is not null), false) as shape_changed from i join m using (source_id) group by i.source_id)"""
)


def _patterned(spark, d) -> DataFrame:
    """Runs with a source, each with the pattern that its addresses agree on, if they do."""
    pattern = F.when(F.col("run_id") % 4 != 0, F.concat(F.lit("^https://h"), (F.col("run_id") % 3).cast("string"), F.lit("/[0-9]+$")))
    return _runs(spark, d).filter("source_id is not null").withColumn("pattern", pattern)


@query(
    f"""with {_FOLD} select f.* exclude (shape_changed), consecutive_failures >= 3 as quarantined,
      case when consecutive_failures >= 3 then case when success_count = 0 then consecutive_failures || ' runs, never succeeded'
        else consecutive_failures || ' consecutive failures since ' || strftime(last_ok_at, '%Y-%m-%dT%H:%M:%S') end end as quarantine_reason from f"""
)
def memory_fold(spark, d):
    return runs.fold_memory(_patterned(spark, d), pattern="pattern")


@query(f"with {_FOLD} select *, consecutive_failures >= 3 as quarantined from f")
def memory_fold_stream(spark, d):
    """The same fold as a stateful stream over the journal, drained once."""
    from sluice.operators.scale import scratch_path
    from sluice.streaming.memory import memory_stream, use_rocksdb

    base = scratch_path(spark)
    r = _patterned(spark, d)
    r.write.parquet(f"{base}/runs")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    use_rocksdb(spark)
    try:
        stream = memory_stream(spark.readStream.schema(r.schema).parquet(f"{base}/runs"))
        # One drain gives every source's memory once; later ones would replace rows by source.
        write = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{base}/memory")).outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
        write.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.parquet(f"{base}/memory")


@query(
    f"""with {_RUNS}, i as (select *, sum((status = 'ok')::int) over (partition by source_id order by started_at nulls first, run_id rows unbounded preceding) as island,
      lag(status) over (partition by source_id order by started_at nulls first, run_id) as previous_status from runs)
    select run_id, previous_status, (sum((status <> 'ok')::int) over (partition by source_id, island order by started_at nulls first, run_id rows unbounded preceding))::bigint as failures_in_a_row from i"""
)
def run_streaks(spark, d):
    return runs.streaks(_runs(spark, d)).select("run_id", "previous_status", "failures_in_a_row")


@query(
    f"""with u as (select distinct fetch_id, run_id, source_url from fetched where content_type = 'pdf'), s as (select run_id, {_SKELETON} as k from u)
    select run_id, min(k) as pattern from s group by run_id having count(*) >= 2 and min(k) = max(k)"""
)
def learned_patterns(spark, d):
    u = _fetched(spark, d, "run_id", "source_url", "content_type").filter("content_type = 'pdf'")
    return runs.learned_pattern(u, "run_id", "source_url")


@query(
    f"""with u as (select distinct fetch_id, run_id, source_url, content_type from fetched), s as (select run_id, {_SKELETON} as k from u where content_type = 'pdf'),
    p as (select run_id, min(k) as pattern from s group by run_id having count(*) >= 2 and min(k) = max(k))
    select run_id, coalesce(bool_and(coalesce(regexp_matches(source_url, pattern), true)), true) as keeps from u left join p using (run_id) group by run_id"""
)
def shape_kept(spark, d):
    """Whether all addresses of a run match the pattern its files agree on."""
    u = _fetched(spark, d, "run_id", "source_url", "content_type")
    return runs.keeps_shape(u, runs.learned_pattern(u.filter("content_type = 'pdf'"), "run_id", "source_url"), "run_id", "source_url")


@query(
    f"""with {_FOLD}, q as (select source_id, consecutive_failures >= 3 as quarantined from f)
    select r.source_id, coalesce(enabled, false) and not coalesce(quarantined, false) as runs, case when not coalesce(enabled, false) then 'disabled' when quarantined then 'quarantined' end as skipped_because
    from recipes r left join q using (source_id)"""
)
def recipe_selection(spark, d):
    picked = runs.select_recipes(_t(spark, d, "recipes"), runs.fold_memory(_runs(spark, d).filter("source_id is not null")))
    return picked.withColumn("skipped_because", F.split_part("skipped_because", F.lit(":"), F.lit(1)))


@query(
    """with book as (select c_custkey, c_name, c_mktsegment from customer where c_custkey % 3 <> 0), new as (select c_custkey, upper(c_name) as c_name, case when c_custkey % 2 = 0 then c_mktsegment end as c_mktsegment from customer where c_custkey % 5 < 2)
    select coalesce(b.c_custkey, n.c_custkey) as c_custkey, case when n.c_custkey is null then b.c_name else n.c_name end as c_name,
      case when n.c_custkey is null then b.c_mktsegment else coalesce(n.c_mktsegment, b.c_mktsegment) end as c_mktsegment,
      case when n.c_custkey is null then 'kept' when b.c_custkey is null then 'added' else 'updated' end as change from book b full join new n on b.c_custkey = n.c_custkey"""
)
def recipe_upsert(spark, d):
    """Adding and replacing by id; the column that stands for memory survives where the new one has none."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 5 < 2").select("c_custkey", F.upper("c_name").alias("c_name"), F.expr("case when c_custkey % 2 = 0 then c_mktsegment end").alias("c_mktsegment"))
    return runs.upsert_recipes(c.filter("c_custkey % 3 != 0"), new, "c_custkey", memory="c_mktsegment")


# ── truncation ───────────────────────────────────────────────────────────

_SMALL = truncate.GENERIC.sized(head_chars=300, tail_chars=100, window=120, tail_least=200)


@query(
    """with d as (select doc_id, text, length(text) as n from documents where text is not null),
    r as (select doc_id, n, case when n <= 600 then text else substr(text, 1, 300)
      || case when n > 400 then chr(10) || chr(10) || chr(10) || substr(text, 301, least(194, n - 400)) else '' end || chr(10) || chr(10) || chr(10) || substr(text, n - 99) end as t from d)
    select doc_id, md5(t) as text_md5, n as original_chars, length(t) as final_chars, case when n <= 600 then 'no_op' else 'head_windows_tail' end as method from r"""
)
def truncate_generic(spark, d):
    """Head, middle and tail of texts over a budget of 600."""
    x = _t(spark, d, "documents").filter("text is not null").select("doc_id", truncate.truncate("text", 600, _SMALL).alias("t"))
    return x.select("doc_id", F.md5(F.col("t.text").cast("binary")).alias("text_md5"), "t.original_chars", "t.final_chars", "t.method")


@query(
    """with d as (select doc_id, text, length(text) as n from documents where text is not null)
    select doc_id, md5(case when tail then text else whole end) as text_md5, case when tail then n end as tail_dropped_at, case when tail then 'trimmed_safe_tail' else 'no_op' end as method
    from (select *, text || 'BOARD POLICY MANUAL' || repeat('x', 381) as whole, n >= floor((n + 400) * 0.4) and not regexp_matches(text, '[\\p{L}\\p{N}_]$') and n > 0 as tail from d)""".replace("\\\\", "\\")
)
def truncate_tail(spark, d):
    """A closing marker with filler behind every text is cut, if far enough in; generative."""
    x = _t(spark, d, "documents").filter("text is not null")
    whole = F.concat("text", F.lit("BOARD POLICY MANUAL" + "x" * 381))
    t = truncate.truncate(whole, 10**9, _SMALL.sized(safe=(r"\bBOARD POLICY MANUAL",)))
    return x.select("doc_id", t.alias("t")).select("doc_id", F.md5(F.col("t.text").cast("binary")).alias("text_md5"), "t.tail_dropped_at", "t.method")


@query(
    r"""with d as (select doc_id, text, length(text) as n from documents where length(text) > 600),
    s as (select doc_id, n, text, string_split_regex(text, '(?i)committee') as parts, regexp_extract_all(text, '(?i)committee') as hits from d),
    o as (select doc_id, n, text, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + 9 * (i - 1)))::bigint as o from s where len(hits) > 0),
    w as (select doc_id, n, text, o, greatest(0, o - 120) as a, least(n, o + 120) as b from o),
    g as (select *, case when a <= max(b) over (partition by doc_id order by o rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from w),
    h as (select *, sum(new) over (partition by doc_id order by o rows unbounded preceding) as island from g),
    m as (select doc_id, island, min(a) as a, max(b) as b, any_value(text) as text from h group by doc_id, island),
    j as (select doc_id, count(*)::int as windows_count, string_agg(substr(text, a + 1, b - a), chr(10) || chr(10) || chr(10) order by a) as t from m group by doc_id)
    select doc_id, windows_count, case when length(t) <= 600 then 'trimmed_tail+windows' else 'head_windows_tail' end as method, case when length(t) <= 600 then md5(t) end as text_md5 from j"""
)
def truncate_windows(spark, d):
    """Context around every mention of a word, touching windows merged."""
    p = _SMALL.sized(name="word", keep=("(?i)committee",))
    x = _t(spark, d, "documents").filter(F.length("text") > 600).select("doc_id", truncate.truncate("text", 600, p).alias("t")).filter("t.windows_count is not null")
    fits = F.col("t.method") == "trimmed_tail+windows"
    return x.select("doc_id", "t.windows_count", "t.method", F.when(fits, F.md5(F.col("t.text").cast("binary"))).alias("text_md5"))


@query("select case when length(text) <= 2000 then 'no_op' else 'head_windows_tail' end as method, count(*) as n, sum(length(text))::bigint as original_chars from documents where text is not null group by 1")
def truncate_method_counts(spark, d):
    x = _t(spark, d, "documents").filter("text is not null").select(truncate.truncate("text", 2000, truncate.GENERIC, only_over=True).alias("t"))
    return x.groupBy(F.col("t.method").alias("method")).agg(F.count("*").alias("n"), F.sum("t.original_chars").alias("original_chars"))


@query("select doc_id, md5(substr(text, 1, 2000)) as preview_md5, length(text) > 2000 as is_cut from documents where text is not null")
def preview_flag(spark, d):
    x = _t(spark, d, "documents").filter("text is not null")
    return x.select("doc_id", F.md5(F.substring("text", 1, 2000).cast("binary")).alias("preview_md5"), (F.length("text") > 2000).alias("is_cut"))


# ── JSON listings and network calls ─────────────────────────────────────


@query("select event_id, json_extract_string(props, '$.k') as k, null::varchar as missing from events")
def json_dig(spark, d):
    return _t(spark, d, "events").select("event_id", jsons.dig("props", "k").alias("k"), jsons.dig("props", "k.deeper").alias("missing"))


def _listing(spark, d) -> DataFrame:
    """A JSON listing of each user's events, in order."""
    item = F.expr("'{\"id\":' || cast(event_id as string) || ',\"category\":{\"key\":\"' || event_type || '\"},\"date\":\"' || date_format(ts, 'yyyy-MM-dd') || 'T10:00:00\",\"subject\":\"S' || cast(event_id as string) || '\"}'")
    e = _t(spark, d, "events").select("user_id", "event_id", item.alias("item"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]), ",")
    return e.groupBy("user_id").agg(F.concat(F.lit('{"total":3,"items":['), items, F.lit("]}")).alias("payload")).withColumn("api_url", F.concat(F.lit("https://api.example/u"), F.col("user_id").cast("string")))


@query(
    """with c as (select user_id, event_id, ts, row_number() over (partition by user_id order by event_id) as rank from events where event_type = 'click')
    select 'https://api.example/u' || user_id as api_url, rank::int as rank, 'https://api.example/u' || user_id || '/' || event_id as source_url, cast(ts as date) as doc_date,
      '<html><body><pre>SUBJECT: S' || event_id || chr(10) || 'PLACE: </pre></body></html>' as raw_html from c where rank <= 3"""
)
def json_metadata_items(spark, d):
    """Filtered items of listings as documents; generative."""
    return sniff.metadata_items(_listing(spark, d), "api_url", fields=[("SUBJECT", "subject"), ("PLACE", "location")], filter_value="click")


@query(
    """with c as (select user_id, event_id, ts, row_number() over (partition by user_id order by event_id) as rank from events where event_type = 'view')
    select 'https://api.example/u' || user_id as api_url, rank::int as rank, 'https://f.example/' || event_id || '.PDF' as source_url, cast(ts as date) as doc_date from c where rank <= 3"""
)
def json_media_items(spark, d):
    """Files of media listings, other files passed over before the limit; generative."""
    item = F.expr("'{\"source_url\":\"https://f.example/' || cast(event_id as string) || case event_type when 'view' then '.PDF' else '.jpg' end || '\",\"date\":\"' || date_format(ts, 'yyyy-MM-dd') || '\"}'")
    e = _t(spark, d, "events").select("user_id", "event_id", item.alias("item"))
    p = e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]), ","), F.lit("]")).alias("payload"))
    return sniff.media_items(p.withColumn("api_url", F.concat(F.lit("https://api.example/u"), F.col("user_id").cast("string"))), "api_url")


_BODY = """case event_id % 6 when 0 then '[{"b":1,"a":' || event_id || '},{"a":2},{"a":3}]' when 1 then '{"z":[1],"total":9,"list":[{"k":1,"c":2},{"k":2}]}' when 2 then '{"b":1,"a":[]}'
    when 3 then '"text"' when 4 then '[]' else 'no json' end"""


@query(
    """select event_id, case event_id % 6 when 0 then 'array' when 1 then 'object with ''list'' array' when 2 then 'object' when 3 then 'str' when 4 then 'array' end as shape,
    case event_id % 6 when 0 then 3 when 1 then 2 when 2 then 0 when 3 then 0 when 4 then 0 end as item_count,
    case event_id % 6 when 0 then 'a,b' when 1 then 'c,k' when 2 then 'a,b' when 3 then '' when 4 then '' end as item_keys, case when event_id % 6 < 5 then event_id % 6 < 2 end as is_listing from events"""
)
def json_shape(spark, d):
    """How payloads list their items; generative."""
    x = _t(spark, d, "events").select("event_id", jsons.describe_json(F.expr(_BODY.replace("|| event_id ||", "|| cast(event_id as string) ||"))).alias("d"))
    return x.select("event_id", "d.shape", "d.item_count", F.array_join("d.item_keys", ",").alias("item_keys"), "d.is_listing")


def _calls(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(
        F.col("user_id").alias("page"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("https://api.example/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, ".PNG?x=1").otherwise("?page=1")).alias("url"),
        F.when(F.col("event_id") % 2 == 0, "application/JSON").otherwise("text/plain").alias("content_type"), F.expr(_BODY.replace("|| event_id ||", "|| cast(event_id as string) ||")).alias("body"),
    )


_CALLS = """calls as (select user_id as page, event_id as pos, event_type, event_id % 6 as k from events where event_id % 7 <> 0 and (event_id % 2 = 0 or event_id % 6 in (0, 1, 2, 4))),
    ranked as (select *, k < 2 as is_listing, case k when 0 then 3 when 1 then 2 else 0 end as item_count,
      row_number() over (partition by page order by k < 2 desc, case k when 0 then 3 when 1 then 2 else 0 end desc, pos) as rank from calls)"""


@query(f"with {_CALLS} select page, pos, is_listing, item_count, rank::int as rank from ranked")
def sniff_rank(spark, d):
    """JSON calls of a page, listings first; generative."""
    return sniff.rank_calls(_calls(spark, d)).select("page", "pos", "is_listing", "item_count", "rank")


@query(
    f"""with {_CALLS}, t as (select page, count(*) as n_calls, any_value(pos) filter (rank = 1) as pos, any_value(k) filter (rank = 1) as k, any_value(event_type) filter (rank = 1) as e from ranked group by page)
    select page, n_calls, case when k < 2 then 'https://api.example/' || pos end as api_url, case when k < 2 then '?page=1' end as query, case when k = 1 then 'list' end as items_key,
      case when k >= 2 and n_calls <= 2 then 'almost no requests: the page may have served a stub' when k >= 2 then 'calls were seen but none returned a list' when e = 'purchase' then 'the listing call is a POST' end as note from t"""
)
def sniff_suggest(spark, d):
    return sniff.suggest(sniff.rank_calls(_calls(spark, d)))


@query("""select event_id, case when event_id % 3 = 2 then 'plain ' || event_id else '{"a": ' || event_id || '}' end as answer from events""")
def fence_strip(spark, d):
    """Answers in and without code fences; generative."""
    k, body = F.col("event_id") % 3, F.expr("'{\"a\": ' || cast(event_id as string) || '}'")
    raw = F.when(k == 0, F.concat(F.lit("  ```json\n"), body, F.lit("\n```\n"))).when(k == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.expr("' plain ' || cast(event_id as string)"))
    return _t(spark, d, "events").select("event_id", jsons.strip_fence(raw).alias("answer"))


@query("select distinct record_id, " + " or ".join(f"contains(lower(coalesce(error, '')), '{p}')" for p in sniff.TRANSIENT) + " as transient from doc_records")
def transient_error(spark, d):
    r = first_rows(_t(spark, d, "doc_records"), "record_id", "error")
    return r.select("record_id", sniff.is_transient(F.col("error")).alias("transient"))


@query(
    """with d as (select doc_id, coalesce(n_chars, 0) as n from documents)
    select case when doc_id % 3 = 0 and n >= 100 then 'pdfplumber' when doc_id % 3 <= 1 and n >= 100 then 'pypdf' when n > 0 then 'ocr' else 'none' end as method, count(*) as n from d group by 1"""
)
def pdf_reader_choice(spark, d):
    """Which reader's text wins, of texts given to readers by key; generative."""
    k, t = F.col("doc_id") % 3, F.col("text")
    choice = analysis.choose_reader(F.when(k == 0, t), F.when(k <= 1, t), t)
    return _t(spark, d, "documents").select(choice.alias("c")).groupBy(F.col("c.method").alias("method")).agg(F.count("*").alias("n"))


@query(
    """with d as (select doc_id, text, doc_id % 4 as k from documents)
    select doc_id, coalesce(ok and k <> 3, false) as ok, case when ok then case when k = 1 then 'second' else 'first' end end as model, coalesce(ok and k = 1, false) as used_fallback,
      case when not ok then 'nothing to analyze: the text is empty' when k = 3 then 'ValueError: bad request' end as error
    from (select *, coalesce(regexp_matches(text, '[^\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b\\x1c-\\x1f]'), false) as ok from d)""".replace("\\\\", "\\")
)
def analysis_outcomes(spark, d):
    """Answers of a plugged-in model that is busy, refuses or answers by key; generative."""

    def call(text: str, prompt: str, schema, model: str) -> str:
        k = int(text.split("|", 1)[0])
        if k == 1 and model == "first":
            raise RuntimeError("529 overloaded")
        if k == 3:
            raise ValueError("bad request")
        return '{"ok": 1}'

    docs = _t(spark, d, "documents").select("doc_id", F.when(F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " ")) != "", F.concat((F.col("doc_id") % 4).cast("string"), F.lit("|"), "text")).otherwise(F.lit("")).alias("text"))
    out = analysis.analyse(docs, "text", "What is it?", call, ("first", "second"))
    return out.select("doc_id", "analysis.ok", "analysis.model", "analysis.used_fallback", "analysis.error")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Status of every source's harvest, from the pages themselves: pages, usable texts, links, and how its runs went."""
    pages = _fetched(spark, d, "run_id", "raw_html").filter(F.length("raw_html") > 0)
    read = pages.select("run_id", html.read_page("raw_html").alias("read")).select("run_id", F.col("read.text_chars").alias("text_chars"), F.size("read.links").alias("n_links"))
    by_run = read.groupBy("run_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("text_chars") >= runs.USEFUL_CHARS).alias("n_usable"), F.sum("text_chars").alias("text_chars"), F.sum("n_links").alias("n_links"))
    r = _runs(spark, d).filter("source_id is not null").join(by_run, "run_id", "left")
    return r.groupBy("source_id").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.sum(F.coalesce("n_pages", F.lit(0))).alias("n_pages"),
        F.sum(F.coalesce("n_usable", F.lit(0))).alias("n_usable"), F.sum(F.coalesce("text_chars", F.lit(0))).alias("text_chars"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )


_QUERIES["source_status"] = flagship
