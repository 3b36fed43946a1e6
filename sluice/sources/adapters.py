"""Adapters: ``spark.read.format(name).options(...)`` gives documents.

Every adapter takes ``source_id``, ``limit`` and ``replay`` (captured responses instead of the network)
besides its own options; ``urls`` (or the adapter's address option) may hold several addresses, one to
a line, and each is read by a task of its own. Unknown options are errors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.functions.dates import DateProfile, read_url_date
from sluice.functions.html import page_links
from sluice.functions.jsons import item_text
from sluice.sources.store import Response, open_store

DOCUMENT = "source_id string, source_url string, title string, file_name string, raw_content binary, raw_html string, doc_date date, content_type string, fetched_at timestamp"
COMMON = frozenset({"source_id", "limit", "replay", "timeout", "urls", "path", "year", "on_error"})

_REGISTRY: dict[str, type[Adapter]] = {}


class ConfigError(ValueError):
    """An option is missing, unknown or malformed."""


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class Adapter(DataSource):
    """Subclass with ``address`` (option of the address), ``fields`` (name -> default, ``...`` if required) and ``fetch``."""

    address = "page_url"
    fields: dict = {}
    #: Whether the adapter asks for its address at all.
    asks = True

    def schema(self) -> str:
        return DOCUMENT

    def config(self) -> dict:
        given = {k.lower(): v for k, v in self.options.items()}
        unknown = sorted(set(given) - COMMON - {f.lower() for f in self.fields} - {self.address})
        if unknown:
            raise ConfigError(f"{self.name()}: unknown options {', '.join(unknown)}")
        out = {}
        for f, default in self.fields.items():
            value = given.get(f.lower(), default)
            if value is ...:
                raise ConfigError(f"{self.name()}: {f} is missing")
            out[f] = value
        urls = [u.strip() for u in (given.get("urls") or given.get(self.address) or "").splitlines() if u.strip()]
        if not urls or any(not re.match(r"https?://", u) for u in urls):
            raise ConfigError(f"{self.name()}: {self.address} must be an http address")
        return out | {"urls": urls, "limit": int(given.get("limit", 3)), "source_id": given.get("source_id", self.name()), "year": int(given.get("year", date.today().year)), "on_error": given.get("on_error", "raise")}

    def reader(self, schema) -> DataSourceReader:
        return _Reader(type(self), self.config(), dict(self.options))

    @classmethod
    def fetch(cls, url: str, config: dict, get) -> Iterator[dict]:
        raise NotImplementedError


class _Reader(DataSourceReader):
    def __init__(self, adapter: type[Adapter], config: dict, options: dict):
        self.adapter, self.settings, self.given = adapter, config, options

    def partitions(self):
        return [_Page(u) for u in self.settings["urls"]]

    def read(self, partition: _Page):
        store = open_store(self.given)
        now = datetime.now()
        for d in self._documents(partition.url, store):
            yield (self.settings["source_id"], d["source_url"], d.get("title"), d.get("file_name"), d.get("raw_content"), d.get("raw_html"), d.get("doc_date"), d["content_type"], now)


    def _documents(self, url: str, store):
        """The documents of an address; with ``on_error`` row a failure is a row of its own, so that other sources of the job go on."""
        try:
            n = 0
            for d in self.adapter.fetch(url, self.settings, store.get):
                n += 1
                yield d
            if not n and self.settings["on_error"] == "row" and self.adapter.asks and (why := store.attempt(url)).response is None:
                yield {"source_url": url, "title": why.error, "content_type": "error"}
        except Exception as e:
            if self.settings["on_error"] != "row":
                raise
            yield {"source_url": url, "title": f"{type(e).__name__}: {e}", "content_type": "error"}


def register_source(*names: str):
    """Class decorator: the first name is the adapter's own, the others aliases. A name of another class is an error."""

    def add(cls: type[Adapter]) -> type[Adapter]:
        for n in names:
            if _REGISTRY.get(n, cls) is not cls:
                raise ValueError(f"source {n!r} is already registered")
        for n in names:
            _REGISTRY[n] = cls
        cls.names = names
        cls.name = classmethod(lambda c: names[0])
        return cls

    return add


def source_class(name: str) -> type[Adapter]:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(available_sources())}") from None


def available_sources() -> list[str]:
    return sorted(_REGISTRY)


def register_all(spark: SparkSession) -> None:
    """Make every adapter available as a format, under each of its names."""
    for n, cls in _REGISTRY.items():
        spark.dataSource.register(cls if n == cls.names[0] else type(cls.__name__, (cls,), {"name": classmethod(lambda c, n=n: n)}))


def open_source(spark: SparkSession, name: str, **options):
    """Documents of an adapter; its configuration is checked here, before any job."""
    cls = source_class(name)
    options = {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in options.items() if v is not None}
    cls(options).config()
    register_all(spark)
    return spark.read.format(cls.name()).options(**options).load()


def _file(url: str) -> str:
    name = re.sub(r"[^a-zA-Z0-9._-]", "_", re.split(r"[?#]", url.rsplit("/", 1)[-1])[0])[:200]
    return name or "document.pdf"


def _pdf(get, url: str, title: str | None, doc_date: date | None) -> Iterator[dict]:
    r: Response | None = get(url)
    if r and "application/pdf" in r.content_type.lower():
        yield {"source_url": url, "title": title or None, "file_name": _file(r.url), "raw_content": r.body, "doc_date": doc_date, "content_type": "pdf"}


def _url_date(url: str, config: dict) -> date | None:
    return read_url_date(url, DateProfile(config["year"]))


@register_source("pdf_direct")
class PdfDirect(Adapter):
    """Files linked on a page: addresses with ``pdf_link_pattern`` in them, else ending in .pdf, without ``pdf_exclude_pattern``; the first ``limit``."""

    fields = {"pdf_link_pattern": None, "pdf_exclude_pattern": None}

    @classmethod
    def fetch(cls, url, config, get):
        page = get(url)
        want, bar = config["pdf_link_pattern"], config["pdf_exclude_pattern"]
        links = page_links(page.text, url) if page else []
        chosen = [(href, label) for _, _, href, label in links if (want in href if want else href.lower().endswith(".pdf")) and not (bar and bar in href)]
        for href, label in chosen[: config["limit"]]:
            yield from _pdf(get, href, label, _url_date(href, config))


@register_source("html_page")
class HtmlPage(Adapter):
    """Documents that are pages: links with ``link_pattern`` in address or label; without any the page itself."""

    fields = {"link_pattern": "minutes"}

    @classmethod
    def fetch(cls, url, config, get):
        page = get(url)
        if not page:
            return
        n = config["link_pattern"].lower()
        chosen = [(h, l) for _, _, h, l in page_links(page.text, url) if (n in h.lower() or n in l.lower()) and not re.search(r"\.(pdf|docx?)$", h.lower())]
        if not chosen:
            yield {"source_url": url, "raw_html": page.text, "content_type": "html"}
        for href, label in chosen[: config["limit"]]:
            if r := get(href):
                yield {"source_url": href, "title": label or None, "raw_html": r.text, "doc_date": _url_date(href, config), "content_type": "html"}


@register_source("pdf_listing")
class PdfListing(Adapter):
    """An index of detail pages with a file each; ``limit`` counts detail pages, newest first if all are numbered."""

    address = "index_url"
    fields = {"detail_link_pattern": ..., "pdf_link_keyword": None}

    @classmethod
    def fetch(cls, url, config, get):
        page, pattern = get(url), re.compile(config["detail_link_pattern"])
        found = [(m, href, label) for _, raw, href, label in (page_links(page.text, url) if page else []) if (m := pattern.search(raw))]
        keys = [int(m[1]) if pattern.groups and (m[1] or "").isdigit() else None for m, _, _ in found]
        order = sorted(range(len(found)), key=lambda k: -keys[k]) if found and None not in keys else range(len(found))
        word = (config["pdf_link_keyword"] or "").lower()
        for k in list(order)[: config["limit"]]:
            _, href, label = found[k]
            detail = get(href)
            for _, raw, full, text in page_links(detail.text, href) if detail else []:
                if raw.lower().endswith(".pdf") and (not word or word in raw.lower() or word in text.lower()):
                    yield from _pdf(get, full, label, None)
                    break


@register_source("json_api", "wp_media")
class JsonApi(Adapter):
    """Listings as JSON: ``mode`` metadata_items makes a text of each item, wp_rest_media downloads each item's file."""

    address = "api_url"
    fields = {
        "query": None, "mode": "metadata_items", "items_key": "items", "text_fields": '{"TITLE": "title"}', "date_field": "date", "id_field": "id",
        "filter_path": "category.key", "filter_value": None, "pdf_url_field": "source_url",
    }

    @staticmethod
    def _dig(item, dotted: str):
        for part in dotted.split("."):
            item = item.get(part) if isinstance(item, dict) else None
        return item

    @staticmethod
    def _day(value) -> date | None:
        try:
            return date.fromisoformat(value[:10]) if isinstance(value, str) and re.match(r"\d{4}-\d{2}-\d{2}", value) else None
        except ValueError:
            return None

    @classmethod
    def fetch(cls, url, config, get):
        media = config["mode"] == "wp_rest_media"
        page = get(url + (config["query"] or ("?per_page=20&mime_type=application/pdf" if media else "?limit=10&skip=0&sortBy=date&sortDesc=true"))) or get(url)
        try:
            data = json.loads(page.text) if page else None
        except ValueError:
            data = None
        key = None if media or config["items_key"] in (None, "") else config["items_key"]
        items = data if key is None else data.get(key) if isinstance(data, dict) else None
        if not isinstance(items, list):
            return
        if media:
            n = 0
            for it in items:
                href = cls._dig(it, config["pdf_url_field"])
                if n < config["limit"] and isinstance(href, str) and href.lower().endswith(".pdf"):
                    for d in _pdf(get, href, None, cls._day(cls._dig(it, config["date_field"]))):
                        n += 1
                        yield d
            return
        if config["filter_path"] and config["filter_value"]:
            items = [it for it in items if cls._dig(it, config["filter_path"]) == config["filter_value"]]
        for it in items[: config["limit"]]:
            body = item_text([(label, cls._dig(it, dotted)) for label, dotted in json.loads(config["text_fields"]).items()])
            yield {"source_url": f"{url}/{cls._dig(it, config['id_field']) or 'unknown'}", "raw_html": body, "doc_date": cls._day(cls._dig(it, config["date_field"])), "content_type": "html"}


class _Rendered(Adapter):
    """Pages as a browser rendered them: the store must hold the rendered page; a live store gets the page as served."""

    fields = {"mode": "pdf_links", "link_pattern": None, "link_text_keyword": None, "pdf_link_keyword": None, "follow_link_text": None, "wait_strategy": "domcontentloaded", "proxy": None}
    any_pdf = r"\.pdf(\?|$)"

    @classmethod
    def fetch(cls, url, config, get):
        page = get(url)
        if page and config["follow_link_text"]:
            text = config["follow_link_text"].replace("{year}", str(config["year"])).lower()
            target = next((h for _, _, h, l in page_links(page.text, url) if text in l.lower()), None)
            page, url = (get(target), target) if target else (page, url)
        if not page:
            return
        if config["mode"] == "dom_html":
            yield {"source_url": url, "raw_html": page.text, "content_type": "html"}
            return
        for href in cls.choose(page_links(page.text, url), config)[: config["limit"]]:
            yield from _pdf(get, href, None, _url_date(href, config))

    @classmethod
    def choose(cls, links, config) -> list[str]:
        if word := (config["link_text_keyword"] or "").lower():
            return [h for _, _, h, l in links if word in l.lower()]
        word = (config["pdf_link_keyword"] or "").lower()
        return [h for _, _, h, _ in links if re.search(cls.any_pdf, h.lower()) and word in h.lower()]


@register_source("playwright_render")
class PlaywrightRender(_Rendered):
    """A page rendered by a local browser."""


@register_source("cloud_render")
class CloudRender(_Rendered):
    """A page rendered by a hosted browser: links with ``link_pattern`` and with ``link_text_keyword`` in address or label, else .pdf."""

    @classmethod
    def choose(cls, links, config) -> list[str]:
        pattern, word = config["link_pattern"], (config["link_text_keyword"] or "").lower()
        if not pattern and not word:
            return [h for _, _, h, _ in links if ".pdf" in h.lower()]
        return [h for _, _, h, l in links if (not pattern or pattern in h) and (not word or word in h.lower() or word in l.lower())]


@register_source("blocked")
class Blocked(Adapter):
    """A source known to be out of reach: it records why and gives no documents."""

    fields = {"reason": ..., "detail": None}
    asks = False
    reasons = ("login_required", "waf", "captcha", "ip_blocked", "paywall", "no_public_archive", "other")

    def config(self) -> dict:
        out = super().config()
        if out["reason"] not in self.reasons:
            raise ConfigError(f"blocked: reason must be one of {', '.join(self.reasons)}")
        return out

    @classmethod
    def fetch(cls, url, config, get):
        yield from ()


def option_schema(name: str) -> dict:
    """The options of an adapter as a JSON schema."""
    cls = source_class(name)
    fields = {cls.address: ..., **cls.fields}
    return {
        "type": "object", "additionalProperties": False, "required": [f for f, d in fields.items() if d is ...],
        "properties": {f: {"type": "string"} | ({"default": d} if d not in (None, ...) else {}) for f, d in fields.items()},
    }
