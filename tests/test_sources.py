import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sluice.sources import available_sources, open_source, register_source, source_class
from sluice.sources.adapters import Adapter, ConfigError, option_schema
from sluice.sources.files import read_recipes, recipe_json

H = "https://town.example"


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    index = '<a href="/f/2026-03-16-a.pdf">A</a><a href="/f/old/b.pdf">B</a><a href="/f/2026-03-16-a.pdf">again</a><a href="/minutes/1">Minutes one</a><a href="/meetings/7">x</a><a href="/meetings/12">y</a>'
    items = {"items": [{"id": 5, "date": "2026-01-02T00", "category": {"key": "k"}, "title": "T"}, {"id": 0, "category": {"key": 7}}, {"id": 6, "category": {"key": "k"}, "title": "x\ny"}]}
    rows = [
        (f"{H}/", 200, "text/html", index), (f"{H}/f/2026-03-16-a.pdf", 200, "application/pdf", "%PDF"), (f"{H}/f/old/b.pdf", 200, "text/html", "no"),
        (f"{H}/minutes/1", 200, "text/html", "<p>m</p>"), (f"{H}/meetings/12", 200, "text/html", '<a href="x.pdf">agenda</a><a href="/f/2026-03-16-a.pdf">minutes</a>'),
        (f"{H}/meetings/7", 404, "text/html", ""), (f"{H}/api", 200, "application/json", json.dumps(items)), (f"{H}/none", 200, "text/html", "<p>nothing</p>"),
    ]
    path = tmp_path_factory.mktemp("replay") / "r.parquet"
    pq.write_table(pa.table({"url": [r[0] for r in rows], "status": [r[1] for r in rows], "content_type": [r[2] for r in rows], "body": [r[3].encode() for r in rows]}), path)
    return str(path)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_pdf_direct(spark, store):
    got = open_source(spark, "pdf_direct", page_url=f"{H}/", replay=store, source_id="s")
    assert [(r.source_id, r.source_url, r.title, r.file_name, str(r.doc_date), bytes(r.raw_content)) for r in got.collect()] == [("s", f"{H}/f/2026-03-16-a.pdf", "A", "2026-03-16-a.pdf", "2026-03-16", b"%PDF")]
    assert open_source(spark, "pdf_direct", page_url=f"{H}/", replay=store, pdf_exclude_pattern="2026").count() == 0


def test_html_page_and_fallback(spark, store):
    assert rows(open_source(spark, "html_page", page_url=f"{H}/", replay=store), "source_url", "title") == [(f"{H}/minutes/1", "Minutes one")]
    assert rows(open_source(spark, "html_page", page_url=f"{H}/none", replay=store), "source_url") == [(f"{H}/none",)]
    assert open_source(spark, "html_page", page_url=f"{H}/gone", replay=store).count() == 0


def test_pdf_listing(spark, store):
    got = open_source(spark, "pdf_listing", index_url=f"{H}/", detail_link_pattern=r"/meetings/(\d+)", pdf_link_keyword="minutes", replay=store, limit=1)
    assert rows(got, "source_url") == [(f"{H}/f/2026-03-16-a.pdf",)]


def test_json_api(spark, store):
    got = open_source(spark, "json_api", api_url=f"{H}/api", filter_value="k", text_fields={"TITLE": "title"}, replay=store)
    assert [(r.source_url, r.raw_html, str(r.doc_date)) for r in got.collect()] == [
        (f"{H}/api/5", "<html><body><pre>TITLE: T</pre></body></html>", "2026-01-02"), (f"{H}/api/6", "<html><body><pre>\nTITLE:\nx\ny</pre></body></html>", "None"),
    ]
    assert rows(open_source(spark, "json_api", api_url=f"{H}/api", filter_path="", replay=store), "source_url")[1] == (f"{H}/api/unknown",)


def test_rendered_and_blocked(spark, store):
    assert open_source(spark, "playwright_render", page_url=f"{H}/", replay=store).count() == 1
    assert open_source(spark, "cloud_render", page_url=f"{H}/", mode="dom_html", replay=store).count() == 1
    assert open_source(spark, "blocked", page_url=f"{H}/", reason="waf", replay=store).count() == 0
    with pytest.raises(ConfigError):
        open_source(spark, "blocked", page_url=f"{H}/", reason="because")


def test_config_errors_and_registry(spark):
    with pytest.raises(ConfigError, match="unknown options nope"):
        open_source(spark, "pdf_direct", page_url=H, nope=1)
    with pytest.raises(ConfigError, match="missing"):
        open_source(spark, "pdf_listing", index_url=H)
    with pytest.raises(ConfigError, match="http address"):
        open_source(spark, "pdf_direct", page_url="ftp://x")
    with pytest.raises(KeyError):
        source_class("none")
    with pytest.raises(ValueError):
        register_source("pdf_direct")(type("X", (Adapter,), {}))
    assert "wp_media" in available_sources() and source_class("wp_media") is source_class("json_api")
    assert option_schema("pdf_listing")["required"] == ["index_url", "detail_link_pattern"]


def test_recipes(spark, tmp_path):
    assert read_recipes(spark, str(tmp_path / "none.json")).count() == 0
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"version": 1, "sources": [{"id": "b", "source_type": "html_page", "config": {"page_url": "u"}}, {"id": "a", "source_type": "blocked", "enabled": False, "memory": {"success_count": 2, "other": 1}}]}))
    got = read_recipes(spark, str(p)).orderBy("pos").collect()
    assert [(r.id, r.enabled, r.memory and r.memory.success_count) for r in got] == [("b", True, None), ("a", False, 2)]
    book = json.loads(recipe_json(read_recipes(spark, str(p))).collect()[0].json)
    assert [s["id"] for s in book["sources"]] == ["b", "a"] and book["sources"][0]["config"] == {"page_url": "u"}
    assert "memory" not in book["sources"][0] and book["sources"][1]["memory"] == {"success_count": 2}
    p.write_text('{"version": 1}')
    with pytest.raises(Exception, match="not a recipe file"):
        read_recipes(spark, str(p)).collect()


def test_why_a_request_failed(tmp_path):
    from sluice.sources.store import LiveStore, ReplayStore

    path = str(tmp_path / "r.parquet")
    pq.write_table(pa.table({"url": ["a", "b", "c"], "status": pa.array([200, 403, None], pa.int64()), "content_type": ["text/html"] * 3, "body": [b"x"] * 3, "error": [None, None, "timeout after 30s"]}), path)
    store = ReplayStore(path)
    assert store.attempt("a").response.text == "x" and store.get("b") is None
    assert store.attempt("b")[1:] == (403, "HTTP 403") and store.attempt("c")[1:] == (None, "timeout after 30s") and "connection failed" in store.attempt("d").error
    assert LiveStore().attempt("no address").response is None
    assert "connection failed" in LiveStore(timeout=2).attempt("http://127.0.0.1:9/").error


def test_url_dates_agree(spark):
    from pyspark.sql import functions as F

    from sluice.functions.dates import DateProfile, date_from_url, read_url_date

    urls = ["a/2026-13-40/2025-03-16.pdf", "m_12-31-2024.pdf", "minutes-March-5,-2025", "x/1999-01-01", "may_7_2026", "none", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(date_from_url("u", DateProfile(2026))).collect()] == [read_url_date(u, DateProfile(2026)) for u in urls]
