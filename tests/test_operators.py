from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions.canonical import canonical_url
from sluice.functions.jsons import describe_json, strip_fence
from sluice.functions.urls import common_path_prefix, sanitize_filename, shape_pattern, slug_shape, url_skeleton
from sluice.operators import analysis, links, probe, runs
from sluice.operators.scale import first_rows, scratch


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_addresses(spark):
    same = ["https://www.A.example:443/x%2Dy/?b=2&a=1#top", "http://a.example/x-y?a=1&b=2&utm_source=z", "HTTP://A.EXAMPLE./q/../x-y/index.html?b=2&a=1&PHPSESSID=9"]
    got = col(spark, same + ["https://a.example/X-y?a=1&b=2", None, "", "https://a.example/%zz"], canonical_url)
    assert len(set(got[:3])) == 1 and got[3] != got[0] and got[4] is None and got[5] is None and got[6]


def test_shapes(spark):
    assert col(spark, ["/meetings/details/106", "/a/b-c/", "", None], slug_shape) == ["/meetings/details/<n>", "/a/<slug>", "/", None]
    assert col(spark, ["/fs/<slug>/view/<n>", "/a.b"], shape_pattern) == [r"/fs/(?:[a-zA-Z0-9-]+)/view/(\d+)", r"/a\.b"]
    assert col(spark, ["https://h/2026-06-15/abcdef0123", None], url_skeleton) == [r"^https://h/[0-9-]+/[0-9a-fA-F]+$", None]
    assert col(spark, ["a b.pdf?x#y", "", None, "?"], sanitize_filename) == ["a_b.pdf", "document", "document", "document"]
    assert col(spark, [["/a/b/1", "/a/b/2"], ["/a", "/b"], [], ["/x/y"]], common_path_prefix, "array<string>") == ["/a/b/", "", "", "/x/y/"]


def test_json(spark):
    got = col(spark, ['[{"b":1,"a":2},{}]', '{"z":[1],"l":[{"k":1},{"k":2}]}', '{"b":1}', "3", "null", "oops", None], describe_json)
    assert [(g.shape, g.item_count, g.item_keys, g.is_listing) if g else None for g in got] == [
        ("array", 2, ["a", "b"], True), ("object with 'l' array", 2, ["k"], True), ("object", 0, ["b"], False), ("int", 0, [], False), ("NoneType", 0, [], False), None, None,
    ]
    assert col(spark, ["```json\n{}\n```", " x ", None], strip_fence) == ["{}", "x", None]


def test_listing_order(spark):
    rows = [("p", 0, "/d/3", "u3", "c"), ("p", 1, "/d/9", "u9", "a"), ("p", 2, "/d/3", "u3", "dup"), ("q", 0, "/d/1", "v1", ""), ("q", 1, "/d/x", "vx", "")]
    df = spark.createDataFrame(rows, "page string, pos int, raw string, href string, label string")
    got = [(r.page, r.href) for r in links.listing(df, r"/d/(\w+)").orderBy("page", "rank").collect()]
    assert got == [("p", "u9"), ("p", "u3"), ("q", "v1"), ("q", "vx")]
    assert links.listing(df.limit(0), r"/d/(\d+)").count() == 0


def test_listing_numbers_of_any_length_and_groups(spark):
    rows = [("p", i, f"/d/{x}", f"u{x}", "") for i, x in enumerate(["100000000001", "100000000003", "0099", "100000000002"])]
    df = spark.createDataFrame(rows, "page string, pos int, raw string, href string, label string")
    order = ["u100000000003", "u100000000002", "u100000000001", "u0099"]
    for pattern in (r"/d/(\d+)", r"/d\(?/(?=\d)(\d+)"):
        assert [r.href for r in links.listing(df, pattern, limit=9).orderBy("rank").collect()] == order
    assert [r.href for r in links.listing(df, r"/d/(?=\d)", limit=2).orderBy("rank").collect()] == ["u100000000001", "u100000000003"]
    files = spark.createDataFrame([("u100000000003", 0, "x.pdf", "f3.pdf", "agenda"), ("u100000000003", 1, "y.pdf", "f4.pdf", "minutes"), ("u0099", 0, "n", "n", "")], "page string, pos int, raw string, href string, label string")
    assert [tuple(r) for r in links.detail_files(links.listing(df, r"/d/(\d+)"), files, "minutes").collect()] == [("p", 1, "u100000000003", "f4.pdf", "minutes")]


def test_common_prefix(spark):
    df = spark.createDataFrame([(1, "https://h/a/b/1"), (1, "https://h/a/b/2"), (2, "https://h/x"), (2, "https://h/y"), (3, None)], "g int, u string")
    assert {r.g: r.prefix for r in links.common_prefix(df, "g", "u").collect()} == {1: "/a/b/", 2: "", 3: ""}


def test_candidates_of_a_page(spark):
    link = lambda i, h, t="": (i, h, h, t)
    rows = [
        ("https://t.example/", ([link(i, f"https://t.example/f/{i}.pdf?x=1") for i in range(3)], 900, 0, None)),
        ("https://u.example/", ([link(i, f"https://u.example/view/{i}") for i in range(4)], 10, 9, None)),
        ("https://v.legistar.com/", ([], None, None, None)),
        ("https://w.example/", (None, 5, 0, "https://w.example/wp-json/")),
    ]
    df = spark.createDataFrame(rows, "page string, read struct<links:array<struct<pos:int,raw:string,href:string,label:string>>,text_chars:bigint,script_tags:int,wp_api:string>")
    got = {}
    for r in probe.candidates(df).orderBy("page", "rank").collect():
        got.setdefault(r.page[8], []).append((r.source_type, r.confidence, r.evidence_count))
    assert got == {"t": [("pdf_direct", "high", 3)], "u": [("pdf_listing", "medium", 4), ("playwright_render", "medium", 9)], "v": [(None, "high", 1)], "w": [("json_api", "high", 1)]}
    served = spark.createDataFrame([("https://u.example/view/0", "application/pdf"), ("https://t.example/f/0.pdf?x=1", "application/pdf")], "href string, content_type string")
    first = probe.candidates(df, served).filter("page = 'https://u.example/' and rank = 1").collect()[0]
    assert (first.source_type, first.confidence, first.detail, first.config) == ("pdf_direct", "high", "/view/", '{"page_url":"https://u.example/","pdf_link_pattern":"/view/"}')
    plan = probe.candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # all from a page's own row


def test_top_ties_go_to_the_first(spark):
    rows = [("https://h.example/", i, "", f"https://h.example/{x}", "") for i, x in enumerate(["b/1", "a/1", "a/2", "b/2", "a/3", "b/3"])]
    df = spark.createDataFrame(rows, "page string, pos int, raw string, href string, label string")
    assert [r.shape for r in links.top_route(df).collect()] == ["/b/<n>"]


def test_verification_promotes(spark):
    ranked = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("p", "d", 4)], "page string, source_type string, rank int")
    tried = spark.createDataFrame([("p", "a", 10), ("p", "b", 900), ("p", "c", 900), ("p", "d", 900)], "page string, source_type string, text_chars int")
    got = [(r.source_type, r.verified) for r in probe.verified(ranked, tried).orderBy("rank").collect()]
    assert got == [("b", True), ("a", False), ("c", None), ("d", None)]


def runs_df(spark, rows):
    return spark.createDataFrame([(s, i, st, datetime(2025, 1, 1 + i), "e" if st != "ok" else None, p) for i, (s, st, p) in enumerate(rows)], "source_id string, run_id int, status string, started_at timestamp, error string, pattern string")


@pytest.mark.parametrize("history", [["ok"] * 2, ["error"] * 4, ["ok", "partial", "error", "empty"], ["error", "error", "error", "ok"], ["ok", "error"]])
def test_memory_is_the_sequential_fold(spark, history):
    from sluice.streaming.memory import _NAMES, fold

    r = runs_df(spark, [("s", h, f"p{i}" if h == "ok" else None) for i, h in enumerate(history)])
    s = dict(zip(_NAMES, (0, 0, 0, None, None, None, None, None)))
    for x in r.orderBy("run_id").collect():
        s = fold(s, x.status, x.started_at, x.error, x.pattern)
    got = runs.fold_memory(r, pattern="pattern").collect()[0].asDict()
    assert {k: got[k] for k in _NAMES} == s and got["quarantined"] == (s["consecutive_failures"] >= 3)
    for cut in range(1, len(history)):  # carried-in memory gives the same
        first = runs.fold_memory(r.filter(f"run_id < {cut}"), pattern="pattern")
        both = runs.fold_memory(r.filter(f"run_id >= {cut}"), pattern="pattern", before=first).collect()[0].asDict()
        assert {k: both[k] for k in _NAMES} == s


def test_upsert_and_first_rows(spark):
    book = spark.createDataFrame([("a", "1", "m"), ("b", "2", None)], "source_id string, config string, memory string")
    new = spark.createDataFrame([("a", "9", None), ("c", "3", None)], "source_id string, config string, memory string")
    got = {r.source_id: tuple(r)[1:] for r in runs.upsert_recipes(book, new, memory="memory").collect()}
    assert got == {"a": ("9", "m", "updated"), "b": ("2", None, "kept"), "c": ("3", None, "added")}
    placed = runs.upsert_recipes(book.selectExpr("*", "source_id = 'a' as pos").withColumn("pos", F.col("pos").cast("int")), new.withColumn("pos", F.lit(0)), memory="memory")
    assert [r.source_id for r in placed.orderBy("pos").collect()] == ["b", "a", "c"]
    rep = scratch(spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "n"), (None, "n")], "k int, v string"))
    assert sorted(map(tuple, first_rows(rep, "k", "v").collect()), key=str) == [(1, "x"), (2, None), (None, "n")]
    assert first_rows(rep.limit(0), "k").count() == 0
    many = scratch(spark.range(4000).selectExpr("cast(id % 300 as int) k", "repeat(cast(id % 300 as string), 9) body").repartition(7))
    for most in (10, 200_000):  # in groups of files, and at once
        once = first_rows(many, "k", "body", most=most)
        assert sorted(map(tuple, once.collect())) == [(k, str(k) * 9) for k in range(300)]
        assert "body" not in "".join(l for l in once._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in l)


def test_schema_and_readers(spark):
    schema = {"type": "object", "additionalProperties": False, "properties": {"title": {"type": "string", "title": "no"}}}
    assert analysis.clean_schema(schema) == {"type": "object", "properties": {"title": {"type": "string"}}}
    df = spark.createDataFrame([("a" * 100, "b" * 200, "c"), ("a", "b" * 200, "c"), ("a", "b", "c"), (None, None, None)], "p string, y string, o string")
    assert [r[0].method for r in df.select(analysis.choose_reader(F.col("p"), F.col("y"), F.col("o"))).collect()] == ["pdfplumber", "pypdf", "ocr", "none"]


def test_next_step_of_an_unlisted_reason(spark):
    default = "No known way through. Revisit if the site changes."
    assert col(spark, ["other", None, "", "WAF", "waf"], probe.next_step_for) == [default] * 4 + [probe.NEXT_STEPS["waf"]]
