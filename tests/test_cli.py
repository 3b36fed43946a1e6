import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sluice.cli import main


@pytest.fixture()
def replay(tmp_path):
    page = "<body><a href='/minutes/1'>Minutes</a><a href='/minutes/2'>Minutes</a></body>"
    text = "<main><p>" + "The board met on May 20, 2025. " * 40 + "</p></main>"
    rows = [("https://t.example/", page), ("https://t.example/minutes/1", text), ("https://t.example/minutes/2", text)]
    path = str(tmp_path / "r.parquet")
    pq.write_table(pa.table({"url": [r[0] for r in rows], "status": [200] * 3, "content_type": ["text/html"] * 3, "body": [r[1].encode() for r in rows]}), path)
    return path


def call(capsys, *args):
    code = main(list(args))
    return code, json.loads(capsys.readouterr().out)


def test_discover_record_run(spark, capsys, tmp_path, replay):
    code, found = call(capsys, "probe", "https://t.example/", "--replay", replay)
    assert code == 0 and found["candidates"][0]["source_type"] == "html_page"
    book, config = str(tmp_path / "book.json"), '{"page_url": "https://t.example/"}'
    assert call(capsys, "add", book, "town", "html_page", "--config", config) == (0, {"id": "town", "change": "added"})
    assert call(capsys, "add", book, "town", "html_page", "--config", config)[1]["change"] == "updated"
    assert [r["id"] for r in call(capsys, "list", book)[1]] == ["town"]
    code, out = call(capsys, "run", book, "--replay", replay, "--year", "2026")
    assert code == 0 and out["all_clean"] and [d["doc_date"] for d in out["runs"][0]["documents"]] == ["2025-05-20"] * 2
    code, out = call(capsys, "run", book, "--only", "other", "--replay", replay)
    assert code == 0 and out["skipped"] == [{"id": "town", "because": "not selected"}]


def test_remembered_runs(spark, capsys, tmp_path, replay):
    book = tmp_path / "book.json"
    book.write_text(json.dumps({"version": 1, "sources": [
        {"id": "town", "source_type": "html_page", "config": {"page_url": "https://t.example/"}, "memory": {"success_count": 1, "doc_url_pattern": "^https://t\\.example/agendas/[0-9-]+$"}},
        {"id": "gone", "source_type": "html_page", "config": {"page_url": "https://t.example/gone"}}, {"id": "wrong", "source_type": "html_page", "config": {"nope": 1}},
    ]}))
    for n in (1, 2, 3):
        code, out = call(capsys, "run", str(book), "--remember", "--replay", replay, "--year", "2026")
        ran = {r["source_id"]: r for r in out["runs"]}
        assert code == 2 and {k: r["status"] for k, r in ran.items()} == {"town": "ok", "gone": "error", "wrong": "error"}
        assert ("shape_changed" in ran["town"]) == (n == 1) and "connection failed" in ran["gone"]["error"] and "nope" in ran["wrong"]["error"]
    kept = {s["id"]: s["memory"] for s in json.loads(book.read_text())["sources"]}
    assert kept["town"]["success_count"] == 4 and "failure_count" not in kept["town"] and kept["town"]["doc_url_pattern"].endswith("/minutes/[0-9-]+$")
    assert kept["gone"]["quarantined"] and kept["gone"]["consecutive_failures"] == 3 and out["newly_quarantined"] == ["gone", "wrong"]
    code, out = call(capsys, "run", str(book), "--replay", replay, "--year", "2026")
    assert code == 0 and [s["id"] for s in out["skipped"]] == ["gone", "wrong"]


def test_analyze_sniff_and_outputs(spark, capsys, tmp_path, monkeypatch):
    import io
    import sys

    f, out = tmp_path / "a.txt", str(tmp_path / "out")
    f.write_text("hello world")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "own_model.py").write_text("import json\ndef upper(text, prompt, schema, model):\n    return json.dumps({'start': text[:5].upper(), 'model': model})\n")
    spark.sparkContext.addPyFile(str(tmp_path / "own_model.py"))
    code, got = call(capsys, "analyze", str(f), "--prompt", "p", "--call", "own_model:upper", "--model", "m", "--out", out)
    assert code == 0 and json.loads(open(got["results"][0]["output_path"]).read()) == {"start": "HELLO", "model": "m"}
    assert call(capsys, "analyze", str(f), "--prompt", "p")[0] == 1 and call(capsys, "analyze", str(f), "--call", "own_model:upper")[0] == 1
    monkeypatch.setattr(sys, "stdin", io.StringIO("from a pipe"))
    code, rows = call(capsys, "extract", "-", "--out", out)
    assert code == 0 and open(rows[0]["output_path"]).read() == "from a pipe"
    trace = tmp_path / "t.json"
    trace.write_text(json.dumps({"page": "p", "pos": 0, "method": "GET", "url": "https://h/api?x=1", "content_type": "application/json", "body": '{"items": [{"a": 1}, {"a": 2}]}'}))
    code, got = call(capsys, "sniff", str(trace))
    assert code == 0 and got["suggestions"][0]["api_url"] == "https://h/api" and got["suggestions"][0]["items_key"] == "items"


def test_usage_and_files(spark, capsys, tmp_path):
    assert call(capsys, "validate", "html_page", "--config", '{"nope": 1}')[0] == 1
    assert call(capsys, "schema", "none")[0] == 1
    assert "html_page" in [s["name"] for s in call(capsys, "sources")[1]]
    assert call(capsys, "probe", "https://t.example/gone", "--replay", str(_empty(tmp_path)))[0] == 2
    f = tmp_path / "a.html"
    f.write_text("<main>Adopted May 4, 2025" + " text" * 900 + "</main>")
    code, rows = call(capsys, "extract", str(f), "--year", "2026")
    assert code == 0 and rows[0]["doc_date"] == "2025-05-04" and len(rows[0]["text"]) == 2_000 and rows[0]["is_preview"]
    assert call(capsys, "extract", str(tmp_path / "none.html"))[0] == 2


def _empty(tmp_path):
    path = tmp_path / "empty.parquet"
    pq.write_table(pa.table({"url": pa.array([], pa.string()), "status": pa.array([], pa.int64()), "content_type": pa.array([], pa.string()), "body": pa.array([], pa.binary())}), path)
    return path
