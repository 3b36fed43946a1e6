"""Thin command line: ``python -m sluice COMMAND``. Prints JSON; exits 0 if all is well, 1 on wrong usage, 2 if something needs attention."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluice.functions import dates, html, truncate
from sluice.operators import analysis, fleet, probe, sniff
from sluice.operators.scale import scratch
from sluice.sources import available_sources, source_class
from sluice.sources.adapters import ConfigError, option_schema
from sluice.sources.files import MEMORY, read_files, read_recipes
from sluice.sources.store import open_store


def _spark() -> SparkSession:
    s = SparkSession.builder.appName("sluice").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _say(value, code: int = 0) -> int:
    print(json.dumps(value, indent=2, default=str))
    return code


def _config(given: str | None) -> dict:
    """Inline JSON, ``@file`` or a file's name."""
    if not given:
        return {}
    name = given.removeprefix("@")
    text = Path(name).read_text() if given[0] == "@" or os.path.exists(name) else given
    out = json.loads(text)
    if not isinstance(out, dict):
        raise ConfigError("a config must be a JSON object")
    return out


def _profile(year: int) -> dates.DateProfile:
    return dates.DateProfile(as_of_year=year)


def _records(journal, documents, extract: bool = True) -> list[dict]:
    """Run records with their documents; at most ``limit`` documents of each source come to the driver."""
    ran = fleet.statuses(journal, documents, extract)
    told: dict[str, list[dict]] = {}
    for r in documents.filter("error is null").drop("text", "error").collect():
        told.setdefault(r.source_id, []).append({k: v for k, v in r.asDict().items() if k != "source_id"})
    return [r.asDict() | {"documents": told.get(r.source_id, [])} for r in ran.collect()]


def _harvest(spark, recipes: list[dict], args):
    began = time.perf_counter()
    journal, documents = fleet.harvest(spark, recipes, _profile(args.year), args.limit, args.replay, args.max_chars, not args.no_extract)
    documents = scratch(documents)  # the network is asked once
    steps = [{"name": "fetch and extract", "ok": True, "detail": f"{len(recipes)} sources in one job", "elapsed_ms": int(1000 * (time.perf_counter() - began))}]
    return journal, documents, steps


def main(argv: list[str] | None = None) -> int:
    from datetime import date

    top = argparse.ArgumentParser(prog="sluice")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options) -> None:
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(*o[0], **o[1])
        p.add_argument("--replay", help="Parquet of captured responses in place of the network")
        p.add_argument("--year", type=int, default=date.today().year, help="year that stands for today")
        p.add_argument("--limit", type=int, default=3)

    word = lambda n, **k: ((n,), k)
    config = word("--config", default=None)
    command("sources")
    command("schema", word("source_type"))
    command("validate", word("source_type"), config)
    longest, bare = word("--max-chars", type=int, default=0), word("--no-extract", action="store_true")
    command("probe", word("url"), word("--verify", action="store_true"))
    command("fetch", word("source_type"), config, longest, bare)
    command("extract", word("paths", nargs="+"), longest, word("--full", action="store_true"), word("--out", default=None))
    command("analyze", word("paths", nargs="+"), word("--prompt", default=None), word("--prompt-file", default=None), word("--schema", default=None), word("--call", default=None), word("--model", default=None), word("--fallback-model", default=None), word("--max-chars", type=int, default=400_000), word("--out", default=None))
    command("sniff", word("trace"), word("--page", default=None))
    command("add", word("book"), word("source_id"), word("source_type"), config)
    command("list", word("book"))
    command("run", word("book"), word("--only", nargs="*", default=None), word("--include-quarantined", action="store_true"), word("--remember", action="store_true"), longest, bare)
    try:
        args = top.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    try:
        return globals()[f"_{args.command}_command"](args)
    except (ConfigError, KeyError, ValueError, FileNotFoundError) as e:
        return _say({"error": str(e)}, 1)


def _sources_command(args) -> int:
    return _say([{"name": n, "about": (source_class(n).__doc__ or "").strip().splitlines()[0]} for n in available_sources()])


def _schema_command(args) -> int:
    return _say(option_schema(args.source_type))


def _validate_command(args) -> int:
    source_class(args.source_type)({k: str(v) for k, v in _config(args.config).items()}).config()
    return _say({"ok": True})


def _probe_command(args) -> int:
    store = open_store({"replay": args.replay} if args.replay else {})
    page, status, error = store.attempt(args.url)
    spark = _spark()
    if page is None:
        u = spark.range(1).select(probe.unreachable(F.lit(status).cast("int"), F.lit(error)).alias("u")).collect()[0].u
        return _say({"url": args.url, "ok": False, "status": status, "error": error} | u.asDict(), 2)
    df = spark.createDataFrame([(args.url, page.text)], "page string, html string").select("page", html.read_page("html", "page").alias("read"))
    # One link of the likeliest group is asked what it serves.
    asked = {href for r in df.select("read.links").collect() for href in [l.href for l in r.links or ()][:3]}
    served = [(h, got.content_type) for h in sorted(asked) if (got := store.get(h))] if args.verify else []
    ranked = scratch(probe.candidates(df, spark.createDataFrame(served, "href string, content_type string") if served else None))
    if args.verify:
        tried = []
        for c in ranked.filter("source_type is not null").orderBy("rank").limit(3).collect():
            journal, documents = fleet.harvest(spark, [{"id": "trial", "source_type": c.source_type, "config": json.loads(c.config)}], _profile(args.year), 1, args.replay)
            tried.append((args.url, c.source_type, documents.agg(F.max("text_chars")).collect()[0][0] or 0))
        ranked = probe.verified(ranked, spark.createDataFrame(tried, "page string, source_type string, text_chars bigint"))
    stats = df.select("read.text_chars", "read.html_chars", "read.script_tags", F.size("read.links").alias("links")).collect()[0].asDict()
    found = [r.asDict() | {"config": json.loads(r.config) if r.config else None} for r in ranked.orderBy("rank").collect()]
    return _say({"url": args.url, "ok": bool(found), "stats": stats, "candidates": found}, 0 if found else 2)


def _fetch_command(args) -> int:
    spark = _spark()
    journal, documents, steps = _harvest(spark, [{"id": args.source_type, "source_type": args.source_type, "config": _config(args.config)}], args)
    record = _records(journal, documents, not args.no_extract)[0] | {"steps": steps}
    return _say(record, 0 if record["status"] == "ok" else 2)


def _inputs(paths: list[str]) -> tuple[list[str], list[dict]]:
    """Files to read, ``-`` being what stands on the standard input, and rows for those that are not there."""
    there, missing = [], []
    for p in paths:
        if p == "-":
            with tempfile.NamedTemporaryFile("w", suffix=".txt", prefix="stdin-", delete=False) as f:
                f.write(sys.stdin.read())
            there.append(f.name)
        elif os.path.exists(p):
            there.append(p)
        else:
            missing.append({"path": p, "error": "no such file"})
    return there, missing


def _extract_command(args) -> int:
    there, rows = _inputs(args.paths)
    if there:
        f = read_files(_spark(), *there)
        cut = truncate.truncate("text", args.max_chars or 10**12, only_over=True)
        name = F.element_at(F.split("path", "/"), -1)
        day = F.coalesce(dates.date_from_text("text", _profile(args.year)), dates.date_from_url(name, _profile(args.year)))
        f = f.select("path", "kind", "method", "error", day.alias("doc_date"), cut.alias("t"))
        shown = F.col("t.text") if args.full or args.out else F.substring("t.text", 1, 2_000)
        f = f.select("path", "kind", "method", "error", "doc_date", F.col("t.original_chars").alias("chars"), F.col("t.method").alias("truncation"), shown.alias("text"), (F.length("t.text") > F.length(shown)).alias("is_preview"))
        for r in f.collect():
            row = r.asDict()
            if args.out and not row["error"]:
                row["output_path"] = _write(args.out, row["path"], ".txt", row.pop("text"))
            rows.append(row)
    return _say(rows, 2 if any(r.get("error") for r in rows) else 0)


def _write(folder: str, path: str, suffix: str, text: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = Path(folder) / (Path(path).stem + suffix)
    target.write_text(text or "")
    return str(target)


def _analyze_command(args) -> int:
    """``--call module:function`` is the model: ``(text, prompt, schema, model) -> str``; there is none built in."""
    prompt = Path(args.prompt_file).read_text() if args.prompt_file else args.prompt
    if not prompt:
        raise ConfigError("a prompt is required: --prompt or --prompt-file")
    schema = json.loads(Path(args.schema).read_text()) if args.schema else None
    call, models = analysis.resolve_provider(args.call, args.model, args.fallback_model)
    there, rows = _inputs(args.paths)
    if there:
        files = read_files(_spark(), *there)
        done = analysis.analyse(files.filter("error is null"), "text", prompt, call, models, schema, args.max_chars)
        rows += [{"path": r.path, "error": r.error} for r in files.filter("error is not null").collect()]
        for r in done.select("path", "analysis.*").collect():
            row = r.asDict() | {"data": json.loads(r.data) if r.data else None}
            if args.out and row["ok"]:
                row["output_path"] = _write(args.out, row["path"], ".json", json.dumps(row["data"], indent=2) + "\n")
                row.pop("text")
            rows.append(row)
    ok = all(r.get("ok") for r in rows)
    return _say({"ok": ok, "results": rows}, 0 if ok else 2)


def _sniff_command(args) -> int:
    """A captured network trace: JSON lines of ``page, pos, method, url, content_type, body``."""
    calls = _spark().read.schema("page string, pos int, method string, url string, content_type string, body string").json(args.trace)
    calls = calls.filter(F.col("page") == args.page) if args.page else calls
    ranked = scratch(sniff.rank_calls(calls))
    found = [r.asDict() for r in sniff.suggest(ranked).orderBy("page").collect()]
    ok = any(f["api_url"] for f in found)
    return _say({"ok": ok, "suggestions": found, "calls": [r.asDict() for r in ranked.orderBy("page", "rank").collect()]}, 0 if ok else 2)


def _book(path: str) -> dict:
    if not os.path.exists(path):
        return {"version": 1, "sources": []}
    book = json.loads(Path(path).read_text())
    if not isinstance(book, dict) or "sources" not in book:
        raise ConfigError("not a recipe file: expected 'sources'")
    return book


def _add_command(args) -> int:
    source_class(args.source_type)({k: str(v) for k, v in _config(args.config).items()}).config()
    book, new = _book(args.book), {"id": args.source_id, "source_type": args.source_type, "config": _config(args.config), "enabled": True}
    at = next((i for i, s in enumerate(book["sources"]) if s["id"] == new["id"]), None)
    if at is None:
        book["sources"].append(new)
    else:
        book["sources"][at] = new | {k: v for k, v in book["sources"][at].items() if k == "memory"}
    Path(args.book).write_text(json.dumps(book, indent=2) + "\n")
    return _say({"id": new["id"], "change": "added" if at is None else "updated"})


def _list_command(args) -> int:
    return _say([r.asDict(recursive=True) for r in read_recipes(_spark(), args.book).orderBy("pos").collect()])


def _run_command(args) -> int:
    """Every active source of a book in one job; ``--remember`` folds the runs into the book's memory."""
    spark, book, skipped, chosen = _spark(), _book(args.book), [], []
    for s in book["sources"]:
        memory = s.get("memory") or {}
        if args.only and s["id"] not in args.only:
            skipped.append({"id": s["id"], "because": "not selected"})
        elif not s.get("enabled", True):
            skipped.append({"id": s["id"], "because": "disabled"})
        elif memory.get("quarantined") and not args.include_quarantined:
            skipped.append({"id": s["id"], "because": memory.get("quarantine_reason") or "quarantined"})
        else:
            chosen.append(s)
    journal, documents, steps = _harvest(spark, [{"id": s["id"], "source_type": s["source_type"], "config": s.get("config") or {}} for s in chosen], args)
    records = _records(journal, documents, not args.no_extract)
    out = {"runs": records, "skipped": skipped, "steps": steps}
    if args.remember:
        ran = fleet.statuses(journal, documents, not args.no_extract)
        known = {r.source_id: r.asDict() for r in fleet.remember(read_recipes(spark, args.book), ran, documents).collect()}
        for s in chosen:
            m = known[s["id"]]
            told = {c: m[c].isoformat() if hasattr(m[c], "isoformat") else m[c] for c in MEMORY}
            was = (s.get("memory") or {}).get("quarantined")
            s["memory"] = {k: v for k, v in told.items() if v not in (None, 0, False, "")}
            record = next(r for r in records if r["source_id"] == s["id"])
            record["memory"] = s["memory"]
            if m["shape_changed"]:
                record["shape_changed"] = "addresses no longer match the pattern learned from earlier runs"
            if m["quarantined"] and not was:
                out.setdefault("newly_quarantined", []).append(s["id"])
        Path(args.book).write_text(json.dumps(book, indent=2) + "\n")
    clean = all(r["status"] == "ok" for r in records)
    return _say(out | {"all_clean": clean}, 0 if clean else 2)


if __name__ == "__main__":
    sys.exit(main())
