"""Scan repair, history, tokens, mixtures and subjects."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import markup
from sluice.llm import content, history, inputs, mixture, queries, residue, scans, subjects, tokens
from sluice.operators.scale import scratch, scratch_path

TEXT = "The committee heard a report on the winter shelter and asked staff to return with costs. Members noted the long-term plan for the harbour crane and the meeting was adjourned. "


def scan_pages(spark):
    words = (TEXT * 40).split()
    clean = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = [(1, "town-one", "clean.pdf", 1, clean, False)]
    for n, name in enumerate(("alpha", "beta", "gamma"), 1):
        body = [f"Paper {name} was read.", f"Next {name} it was.", "The commit-", "tee heard a report on the cornmittee", "and the long-", "term plan.", "", f"Members {name} asked.", f"They n0ted {name} the har¬"]
        if n > 1:
            body[0] = "bour crane. " + body[0]
        lines = [f"Town Board Minutes      - {n} -", "", *body, "", "Prlnted 3.4.2024" if n == 2 else "Printed 3.4.2024"]
        rows.append((10 + n, "town-one", "scan.pdf", n, "\n".join(lines), True))
    rows += [(20, "town-one", "scan.pdf", 9, None, True), (21, None, None, None, "", True), (22, None, None, None, "One line", True)]
    return spark.createDataFrame(rows, "page_id bigint, source_id string, file string, page_no int, page_text string, scanned boolean").withColumn("furniture", F.lit("extra"))


def test_scan_lines(spark):
    lines, brk, fixes = scans.analyse(scan_pages(spark))
    got = {(r.page_id, r.line_no, r.kind) for r in lines.collect()}
    for n in (11, 12, 13):
        assert {g[1:] for g in got if g[0] == n} - {(11, "hyphen")} == {(1, "furniture"), (13, "furniture"), (5, "hyphen"), (6, "misread"), (11, "misread")}
    assert (11, 11, "hyphen") in got and (12, 11, "hyphen") in got and (13, 11, "hyphen") not in got
    assert not [g for g in got if g[0] in (1, 20, 21, 22)]
    assert {r.word: r.right for r in fixes.collect()}["cornmittee"] == "committee"


def test_scan_text(spark):
    got = {r.page_id: r.text for r in scans.repair(scan_pages(spark)).collect()}
    assert got[11] == "Paper alpha was read. Next alpha it was. The committee heard a report on the committee and the long-term plan.\n\nMembers alpha asked. They noted alpha the harbour"
    assert got[12].startswith("crane. Paper beta was read.") and 1 not in got and got[22] == "One line"


def test_headers_a_few_edits_apart(spark):
    heads = ["Harbour Board Minutes of the Year", "Harbour Boord Minutes of the Yaar", "Harbour Board Minuxtes of the Year", "Harbour Board Minutes of the Year", "Quite another line stands here now"]
    rows = [(n, "s", "f.pdf", n, "\n".join([h, *(f"Body {w} number {n} of all." for w in ("one", "two", "three", "four", "five", "six", "seven"))]), True) for n, h in enumerate(heads, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, source_id string, file string, page_no int, page_text string, scanned boolean")
    got = {r.page_id: r.furniture for r in scans.furniture(df).collect()}
    assert [1 in got[n] for n in range(1, 6)] == [True, True, True, True, False]


def test_near_keys_lose_no_pair(spark):
    """Partners that are not the most common key of their beginning or end are met, in small files and by pieces in large ones."""
    r = random.Random(1)
    edit = lambda t, k: t if not k else edit((t[: (i := r.randrange(len(t)))] + r.choice(["", "a", "bc"]) + t[i + r.randrange(2) :]) or "a", k - 1)
    base = ["".join(r.choice("abcd ") for _ in range(n)) for n in (9, 12, 17, 25, 40, 60)]
    bodies = sorted({edit(b, r.randrange(8)) for b in base for _ in range(8)})

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    near = lambda a, b: min(len(a), len(b)) > scans.BAND and apart(a, b) <= scans.edits_allowed(min(len(a), len(b)))
    want = {i for i, a in enumerate(bodies) if any(i != j and near(a, b) for j, b in enumerate(bodies))}
    df = spark.createDataFrame([("f", 0, i, 9 - i % 9, b) for i, b in enumerate(bodies)], "file string, side int, key bigint, n bigint, body string")
    assert len(want) > 10 and all({x.key for x in scans.near_keys(df, small).collect()} == want for small in (300, 5))


def test_very_long_words(spark):
    right = "donau" * 9 + "schiffahrt"
    words = spark.createDataFrame([(right.replace("schiff", "sch1ff"), 1), ("x" * 300, 1)], "word string, n bigint")
    fixes = scans.corrections(words, spark.createDataFrame([(right, 9)], "word string, n bigint")).collect()
    assert [(r.right, r.at) for r in fixes] == [(right, 48)]


def test_scans_of_nothing(spark):
    assert scans.analyse(scan_pages(spark).limit(0))[0].count() == 0


@pytest.mark.parametrize("line, want", [("- 4 -", 4), ("Page 10 of 12", 10), ("xiv", 14), ("[l2]", 12), ("p. 3", 3), ("in 2019.", None), ("mix", None), ("", None)])
def test_page_numbers(line, want):
    assert scans.page_number(line) == want


def html(ps):
    return "<html><body><main><h1>T</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</main></body></html>"


def history_rows():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [" ".join(r.choice(vocabulary) for _ in range(30)) + "." for _ in range(n)]
    rows = []
    for i in range(60):
        rows.append((i, 0, f"https://t.example/d/{i}", text(r.randint(1, 8))))
    for i in range(60, 140):
        old = rows[r.randrange(len(rows))]
        batch = 1 + (i - 60) // 20
        kind = r.randrange(5)
        if kind == 0:
            rows.append((i, batch, old[2].replace("https://", "http://www.") + "?utm_source=x#top", text(3)))
        elif kind == 1:
            rows.append((i, batch, f"https://t.example/n/{i}", old[3]))
        elif kind == 2:  # edits scattered over all paragraphs
            rows.append((i, batch, f"https://t.example/n/{i}", [" ".join("edit" if r.random() < 0.03 else w for w in p.split()) for p in old[3]]))
        elif kind == 3:
            rows.append((i, batch, f"https://t.example/n/{i}", [" ".join("edit" if r.random() < 0.3 else w for w in p.split()) for p in old[3]]))
        else:
            rows.append((i, batch, None if i % 2 else "", text(4)))
    return rows


def brute_history(rows):
    root = {k: k for k, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = history.Words()
    words = {k: [w for p in history.text_words(ps, known) for s in p for w in s] for k, _, _, ps in rows}
    url = lambda u: u and u.replace("http://www.", "https://").split("?")[0]
    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y = words[a[0]], words[b[0]]
            if (url(a[2]) and url(a[2]) == url(b[2])) or history.common_words(x, y) >= 0.9 * max(len(x), len(y)):
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    out = set()
    for k, batch, *_ in rows:
        before = [j for j, b, *_ in rows if b < batch and find(j) == find(k)]
        if batch > 0 and before and min(before) < k:
            out.add((min(before), k))
    return out


def history_frame(spark, rows):
    return spark.createDataFrame([(k, b, u, html(ps), "x") for k, b, u, ps in rows], "fetch_id bigint, batch_no int, source_url string, raw_html string, key string")


def test_history_equals_brute_force(spark):
    rows = history_rows()
    df = history_frame(spark, rows).unionByName(spark.createDataFrame([(900, 2, None, None, "x"), (901, None, "https://t.example/d/1", "", "x")], "fetch_id bigint, batch_no int, source_url string, raw_html string, key string"))
    got = {tuple(r) for r in history.repeated_documents(df, exhaustive=True).collect()}
    assert got == brute_history(rows) and len(got) > 30
    # By paragraphs and neighbouring sentences alone, nothing false is found, and few are missed of texts edited all over (here one sentence is one paragraph).
    named = {tuple(r) for r in history.repeated_documents(df).collect()}
    assert named <= got and len(named) > 0.8 * len(got)
    assert history.repeated_documents(df.limit(0)).count() == 0


def test_texts_with_only_a_common_paragraph_in_common(spark):
    """A paragraph in more texts than ``COMMON_PARAGRAPH`` still leads from a text to its edited copy, in the history and within a batch."""
    r = random.Random(3)
    common = " ".join(f"c{i}" for i in range(30)) + "."
    own = [" ".join(f"w{r.randrange(4000)}" for _ in range(30)) + "." for _ in range(history.COMMON_PARAGRAPH + 10)]
    edit = lambda t: t.replace(t.split()[9], "edited", 1)
    rows = [(i, 0, None, [common, t]) for i, t in enumerate(own[:-1])] + [(100, 1, None, [common, edit(own[7])]), (101, 1, None, [common, own[-1]]), (102, 2, None, [common, edit(own[-1])])]
    got = {tuple(x) for x in history.repeated_documents(history_frame(spark, rows)).collect()}
    assert got == brute_history(rows) == {(7, 100), (101, 102)}


def test_history_batch_by_batch(spark, tmp_path):
    from sluice.functions.canonical import canonical_url

    rows = history_rows()
    df = history_frame(spark, rows)
    got = set()
    for b in range(5):
        store = history.History(spark, str(tmp_path), buckets=8, exhaustive=True)  # found again by its folder
        batch = df.filter(F.col("batch_no") == b)
        mine = batch.select(F.col("fetch_id").alias("id"), F.col("batch_no").alias("batch"), canonical_url("source_url").alias("url_key"))
        texts = scratch(history.own_texts(batch, "fetch_id", "raw_html", exhaustive=True))
        found = store.check(mine, texts)
        got |= {tuple(r) for r in store.repeats(found).collect()}
        store.append(mine, texts, found)
        if b == 2:
            store.compact()
    assert got == brute_history(rows)


def exchanged_scans(plan: str, location: str) -> int:
    """Scans of a table that stand right below a shuffle, filters and projections aside."""
    lines, n = plan.splitlines(), 0
    for k, line in enumerate(lines):
        if "FileScan" in line and location in line:
            above = [l for l in lines[:k] if not any(x in l for x in ("Filter", "Project", "ColumnarToRow"))]
            n += "Exchange" in above[-1]
    return n


def test_a_check_shuffles_no_history(spark, tmp_path):
    store = history.History(spark, str(tmp_path), buckets=4)
    rows = spark.createDataFrame([(i, 0, f"u{i}") for i in range(50)], "id bigint, batch int, url_key string")
    keys = rows.select(F.xxhash64("url_key").alias("key"), F.lit(0).alias("kind"), "id", F.lit(0).alias("n"))
    store._add("keys", keys)
    past = store.table("keys").filter("kind = 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = past.join(keys.select("key", "kind"), ["key", "kind"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "FileScan" in plan and "Bucketed: true" in plan and exchanged_scans(plan, "Bucketed: true") == 0


def test_the_joins_of_a_check_keep_to_the_buckets(spark, tmp_path, monkeypatch):
    store = history.History(spark, str(tmp_path), buckets=4)
    rows = lambda n: spark.createDataFrame([(n + i, n, f"u{i}") for i in range(50)], "id bigint, batch int, url_key string")
    texts = spark.createDataFrame([], "id bigint, " + history.TEXT)
    plans, write = [], history.scratch
    monkeypatch.setattr(history, "scratch", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or write(df))
    monkeypatch.setattr(history, "lookup", lambda df: df)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        store.append(rows(0), texts, store.check(rows(0), texts))
        plans.clear()
        found = store.check(rows(100), texts)
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert {r.id: r.root for r in found.collect()} == {100 + i: i for i in range(50)}
    # What a batch and the history have in common: beneath the joins by key nothing is moved.
    joins = [p for columns, p in plans if "least" in columns and "root" in columns and "new" in columns]
    lines = joins[0].split("\n")
    depth = lambda x: re.search(r"[A-Z]", x).start()
    by_key = [k for k, x in enumerate(lines) if re.search(r"SortMergeJoin \[key", x)]
    assert len(joins) == 1 and len(by_key) == 2
    for k in by_key:
        below = lines[k + 1 : next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(lines[k])), len(lines))]
        assert sum("Bucketed: true" in x for x in below) == 2 and not any("Exchange" in x for x in below)


def test_words_are_looked_into_once(monkeypatch):
    """Of pages that share their words each word is taken apart once, not once for each passage, and passages and texts are those of each page alone."""
    words = (TEXT * 3).split()
    line = lambda k: " ".join(words[k:] + words[:k])
    pages = [markup.blocks(f"<h1>Report {k}</h1>" + "".join(f"<p>{line(k + j)}</p>" for j in range(3)) + "<p>Dear {{name}}, 12 of 345 lines... are here</p>") for k in range(40)]
    looked, take = [], content._WORD.findall
    monkeypatch.setattr(content, "_WORD", type("Pattern", (), {"findall": lambda self, text: looked.append(text) or take(text)})())
    cols, number, paragraphs = residue.passages_of(pages, known := history.Words())
    assert sum(map(len, looked)) < 3 * len(pages[0].blocks[1].text)
    *texts, place = history.sentences(number, paragraphs, known)
    assert place.tolist() == list(range(40))
    rows = history.hashed_rows(*texts)
    for k, page in enumerate(pages):
        own = content.own_blocks(page)
        toks = [[zlib.crc32(w.encode()) % residue.BUCKETS for w in content.tokens(b.text)] for b in page.blocks]
        assert cols[0][k].as_py() == [len(t) for t in toks] and cols[2][k].as_py() == sum(toks, [])
        assert [bool(f & residue.TRUSTED) for f in cols[1][k].as_py()] == [residue.is_trusted(content.tokens(b.text)) for b in page.blocks]
        want = history.text_rows([history.text_words([b.text for b, o in zip(page.blocks, own) if o and b.tag != "h1"], history.Words())])[0]
        assert all(np.array_equal(x, y) for x, y in zip(rows[k], want))


def test_hashes_of_a_batch_are_those_of_each_text():
    r = random.Random(2)
    texts = [[[[r.randrange(1 << 40) for _ in range(r.randint(1, 20))] for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 6))] for _ in range(20)]
    plain = lambda row: [x.tolist() if hasattr(x, "tolist") else x for x in row]
    for whole in (False, True):
        assert [plain(x) for x in history.text_rows(texts, whole)] == [plain(history.text_rows([t], whole)[0]) for t in texts]
    assert history.text_rows([]) == []


def test_parts_lose_no_pair():
    # Of the groups more are untouched than a text leaves out, whatever is edited.
    r = random.Random(8)
    for _ in range(200):
        n = r.randint(10, 300)
        a = [r.randrange(40) for _ in range(n)]
        b = a[:]
        for _ in range(n // 10):
            b[r.randrange(n)] = 100 + r.randrange(40)
        names = [c.split()[0] for c in history.TEXT.split(", ")]
        rows = [dict(zip(names, x)) for x in history.text_rows([[[a]], [[b]]], exhaustive=True)]
        if history.common_words(a, b) < 0.9 * n:
            continue
        kept = []
        for row in rows:
            parts, at = set(), 0
            for m, drop in zip(row["part_n"].tolist(), row["part_drop"].tolist()):
                parts |= set(sorted(row["parts"][at : at + m].tolist())[: m - drop])
                at += m
            kept.append(parts)
        assert kept[0] & kept[1]


def test_common_words():
    r = random.Random(3)
    for _ in range(50):
        a, b = ([r.randrange(5) for _ in range(r.randrange(30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert history.common_words(a, b) == t[-1][-1]


def edited(r, words, subs, inserts, even=False):
    """A copy with words replaced and inserted, at random or evenly spread."""
    n = len(words)
    at = [(2 * k + 1) * n // (2 * subs) for k in range(subs)] if even else r.sample(range(n), subs)
    out = [f"new{r.randrange(10**6)}" if i in at else w for i, w in enumerate(words)]
    for _ in range(inserts):
        out.insert(r.randrange(len(out) + 1), f"more{r.randrange(10**6)}")
    return out


def near_pairs(spark, plans):
    """Pairs found and pairs that are true, of texts and copies as ``(words, substitutions, insertions, even, copies)`` have it."""
    r, texts = random.Random(11), []
    for n, subs, inserts, even, copies in plans:
        for _ in range(copies):
            words = [f"w{r.randrange(5_000)}" for _ in range(n)]
            texts += [words, edited(r, words, subs, inserts, even)]
    pages = spark.createDataFrame([(i, html([" ".join(t) + "."])) for i, t in enumerate(texts)], "id bigint, raw_html string")
    own = scratch(history.own_texts(pages, "id", "raw_html", exhaustive=True))
    assert sorted((r.id, r.n_text) for r in own.collect()) == [(i, len(t)) for i, t in enumerate(texts)]
    rows = pages.select("id", F.lit(0).alias("batch"), F.lit(None).cast("string").alias("url_key"))
    groups = {}
    for r in history.History(spark, scratch_path(spark), buckets=4, exhaustive=True).check(rows, own).collect():
        groups.setdefault(r.root, []).append(r.id)
    found = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    true = {(i, i + 1) for i in range(0, len(texts), 2) if history.common_words(texts[i], texts[i + 1]) >= 0.9 * max(len(texts[i]), len(texts[i + 1]))}
    return found, true


def test_near_texts_around_100_words(spark):
    found, true = near_pairs(spark, [(n, 2, 3, False, 30) for n in (92, 95, 98, 99, 100, 103)])
    assert len(true) == 180 and found == true


@pytest.mark.parametrize("plan", [(30, 2, 0, True, 60), (30, 3, 0, False, 60), (40, 4, 0, False, 60), (60, 6, 0, False, 60), (200, 15, 0, True, 60)])
def test_near_texts_with_spread_edits(spark, plan):
    found, true = near_pairs(spark, [plan])
    assert len(true) == 60 and found == true


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 102)], "a bigint, b bigint")
    got = {r.id: r.root for r in history.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_tokens_equal_the_reference_encoder(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in inputs.table(spark, data, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, data).collect()}
    assert got == {k: t.encode(v, add_special_tokens=False).ids if v else [] for k, v in texts.items()}
    e = tokens.ForcedBoundaryEncoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", remember=50)
    r = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", " ", "é", "ж", "'s", "'", "!", "1", "\r\n", "　", "日", "😀", "\x00", "<|endoftext|>", "​"]
    for _ in range(3_000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert e.encode(s) == t.encode(s, add_special_tokens=False).ids
    assert e.encode("x" * 200_000)[:2] and len(e.known) <= 50


def test_tokens_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "hi there", 5), (2, "", 5)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, len(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect()), key=str)
    assert got == [(1, 0), (2, 0), (2, 0), (None, 2)]
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def mix(spark, docs, goals, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text_hash bigint, source string, n_tokens bigint").withColumn("j", F.lit(1)).withColumn("uses", F.lit(9))
    g = spark.createDataFrame(goals, "source string, target_share double, max_repeats int")
    m, s = mixture.mixture(d, g, **kw)
    return m.collect(), {r.source: r for r in s.collect()}


def test_mixture_shares_and_caps(spark):
    docs = [(i, i, "a", 100) for i in range(300)] + [(1000 + i, 1000 + i, "b", 100) for i in range(30)] + [(2000 + i, 2000 + i, "c", 50) for i in range(200)]
    got, shares = mix(spark, docs, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)])
    assert max(r.uses for r in got if r.source == "b") == 3 and max(r.uses for r in got if r.source == "a") == 1
    for s in shares.values():
        assert abs(s.actual_share - s.target_share) < 0.02
    assert sum(r.uses * r.n_tokens for r in got if r.source == "b") == shares["b"].mix_tokens == 9_000


def test_mixture_of_overlapping_sources(spark):
    # Texts in both sources can serve either, but none more often than allowed.
    docs = [(i, i, s, 100) for i in range(50) for s in ("a", "b")] + [(100 + i, 100 + i, "a", 100) for i in range(50)]
    got, shares = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert Counter(r.source for r in got) == {"a": 50, "b": 50}
    assert max(Counter(r.doc_id for r in got).values()) == 1


def test_mixture_odd_rows(spark):
    docs = [(1, 1, "a", 0), (2, None, "a", 10), (3, 3, None, 10), (4, 4, "z", 10), (5, 5, "a", 10), (6, 5, "a", 10)]
    got, shares = mix(spark, docs, [("a", 1.0, 2), ("a", 1.0, 2), ("n", 0.0, 2), (None, 0.3, 2)])
    assert {r.doc_id for r in got} <= {2, 5} and shares["a"].actual_share == 1.0
    got, shares = mix(spark, docs, [])
    assert got == [] and shares == {}
    got, shares = mix(spark, docs, [("a", 0.5, 2), ("none", 0.5, 2)], total=100)
    assert shares["none"].mix_tokens == 0 and shares["a"].mix_tokens > 0


def test_mixture_with_empty_and_tiny_sources(spark):
    docs = [(i, i, "a", 100) for i in range(300)]
    got, shares = mix(spark, docs, [("a", 0.5, 2), ("none", 0.5, 2)])
    assert shares["none"].mix_tokens == 0 and 59_000 < shares["a"].mix_tokens <= 60_000
    got, shares = mix(spark, [*docs, (900, 900, "tiny", 10)], [("a", 0.5, 1), ("tiny", 0.3, 2), ("none", 0.2, 2)])
    assert shares["tiny"].mix_tokens == 20 and shares["none"].mix_tokens == 0 and 7_000 < shares["a"].mix_tokens < 8_000
    assert {r.uses for r in got if r.source == "tiny"} == {2} and shares["a"].actual_share > 0.99


def test_flow_costs():
    # Two patterns, one source: the second use of either comes after the first of both.
    flow = mixture.route([(1, 10), (3, 10)], [(0.5, 3), (0.5, 1)], 40)
    assert sum(f for (m, j), f in flow.items() if j == 0) == 20 and sum(f for (m, j), f in flow.items() if j == 1) == 10


def test_flow_at_its_limits():
    import time

    r = random.Random(4)
    masks = set()
    while len(masks) < mixture.MAX_PATTERNS:
        masks.add(sum(1 << j for j in r.sample(range(mixture.MAX_TARGETS), r.randint(1, 12))))
    patterns = [(m, r.randint(10**6, 10**9)) for m in sorted(masks)]
    targets = [(1 / mixture.MAX_TARGETS, r.randint(1, 4)) for _ in range(mixture.MAX_TARGETS)]
    total = sum(n for _, n in patterns)
    began = time.perf_counter()
    flow = mixture.route(patterns, targets, total)
    assert time.perf_counter() - began < 60
    into = Counter()
    for (_, j), f in flow.items():
        into[j] += f
    assert all(v <= round(total / mixture.MAX_TARGETS) for v in into.values()) and sum(into.values()) > 0.99 * total


def test_flow_is_of_least_cost():
    # Against all ways of sending whole units through small random networks.
    r = random.Random(6)
    for _ in range(60):
        arcs = [(a, b, r.randint(0, 2), r.randint(0, 3)) for a, b in ((0, 1), (0, 2), (1, 2), (2, 1), (1, 3), (2, 3))]
        best = max(
            ((x[0] + x[1], -sum(f * a[3] for f, a in zip(x, arcs))) for x in __import__("itertools").product(*(range(a[2] + 1) for a in arcs)) if x[0] + x[3] == x[2] + x[4] and x[1] + x[2] == x[3] + x[5]),
        )
        f = mixture.min_cost_flow(4, arcs, 0, 3)
        assert (f[0] + f[1], -sum(x * a[3] for x, a in zip(f, arcs))) == best


def labelled(spark, n=240, seed=5):
    r = random.Random(seed)
    terms = {"law": ["witness summons", "appeal hearing", "court ruling"], "sport": ["football pitch", "rowing club", "match day"], "health": ["dental unit", "ward beds", "vaccine stock"]}
    plain = ["The clerk read the notices into the record.", "The minutes were approved without change.", "The next session is planned for May.", "The vote was taken and the session closed."]
    about = ["Spending on the {} rose again.", "A contract for the {} was awarded.", "The board noted letters about the {}.", "Staff asked about the {} near the river."]
    docs, labels = [], []
    for i in range(n):
        mine = r.sample(sorted(terms), r.choice([1, 1, 2]))
        s = [r.choice(plain) for _ in range(5)] + [r.choice(about).format(r.choice(terms[m])) for m in mine for _ in range(4)]
        r.shuffle(s)
        docs.append((i, " ".join(s)))
        labels += [(i, m) for m in mine]
    docs += [(1_000, " ".join(plain * 2)), (1_001, None), (1_002, ""), (1_003, "5. -")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("share", F.lit(1)).withColumn("subjects", F.lit("x"))
    l = spark.createDataFrame(labels + labels[:5] + [(None, "law"), (3, None), (4, "unknown")], "doc_id bigint, subject string")
    return d, l, spark.createDataFrame([(s,) for s in terms] + [(None,)], "subject string"), {(a, b) for a, b in labels}


def test_subjects_held_out(spark):
    docs, labels, subs, truth = labelled(spark)
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(docs, labels.filter("doc_id < 160"), subs).collect()}
    held = {t for t in truth if t[0] >= 160}
    found = {g for g in got if 160 <= g[0] < 1_000}
    assert len(held & found) / len(held) > 0.9 and len(held & found) / len(found) > 0.9
    assert not {g for g in got if g[0] >= 1_000}


def test_subjects_without_labels(spark):
    docs, labels, subs, _ = labelled(spark, 10)
    assert subjects.subjects_of(docs, labels.limit(0), subs).count() == 0
    assert subjects.subjects_of(docs, labels, subs.limit(0)).count() == 0


def test_gradient():
    documents, labels = [["a", "b", "a b"], ["c"], ["b", "c"]], np.array([[1, 0], [0, 1], [1, 1]])
    row = {f: k for k, f in enumerate(sorted({f for d in documents for w in d for f in subjects.word_features(w)}))}
    shard = subjects.Shard(documents, labels, row)
    e, w, b = (x.astype(np.float64) for x in subjects.start_model(2))
    e = e[: len(row)]

    def loss(e):
        v = np.add.reduceat(e[shard.feat], shard.feat_start) / shard.k[:, None]
        h = np.add.reduceat(v[shard.tok], shard.start) / shard.n[:, None]
        p = 1 / (1 + np.exp(-(h @ w + b)))
        return -(shard.y * np.log(p) + (1 - shard.y) * np.log(1 - p)).sum()

    de = shard.gradient(e, w, b)[0]
    for k in (0, 3):
        up = e.copy()
        up[k, 2] += 1e-5
        assert abs((loss(up) - loss(e)) / 1e-5 - de[k, 2]) < 1e-4
    # Gradients of shards add up to that of the whole.
    parts = [subjects.Shard(documents[a:b_], labels[a:b_], row).gradient(e, w, b) for a, b_ in ((0, 1), (1, 3))]
    for x, y, z in zip(shard.gradient(e, w, b), *parts):
        assert np.allclose(x, y + z)


def test_named_queries(spark, data):
    columns = {"p5_found": ["page_id", "line_no", "kind"], "p6_found": ["first_id", "dup_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"]}
    for name, want in columns.items():
        df = queries.queries()[name](spark, data)
        assert df.columns == want
        rows = [str(r) for r in df.collect()]
        assert len(rows) == len(set(rows))
