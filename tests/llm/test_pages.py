"""Residue, repeated lines, main content and splitting."""

import random
from collections import Counter, defaultdict

import pytest

from sluice.functions.markup import blocks, visible_text
from sluice.llm import chunking, content, inputs, queries, repeats, residue
from sluice.operators.scale import scratch

OWN = [f"The board noted {i} letters about the river bank. Spending on the reserve fund rose by {i} percent during 2020." for i in range(3, 9)]


def page(paragraphs, tag="p", around=True):
    body = "".join(f"<{tag}>{p}</{tag}>" for p in paragraphs)
    if not around:
        return f"<html><body><main><h1>Reports A11-222</h1>{body}</main></body></html>"
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Minutes", "Agendas", "Forms", "Contact"))
    teaser = "<h3>Most viewed</h3><p><a href='/x'>The chair declared no interest in any item.</a></p><p>A motion to defer the tree canopy failed by 3 votes.</p>"
    foot = "<p>&copy; 2022 Town. The text shown here has no binding force.</p><p>We use cookies to count visits. Choose accept or refuse.</p><p>Office hours Monday to Thursday</p>"
    return f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><div class='c1'><h1>Reports A11-222</h1>{body}<p>Published by the web team 2023-10-15, read 12 times</p></div><div class='c2'>{teaser}</div><div class='c3'>{foot}</div></body></html>"


def test_main_content_of_a_page():
    own = content.own_blocks(p := blocks(page(OWN)))
    assert [b.text for b, o in zip(p.blocks, own) if o and b.p_no] == OWN


def test_tree_separates_its_table():
    from sluice.llm.labelled import ROWS

    rows = [[float(x) for x in r.split()] for r in ROWS.strip().splitlines()]
    assert all(len(r) == len(content.FEATURES) + 1 for r in rows) and len(rows) < 200
    assert sum((content.judge(content.tree(), r) > 0.5) != (r[-1] > 0.5) for r in rows) <= 8


def residue_pages(spark):
    lorem = "Lorem ipsum dolor sit amet, consectetur adipiscing elit tempor"
    bad = {
        100: page(["404 - not found", "The page you asked for does not exist or has moved.", "Check the address for typing errors"]),
        101: page(["Notice from {{ board_name }} about {{ venue }}.", "Offers for XXXXX close at XXXXX."], around=False),
        102: page([lorem, lorem + " aliqua"], tag="div", around=False),
        103: page(["You need to enable scripting to run this app."]),
        104: page(["Access denied", "The page you asked for does not exist or has moved."], tag="li", around=False),
    }
    good = {i: page(random.Random(i).sample(OWN, 3)) for i in range(40)}
    good[50] = page([OWN[0] + " Members asked why the portal said access denied on 22 days.", *OWN[1:3]])
    good[51] = page([*OWN[:3], "404 - not found"])
    good[52] = page(["Minutes of {{date}} templates will be retired by May. " + OWN[1], OWN[2]])
    rows = list((bad | good).items()) + [(60, None), (61, ""), (62, "<html><body></body></html>")]
    return spark.createDataFrame([(k, h, 1, "x", None) for k, h in rows], "fetch_id bigint, raw_html string, n_words int, toks string, flags int"), set(bad), set(good)


def test_residue(spark):
    df, bad, good = residue_pages(spark)
    got = {r.fetch_id: r for r in residue.residue(df).collect()}
    assert set(got) == bad | good | {62}
    assert {k for k, r in got.items() if r.is_residue} == bad
    assert got[62].n_passages == 0 and not got[62].is_residue


def test_residue_of_nothing(spark):
    df = residue_pages(spark)[0]
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.residue(df.filter("fetch_id < 10")).filter("is_residue").count() == 0


def test_residue_of_kinds_without_a_neighbour(spark):
    """Messages, notices and filler of a kind that no other page of the corpus shares words with; a title alone is no residue."""
    bad = {
        100: ["Scripts are required to show this content.", "Use a newer browser and come back."],
        101: ["Texte d'exemple pour la page.", "Le texte viendra ici.", "Saisissez un titre."],
        102: ["Sesión caducada", "Pruebe de nuevo más tarde."],
        103: ["Sitzung abgelaufen", "Sie haben keine Berechtigung."],
        104: ["Dummy entry, please ignore.", "Body text goes here."],
    }
    rows = [(k, page(v)) for k, v in bad.items()] + [(i, page(random.Random(i).sample(OWN, 3))) for i in range(20)] + [(200, page([]))]
    got = residue.residue(spark.createDataFrame(rows, "fetch_id bigint, raw_html string")).filter("is_residue").collect()
    assert {r.fetch_id for r in got} == set(bad)


def brute_lines(pages):
    docs, seen = Counter(), defaultdict(set)
    for source, key, html in pages:
        if source is not None and html:
            docs[source] += 1
            for b in blocks(html).blocks:
                line = repeats.normal_line(b.text)
                if sum(c.isalpha() for c in line) >= 3:
                    seen[source, line].add(key)
    return {(s, l, len(k)) for (s, l), k in seen.items() if len(k) >= 5 and 5 * len(k) >= docs[s]}


def test_repeated_lines_equal_brute_force(spark, data):
    pages = inputs.pages_of_sources(spark, data)
    lines = scratch(repeats.page_lines(pages, "source_id", "fetch_id", "raw_html"))
    got = {(r.source_id, r.line, r.n_docs) for r in repeats.repeated_lines(lines, "source_id", "fetch_id").collect()}
    assert got == brute_lines([tuple(r) for r in pages.collect()]) and got


def test_repeated_lines_small(spark):
    r = random.Random(4)
    rows = []
    for i in range(30):
        body = ["Unique text " + "".join(r.choice("abcdefghij") for _ in range(20)) + " here", "Share this page", "ab", "12", f"Line {i % 3} of many"] + ["A very long legal notice that goes on and on, " * 8] * 2
        r.shuffle(body)
        rows.append(("s", i, "".join(f"<p>{b}</p>" for b in body)))
    rows += [("t", 100 + i, "<p>Share this page</p>") for i in range(4)] + [("u", 200, None), (None, 201, "<p>x</p>"), ("u", 202, "")]
    df = spark.createDataFrame(rows, "source_id string, fetch_id int, raw_html string")
    lines = scratch(repeats.page_lines(df, "source_id", "fetch_id", "raw_html"))
    found = repeats.repeated_lines(lines, "source_id", "fetch_id")
    assert {(x.source_id, x.line, x.n_docs) for x in found.collect()} == brute_lines(rows)
    kept = {x.fetch_id: x for x in repeats.without_repeated(lines, found, "source_id", "fetch_id").collect()}
    assert kept[0].text.count("\n") == 2 and "Unique" in kept[0].text and kept[100].text == "Share this page" and kept[100].n_cut == 0
    assert repeats.repeated_lines(lines.limit(0), "source_id", "fetch_id").count() == 0


def test_chunks_depend_on_the_line_alone():
    lines = ["Share this page by mail, feed or message", "x" * 500, "", "é" * 90, "Share this page by mail, feed or message"]
    a, b = chunking.line_chunks(lines), chunking.line_chunks(list(reversed(lines)))
    assert a == list(reversed(b)) and a[0] == a[4] and a[2] == [] and len(a[1]) >= 1
    assert chunking.line_chunks([]) == []


@pytest.mark.parametrize("text", ["", "short", "word " * 5_000, "x" * 30_000, "Sentence one is here. " * 1_500, "line of text\n" * 3_000, "é\n" * 20_000])
def test_split_round_trip(text):
    pieces = chunking.split_text(text, 3_000, 150)
    assert "".join(text[f:e] for _, f, e in pieces) == text and pieces[-1][2] == len(text)
    assert all(e - s <= 3_000 for s, _, e in pieces)
    assert all(f - s == 150 for s, f, _ in pieces[1:] if f >= 150)
    for _, _, e in pieces[:-1]:
        assert text[e - 1] in " \n" or " " not in text[max(0, e - 1_000) : e]


def test_an_edit_alters_only_neighbouring_pieces():
    r = random.Random(9)
    text = "".join(" ".join(f"w{r.randrange(999)}" for _ in range(12)) + ".\n" for _ in range(3_000))
    new = lambda t: {t[f:e] for _, f, e in chunking.split_text(t, 3_000, 100)}
    edited = text[:20_000] + "INSERTED WORDS " + text[20_000:]
    assert len(new(edited) - new(text)) <= 6


def test_split_frame(spark):
    df = spark.createDataFrame([(1, "a " * 9_000, "p"), (2, None, "p"), (3, "", "p"), (1, "b", "p")], "id bigint, text string, piece string")
    got = [(r.id, r.piece_no, r.n_pieces, len(r.piece)) for r in chunking.split(df, "id", "text", 10_000, 100).collect()]
    assert sorted(got)[:2] == [(1, 1, 1, 1), (1, 1, 2, sorted(got)[1][3])] and (3, 1, 1, 0) in got and len(got) == 4
    with pytest.raises(ValueError):
        chunking.cut_points("x", 10, 10)


def test_found_queries(spark, data):
    long = {r.fetch_id for r in inputs.fetched(spark, data, "raw_html").collect() if len(visible_text(r.raw_html)) > 12_000}
    assert {r.fetch_id for r in queries.p4_found(spark, data).collect()} == long
    p1 = [r.fetch_id for r in queries.p1_found(spark, data).collect()]
    p3 = [tuple(r) for r in queries.p3_found(spark, data).collect()]
    assert len(p1) == len(set(p1)) and len(p3) == len(set(p3)) > 0 and not {k for k, _ in p3} & set(p1)
