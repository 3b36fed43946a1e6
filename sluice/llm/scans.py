"""Noise in text from scanned pages: running headers, page numbers, broken words, misread characters.

Lines at page edges are compared by a key in which characters that scanners confuse are one class,
first within a file, then across files; within a file keys a few edits apart count as one too.
Words are judged by a vocabulary counted over the whole corpus: a break is joined as the
vocabulary says, a word unknown to clean pages is misread if a confusable form is far more common.
All groupings are by file and key, by word or by page: no file is ever gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.scale import lookup, scratch

#: Pairs that scanners confuse (read, printed), in lower case; fixed values.
CONFUSED = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("q", "g"),
    ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"), ("y", "v"), ("v", "y"), ("ii", "u"), ("u", "ii"), ("ii", "n"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"),
    ("li", "h"), ("h", "li"), ("iii", "m"), ("m", "nn"), ("nn", "m"), ("ri", "n"), ("n", "ri"), ("c", "o"), ("o", "c"), ("a", "o"), ("o", "a"), ("u", "a"), ("a", "u"), ("2", "z"), ("4", "a"), ("$", "s"), ("|", "l"),
]
#: Characters of one class for the keys of edge lines, after the pairs of letters are one letter.
_PAIRS = [("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("li", "h")]
_CLASS = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "8": "b", "9": "g", "6": "b", "q": "g", "e": "c", "f": "t", "h": "b"})
_ROMAN = re.compile(r"[ivxl]{1,6}")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_BREAK = re.compile(r"([^\W_]+(?:[-'’][^\W_]+)*)[-¬­]\s*$")
_NUMERIC = re.compile(r"[\dlIoO.,:/-]*\d[\dlIoO.,:/-]*$")
_NUMBER = re.compile(r"(?i)^[-–—\s\[(]*(?:page|p\.|pag\.|seite|s\.|página|pág\.|n[°o.])?\s*([0-9loi]{1,5}|[ivxl]{1,7})(?:\s*(?:of|de|von|sur|/)\s*[0-9lo]{1,5})?[-–—\s\])]*$")
_PART = re.compile(r"\s{3,}|\s\|\s")
EDGE = 3
#: Edge lines of a file are one line if the edit distance of their keys is within this part of the shorter one's length; keys of up to ``BAND`` characters have no edit to spare.
BAND, EDITS = 8, 0.12
#: So many keys of a file and side are compared all with all; more are first looked up by their pieces.
SMALL = 300


def _roman(s: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50}
    total = 0
    for a, b in zip(s, s[1:] + " "):
        v = values[a]
        total += -v if values.get(b, 0) > v else v
    return total if s and total > 0 else None


def page_number(line: str) -> int | None:
    """The number if the line is written like a page number, arabic or roman, else none."""
    m = _NUMBER.match(line.strip().lower())
    if not m:
        return None
    s = m[1]
    if any(c.isdigit() for c in s):
        return int(s.translate(str.maketrans("loi", "101")))
    if s in ("l", "o"):
        return 1 if s == "l" else None
    return _roman(s.replace("l", "i")) if _ROMAN.fullmatch(s) else None


def fold(line: str, names: frozenset[str] = frozenset()) -> str:
    """Key of a line: equal for lines that differ by confusable characters or numbers; ``names`` become one mark."""
    out = []
    for w in line.lower().split():
        digits = sum(c.isdigit() for c in w)
        if digits * 2 > sum(c.isalnum() for c in w) or (digits and w[0].isalpha() and len(w) > 4 and w[1:3].isdigit()):
            w = "0"
        else:
            for a, b in _PAIRS:
                w = w.replace(a, b)
            w = w.translate(_CLASS)
            if names and w.strip(",.;:") in names:
                w = "\x00"
        out.append(w)
    return " ".join(out)


def _names(source: str | None) -> frozenset[str]:
    return frozenset(fold(w) for w in re.split(r"[-\s]+", source.lower()) if len(w) > 2) if source else frozenset()


def _long(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def edge_lines(text: str) -> list[tuple[int, int, int, str]]:
    """``(side, depth, line_no, line)`` of the first and last lines that are not blank; side 0 is the top."""
    lines = [(k, l) for k, l in enumerate(text.split("\n"), 1) if l.strip()]
    top = [(0, d, k, l) for d, (k, l) in enumerate(lines[:EDGE])]
    return top + [(1, d, k, l) for d, (k, l) in enumerate(reversed(lines[-EDGE:]))]


def _edges(df: DataFrame) -> DataFrame:
    """For each scanned page its edge lines with keys, and the keys of its inner lines."""
    edge = pa.struct([("side", pa.int32()), ("depth", pa.int32()), ("line_no", pa.int32()), ("key", pa.int64()), ("body", pa.string()), ("wide", pa.int64()), ("shift", pa.int32()), ("bare", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files, numbers, sources, texts = (c.to_pylist() for c in batch.columns)
            edges, inner = [], []
            for file, no, source, text in zip(files, numbers, sources, texts):
                names, mine, ends = _names(source), [], set()
                for side, depth, line_no, line in edge_lines(text):
                    ends.add(line_no)
                    parts = _PART.split(line.strip())
                    found = [(page_number(p), p) for p in parts]
                    body = " ".join(p for n, p in found if n is None)
                    shifts = [n - no for n, _ in found if n is not None and no is not None]
                    mine.append({
                        "side": side, "depth": depth, "line_no": line_no, "key": _long(folded := fold(body)) if body else None, "body": folded if body else None, "wide": _long(fold(body, names)) if body else None,
                        "shift": shifts[0] if shifts else None, "bare": not body,
                    })
                edges.append(mine)
                inner.append([_long(fold(l, names)) for k, l in enumerate(text.split("\n"), 1) if l.strip() and k not in ends])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edges, pa.list_(edge)), pa.array(inner, pa.list_(pa.int64()))], ["page_id", "file", "edges", "inner"])

    return df.select("page_id", "file", "page_no", "source_id", "page_text").mapInArrow(
        run, "page_id bigint, file string, edges array<struct<side:int,depth:int,line_no:int,key:bigint,body:string,wide:bigint,shift:int,bare:boolean>>, inner array<bigint>"
    )


def edits_allowed(length: int) -> int:
    """Edits within which keys are one, if the shorter has this length."""
    return max(1, int(length * EDITS))


def _cuts(length: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a key, one more than edits are allowed, so that one of them is unchanged in every near key."""
    n = edits_allowed(length) + 1
    at = [i * length // n for i in range(n + 1)]
    return [(p, q - p) for p, q in zip(at, at[1:])]


def pieces(body: str) -> list[tuple[int, int, int]]:
    """``length, number, hash`` of the pieces of a key."""
    return [(len(body), i, _long(body[p : p + n])) for i, (p, n) in enumerate(_cuts(len(body)))]


def probes(body: str) -> set[tuple[int, int, int]]:
    """The ``pieces`` that a near key that is not longer can share with this one.

    Of a pair's unchanged pieces one has at most as many edits before it as pieces, and at most as many behind it (Li and others, Pass-Join): only those places are read.
    """
    found = set()
    for length in range(BAND + 1, len(body) + 1):
        more, most = len(body) - length, edits_allowed(length)
        if more <= most:
            for i, (p, n) in enumerate(_cuts(length)):
                low, high = max(0, p - i, p + more - (most - i)), min(len(body) - n, p + i, p + more + most - i)
                found.update((length, i, _long(body[q : q + n])) for q in range(low, high + 1))
    return found


def _cut(keys: DataFrame, how) -> DataFrame:
    """``file, side, key, body`` and a row for each of what ``how`` makes of a body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(k, *x) for k, b in enumerate(part.column(3).to_pylist()) for x in how(b)]
                of, *cols = list(zip(*rows)) or [()] * 4
                types = [pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(of, pa.int32())).columns, *(pa.array(c, t) for c, t in zip(cols, types))], ["file", "side", "key", "body", "length", "piece", "hash"])

    return keys.select("file", "side", "key", "body").mapInArrow(run, "file string, side int, key bigint, body string, length int, piece int, hash bigint")


def near_keys(keys: DataFrame, small: int = SMALL) -> DataFrame:
    """``file, side, key`` of the keys (``file, side, key, n, body``, each once) that have another one of their file and side within ``EDITS``.

    Up to ``small`` keys of a file and side are held against each other. Of more, keys are first held against the most common one that begins or ends
    alike; those still without a partner meet every key that has one of their pieces where it can be. No pair is lost either way.
    """
    k = keys.filter(F.length("body") > BAND)
    many = lookup(k.groupBy("file", "side").count().filter(F.col("count") > small).select("file", "side"))
    short = F.least(F.length("x.body"), F.length("y.body"))
    most = F.greatest(F.lit(1), F.floor(short * EDITS)).cast("int")
    near = (F.abs(F.length("x.body") - F.length("y.body")) <= most) & (F.levenshtein("x.body", "y.body") <= most)
    both = F.explode(F.array("x.key", "y.key")).alias("key")

    def pairs(x: DataFrame, y: DataFrame, by: list[str], apart) -> DataFrame:
        return x.alias("x").join(y.alias("y"), by).filter(apart).filter(near).select("file", "side", both)

    few = k.join(many, ["file", "side"], "left_anti").select("file", "side", "key", "body")
    found = pairs(few, few, ["file", "side"], F.col("x.key") < F.col("y.key"))
    large = scratch(k.join(many, ["file", "side"], "left_semi"))
    if large.isEmpty():
        return found.distinct()
    bands = large.select("file", "side", "key", "n", "body", F.explode(F.array(F.concat(F.lit("<"), F.substring("body", 1, BAND)), F.concat(F.lit(">"), F.expr(f"right(body, {BAND})")))).alias("band"))
    top = bands.groupBy("file", "side", "band").agg(F.max(F.struct("n", "key", "body")).alias("top")).select("file", "side", "band", "top.key", "top.body")
    easy = scratch(pairs(bands, top, ["file", "side", "band"], F.col("x.key") != F.col("y.key")).distinct())
    rest = scratch(large.join(easy, ["file", "side", "key"], "left_anti"))
    by = ["file", "side", "length", "piece", "hash"]
    apart = F.col("x.key") != F.col("y.key")
    hard = pairs(_cut(rest, pieces), _cut(large, probes), by, apart).unionByName(pairs(_cut(large, pieces), _cut(rest, probes), by, apart))
    return found.unionByName(easy).unionByName(hard).distinct()


def furniture(scanned: DataFrame) -> DataFrame:
    """``page_id, furniture``: numbers of the lines of each scanned page that are headers, footers or page numbers.

    An edge line is furniture if its key, or one within ``EDITS`` of it, stands at the same edge of another page of the file, or if it stands at
    edges in three files and hardly ever inside pages, or if it is a page number in step with
    the file's page numbers; lines further in count only behind furniture.
    """
    table = scratch(_edges(scanned))
    e = table.select("page_id", "file", F.explode("edges").alias("e")).select("page_id", "file", "e.*")
    # A page with few lines has a line at both edges; it counts once for each.
    keys = scratch(e.filter("key is not null").groupBy("file", "side", "key").agg(F.count("*").alias("n"), F.first("body").alias("body")))
    in_file = keys.filter("n > 1").select("file", "side", "key").unionByName(near_keys(keys)).distinct().withColumn("in_file", F.lit(2))
    step = e.filter("shift is not null").groupBy("file", "shift").agg(F.countDistinct("page_id").alias("in_step"))
    at_edge = e.filter("wide is not null").select("file", "wide").distinct().groupBy("wide").agg(F.count("*").alias("files")).filter("files >= 3")
    inside = table.select(F.explode("inner").alias("wide")).join(lookup(at_edge.select("wide")), "wide", "left_semi").groupBy("wide").agg(F.count("*").alias("inside"))
    common = at_edge.join(inside, "wide", "left").filter("coalesce(inside, 0) * 10 <= files").select("wide", F.lit(True).alias("common"))
    judged = (
        e.join(in_file, ["file", "side", "key"], "left").join(step, ["file", "shift"], "left").join(lookup(common), "wide", "left")
        .withColumn("body_ok", F.col("bare") | F.col("in_file").isNotNull() | F.col("common").isNotNull())
        .withColumn("number_ok", F.col("shift").isNull() | (F.col("shift") == 0) | (F.col("in_step") > 1))
        .withColumn("ok", F.col("body_ok") & F.when(F.col("bare"), F.col("number_ok")).otherwise(F.lit(True)) | (F.col("shift") == 0) & ~F.col("bare") & F.col("body_ok"))
    )
    per = judged.groupBy("page_id").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("side") == s, F.struct("depth", "line_no", "ok")))).alias(n) for s, n in ((0, "top"), (1, "bottom")))
    )
    # Only an unbroken run of furniture from the edge inwards.
    run = lambda c: f"transform(filter({c}, (x, i) -> forall(slice({c}, 1, i + 1), y -> y.ok)), x -> x.line_no)"
    return per.select("page_id", F.expr(f"array_distinct(concat({run('top')}, {run('bottom')}))").alias("furniture"))


def _content(df: DataFrame) -> DataFrame:
    """Words, breaks and first word of each page's content lines."""
    line = pa.struct([("line_no", pa.int32()), ("words", pa.list_(pa.string()))])
    brk = pa.struct([("line_no", pa.int32()), ("left", pa.string()), ("next_line", pa.int32()), ("right", pa.string())])
    head = pa.struct([("line_no", pa.int32()), ("word", pa.string())])

    def page(text: str, out: list[int] | None):
        skip = set(out or ())
        rows = [(k, l) for k, l in enumerate(text.split("\n"), 1) if l.strip() and k not in skip]
        words, breaks, first = [], [], None
        carried = False
        for at, (k, l) in enumerate(rows):
            m = _BREAK.search(l)
            ws = _WORD.findall(l[: m.start(1)] if m else l)
            start = _WORD.match(l.lstrip())
            if at == 0:
                first = {"line_no": k, "word": start[0]} if start else None
                carried = bool(start)
            if carried:
                ws = ws[1:]
            carried = False
            if m:
                following = rows[at + 1] if at + 1 < len(rows) else None
                start = _WORD.match(following[1].lstrip()) if following else None
                if start:
                    whole = _BREAK.search(following[1])
                    # A word that goes on over a third line is joined piece by piece.
                    right = start[0]
                    carried = not (whole and whole.start(1) <= len(following[1]) - len(following[1].lstrip()))
                    breaks.append({"line_no": k, "left": m[1], "next_line": following[0], "right": right})
                elif not following:
                    breaks.append({"line_no": k, "left": m[1], "next_line": None, "right": None})
            words.append({"line_no": k, "words": [w.lower() for w in ws]})
        return words, breaks, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files, nos, scanned, texts, outs = batch.columns
            cols = list(zip(*(page(t, o) for t, o in zip(texts.to_pylist(), outs.to_pylist())))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [ids, files, nos, scanned, pa.array(cols[0], pa.list_(line)), pa.array(cols[1], pa.list_(brk)), pa.array(cols[2], head)],
                ["page_id", "file", "page_no", "scanned", "words", "breaks", "head"],
            )

    return df.select("page_id", "file", "page_no", "scanned", "page_text", "furniture").mapInArrow(
        run,
        "page_id bigint, file string, page_no int, scanned boolean, words array<struct<line_no:int,words:array<string>>>, "
        "breaks array<struct<line_no:int,left:string,next_line:int,right:string>>, head struct<line_no:int,word:string>",
    )


def variants(word: str) -> dict[str, int]:
    """Forms of a word with one confusable place read otherwise, and that place; with digits in the word, up to two places."""

    def once(w: str, least: int = 0) -> dict[str, int]:
        out: dict[str, int] = {}
        for a, b in CONFUSED:
            at = w.find(a, least)
            while at >= 0:
                out.setdefault(w[:at] + b + w[at + len(a) :], at)
                at = w.find(a, at + 1)
        return out

    found = once(word)
    if any(c.isdigit() for c in word):
        for f, at in list(found.items()):
            for g in once(f, at + 1):
                found.setdefault(g, at)
    found.pop(word, None)
    return found


#: Words up to this length are read otherwise one confusable place after the other; longer ones are compared by key.
LONG = 40


def folded(df: DataFrame, word: str, n: str) -> DataFrame:
    """``word, n, _key``: words with the key that confusable ones share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_long(fold(w)) for w in batch.column(0).to_pylist()], pa.int64())], [word, n, "_key"])

    return df.select(word, n).mapInArrow(run, f"{word} string, {n} bigint, _key bigint")


def first_difference(a: str, b: str):
    """Place at which two words begin to differ."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b))), lambda k: F.substr(F.col(a), k, F.lit(1)) != F.substr(F.col(b), k, F.lit(1)))
    return (F.array_position(same, True) - 1).cast("int")


def _is_word(column: str):
    return ~F.col(column).rlike(r"^[\d.,:/'’-]+$") & ~F.col(column).rlike(r"^\p{L}?\d+-\d+$") & F.col(column).rlike(r"\p{L}")


def corrections(words: DataFrame, vocabulary: DataFrame, factor: int = 3) -> DataFrame:
    """``word, right, at``: words that no clean page has, the confusable form that is far more common, and where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = [(w, n, v, i) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for v, i in variants(w).items()]
                cols = list(zip(*rows)) or [()] * 4
                types = [pa.string(), pa.int64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["word", "n", "form", "at"])

    forms = words.filter(F.length("word") <= LONG).mapInArrow(run, "word string, n bigint, form string, at int")
    known = vocabulary.select(F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = forms.join(known, "form")
    # Very long words have too many forms to list; they meet right ones of the same key instead.
    long = folded(words.filter(F.length("word") > LONG), "word", "n").join(folded(known.filter(F.length("form") > LONG - 10), "form", "form_n"), "_key").filter("word != form")
    best = best.select("word", "n", "form", "form_n", "at").unionByName(long.select("word", "n", "form", "form_n", first_difference("word", "form").alias("at")))
    best = best.filter(F.col("form_n") >= factor * F.col("n") + 2)
    return best.groupBy("word").agg(F.max(F.struct("form_n", F.col("form").alias("right"), "at")).alias("b")).select("word", "b.right", "b.at")


def analyse(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``pages`` (``page_id, source_id, file, page_no, page_text, scanned``, each page once): lines, breaks, corrections.

    ``lines`` is ``page_id, line_no, kind`` with kind furniture, hyphen or misread, without repeats;
    ``breaks`` is ``page_id, line_no, next_page, next_line, left, right, joins``; ``corrections`` is ``word, right``.
    Null and empty texts have no lines; a page without a page number or file has only its own lines to go on.
    """
    pages = pages.select("page_id", "source_id", "file", "page_no", "page_text", "scanned").filter(F.length("page_text") > 0)
    bad = scratch(furniture(pages.filter("scanned")))
    content = scratch(_content(pages.join(bad, "page_id", "left")))
    each = content.select("page_id", "scanned", F.explode("words").alias("l")).select("page_id", "scanned", "l.line_no", F.explode("l.words").alias("word"))
    vocabulary = scratch(each.filter(_is_word("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if(~F.col("scanned")).alias("clean")))
    scanned = content.filter("scanned")
    brk = scanned.select("page_id", "file", "page_no", F.explode("breaks").alias("b")).select("page_id", "file", "page_no", "b.*")
    heads = scanned.filter("head is not null").select("file", (F.col("page_no") - 1).alias("page_no"), F.col("page_id").alias("next_page"), F.col("head.line_no").alias("head_line"), F.col("head.word").alias("head_word"))
    ends = brk.filter("right is null").join(heads.groupBy("file", "page_no").agg(F.min(F.struct("next_page", "head_line", "head_word")).alias("h")).select("file", "page_no", "h.*"), ["file", "page_no"])
    brk = brk.filter("right is not null").select("page_id", "line_no", F.col("page_id").alias("next_page"), "next_line", "left", "right").unionByName(
        ends.select("page_id", "line_no", "next_page", F.col("head_line").alias("next_line"), "left", F.col("head_word").alias("right"))
    )
    brk = scratch(brk.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("compound", F.lower(F.concat("left", F.lit("-"), "right"))))
    forms = brk.select(F.explode(F.array("joined", "compound")).alias("word")).filter(_is_word("word")).distinct()
    # Forms of broken words count with what they have inside lines.
    odd = vocabulary.filter("clean = 0").select("word", "n").unionByName(forms.join(vocabulary, "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n")))
    fixes = scratch(corrections(odd, vocabulary))
    known = forms.join(vocabulary.select("word", "n", "clean"), "word", "left").join(fixes, "word", "left")
    known = known.join(vocabulary.select(F.col("word").alias("right"), F.col("n").alias("right_n")), "right", "left")
    form = lambda p: known.select(
        F.col("word").alias(p), F.coalesce("right_n", "n", F.lit(0)).alias(f"{p}_n"), F.col("right").alias(f"{p}_right"), F.col("at").alias(f"{p}_at")
    )
    brk = brk.join(lookup(form("joined")), "joined", "left").join(lookup(form("compound")), "compound", "left")
    more = F.coalesce("joined_n", F.lit(0)) >= F.coalesce("compound_n", F.lit(0))
    brk = brk.withColumn("joins", _is_word("joined") & ~F.col("right").rlike(r"^\d+$") & more)
    brk = scratch(
        brk.withColumn("fixed", F.when(F.col("joins"), F.col("joined_right")).otherwise(F.col("compound_right")))
        .withColumn("wrong_at", F.when(F.col("joins"), F.col("joined_at")).otherwise(F.col("compound_at")))
        .select("page_id", "line_no", "next_page", "next_line", "left", "right", "joins", "fixed", "wrong_at")
    )
    wrong = brk.filter("wrong_at is not null").select(
        F.when(F.col("wrong_at") < F.length("left"), F.col("page_id")).otherwise(F.col("next_page")).alias("page_id"),
        F.when(F.col("wrong_at") < F.length("left"), F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"),
    )
    # First words of pages that continue no break are words like others.
    taken = brk.filter("next_page != page_id").select(F.col("next_page").alias("page_id"))
    free = scanned.filter("head is not null").select("page_id", F.col("head.line_no").alias("line_no"), F.lower("head.word").alias("word")).join(taken, "page_id", "left_anti")
    read = each.filter("scanned").select("page_id", "line_no", "word").unionByName(free).join(lookup(fixes.select("word")), "word", "left_semi").select("page_id", "line_no")
    lines = (
        bad.select("page_id", F.explode("furniture").alias("line_no")).withColumn("kind", F.lit("furniture"))
        .unionByName(brk.filter("joins").select("page_id", "line_no").withColumn("kind", F.lit("hyphen")))
        .unionByName(read.unionByName(wrong).withColumn("kind", F.lit("misread")))
        .distinct()
    )
    return lines, brk, fixes


def repair(pages: DataFrame) -> DataFrame:
    """``page_id, file, page_no, text, goes_on`` of every scanned page: its paragraphs without furniture, words joined and corrected.

    A word broken at the end of a page is completed there and left out of the next page's start;
    ``goes_on`` says that the last paragraph runs on into the next page. Lines and breaks are those of ``analyse``.
    """
    pages = pages.select("page_id", "source_id", "file", "page_no", "page_text", "scanned")
    lines, brk, fixes = analyse(pages)
    bad = lines.filter("kind = 'furniture'").groupBy("page_id").agg(F.collect_set("line_no").alias("furniture"))
    ends = brk.select("page_id", F.struct("line_no", "left", "right", "joins", "fixed", (F.col("next_page") != F.col("page_id")).alias("leaves")).alias("b")).groupBy("page_id").agg(F.collect_list("b").alias("breaks"))
    taken = brk.filter("next_page != page_id").select(F.col("next_page").alias("page_id"), F.lit(True).alias("carried")).distinct()
    texts = pages.filter("scanned and length(page_text) > 0")
    # Corrections by page: only the words a page has.
    word = texts.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("page_text"), F.lit(r"([\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*)"), F.lit(1)))).alias("word"))
    right = word.join(lookup(fixes.select("word", "right")), "word").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("right"))
    x = texts.join(bad, "page_id", "left").join(ends, "page_id", "left").join(taken, "page_id", "left").join(right, "page_id", "left")

    def case(word: str, form: str) -> str:
        return form.upper() if word.isupper() and len(word) > 1 else form[:1].upper() + form[1:] if word[:1].isupper() else form

    def one(text, out, breaks, carried, right):
        skip, ends, right = set(out or ()), {b["line_no"]: b for b in breaks or ()}, dict(right or ())
        fix = lambda s: _WORD.sub(lambda m: case(m[0], right[m[0].lower()]) if m[0].lower() in right else m[0], s)
        paragraphs, now, rest, drop = [], [], None, bool(carried)
        for k, l in enumerate(text.split("\n"), 1):
            if k in skip:
                continue
            if not l.strip():
                if now and rest is None:
                    paragraphs.append(now)
                    now = []
                continue
            l = l.strip()
            if drop or rest is not None:  # its first word was told with the line before
                m = _WORD.match(l)
                l = (rest or "") + (l[m.end() :] if m else l)
                if rest is not None and now:
                    l = now.pop() + l
                drop, rest = False, None
            b = ends.get(k)
            m = _BREAK.search(l) if b else None
            if b and m:
                whole = b["left"] + ("" if b["joins"] else "-") + b["right"]
                whole = case(whole, b["fixed"]) if b["fixed"] else whole
                l = l[: m.start(1)] + whole
                if not b["leaves"]:
                    rest = ""
            now.append(l)
        if now:
            paragraphs.append(now)
        told = "\n\n".join(fix(" ".join(p)).strip() for p in paragraphs)
        return told, bool(told) and (told[-1] not in ".!?:" or any(b["leaves"] for b in ends.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            made = [one(*r) for r in zip(cols["page_text"], cols["furniture"], cols["breaks"], cols["carried"], cols["right"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.bool_())], ["page_id", "file", "page_no", "text", "goes_on"]
            )

    return x.select("page_id", "file", "page_no", "page_text", "furniture", "breaks", "carried", "right").mapInArrow(run, "page_id bigint, file string, page_no int, text string, goes_on boolean")
