"""HTML in Arrow batches: main text, links and page statistics in one pass over a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.functions.markup import _TOKEN, VOID

#: Elements, and parts of class names, that are no main text (fixed values).
UNWANTED_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript")
UNWANTED_CLASSES = ("nav", "navigation", "footer", "header", "sidebar", "menu", "advertisement", "ads")
#: Elements that close an open one of their kind.
_SELF_CLOSING = frozenset("p li td th tr option dd dt".split())
_HREF = re.compile(r"(?:^|[\s\"'/;])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLASS_ONLY = re.compile(r"(?:^|[\s\"'])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_REL_API = re.compile(r"<link\b(?=[^>]*\brel\s*=\s*[\"']?[^\"'>]*api\.w\.org)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)
_RAW_PARTS = re.compile(r"(?is)^<(script|style|noscript)\b[^<>]*>(.*?)(?:</\1\s*>)?$")


def main_text(html: str | None, unwanted_tags=UNWANTED_TAGS, unwanted_classes=UNWANTED_CLASSES) -> str | None:
    """Text of the first ``main``, else ``article``, else ``body``, else the whole page, a line for each text node.

    Elements of unwanted tags, or whose class contains an unwanted word, are left out with all in them.
    """
    if html is None:
        return None
    tags, needles = frozenset(t.lower() for t in unwanted_tags), [c.lower() for c in unwanted_classes]
    stack: list[tuple[str, bool]] = []
    hidden = 0
    roots = {"main": None, "article": None, "body": None}  # depth of the first of each while open
    found: dict[str, list[str]] = {"": []}

    def text(s: str) -> None:
        if hidden:
            return
        for line in (unescape(s) if "&" in s else s).split("\n"):
            if line := line.strip():
                found[""].append(line)
                for r, depth in roots.items():
                    if depth is not None and depth >= 0:
                        found[r].append(line)

    def pop_to(name: str) -> None:
        nonlocal hidden
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                for _ in range(len(stack) - k):
                    _, hides = stack.pop()
                    hidden -= hides
                for r, depth in roots.items():
                    if depth is not None and depth >= k:
                        roots[r] = -1  # closed for good
                return

    pos = 0
    for m in _TOKEN.finditer(html):
        if m.start() > pos:
            text(html[pos : m.start()])
        pos = m.end()
        if m["raw"]:
            name = m["raw"].lower()
            if name not in tags and (p := _RAW_PARTS.match(m[0])):
                text(p[2])
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            pop_to(name)
            continue
        if name in _SELF_CLOSING and stack and stack[-1][0] == name:
            pop_to(name)
        if name in VOID:
            continue
        attrs = m["attrs"] or ""
        classes = " ".join(a or b or c for a, b, c in _CLASS_ONLY.findall(attrs)).lower() if needles and "class" in attrs.lower() else ""
        hides = name in tags or any(n in classes for n in needles if classes)
        if name in roots and roots[name] is None and not hides and not hidden:
            roots[name] = len(stack)
            found[name] = []
        stack.append((name, hides))
        hidden += hides
    text(html[pos:])
    for r in ("main", "article", "body", ""):
        if r in found:
            return "\n".join(found[r])
    return ""


def page_links(html: str | None, base: str | None = None) -> list[tuple[int, str, str, str]]:
    """``(pos, raw href, absolute href, label)`` of each anchor, the first of each absolute address."""
    if not html:
        return []
    out, seen, open_link, label = [], set(), None, []
    pos = 0

    def close() -> None:
        nonlocal open_link
        if open_link is not None:
            raw = open_link
            try:
                full = urljoin(base or "", raw)
            except ValueError:
                full = raw
            if full not in seen:
                seen.add(full)
                out.append((len(out), raw, full, " ".join(x for x in (" ".join(unescape(t).split()) for t in label) if x)))
            open_link = None
        label.clear()

    for m in _TOKEN.finditer(html):
        if open_link is not None and m.start() > pos:
            label.append(html[pos : m.start()])
        pos = m.end()
        name = m["name"] or m["name2"]
        if name and name.lower() == "a":
            close()
            if not (m["close"] or m["close2"]) and (h := _HREF.search(m["attrs"] or "")):
                open_link = unescape((h[1] or h[2] or h[3] or "").strip())
    close()
    return out


LINKS = "array<struct<pos:int,raw:string,href:string,label:string>>"
PAGE = f"text string, text_chars bigint, html_chars bigint, script_tags int, links {LINKS}, wp_api string"
_SCRIPT = re.compile(r"<script\b", re.I)


def read_page(html: str | Column, base: str | Column | None = None) -> Column:
    """Struct of a page: main text, statistics, links and an advertised REST root; one hop to Python for all of them. Null for null."""

    @F.pandas_udf(PAGE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, b in batches:
            rows = []
            for html_, base_ in zip(h, b):
                if html_ is None:
                    rows.append((None, None, None, None, None, None))
                    continue
                t = main_text(html_)
                api = _REL_API.search(html_)
                root = api[1] if api else (urljoin(base_ or "", "/wp-json/") if "/wp-content/" in html_ and len(html_) < 2_000_000 else None)
                links = [dict(zip(("pos", "raw", "href", "label"), x)) for x in page_links(html_, base_)]
                rows.append((t, len(t), len(html_), len(_SCRIPT.findall(html_)), links, root))
            yield pd.DataFrame(rows, columns=["text", "text_chars", "html_chars", "script_tags", "links", "wp_api"]).astype({"text_chars": "Int64", "html_chars": "Int64", "script_tags": "Int32"})

    c = F.col(html) if isinstance(html, str) else html
    b = F.lit(None).cast("string") if base is None else F.col(base) if isinstance(base, str) else base
    return F.when(c.isNotNull(), run(c, b))


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Main text of a page; null for null."""
    return pd.Series([main_text(h) for h in html], dtype=object)
