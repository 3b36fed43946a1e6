"""One-pass reading of HTML, tolerant of sloppy markup.

``blocks`` cuts a page into the lines a reader would see and keeps, for each,
what later operators need: the text, how much of it is link text, the element
it stands in, which opening ``p`` tag it belongs to and the box around it.
Everything is plain Python over strings and is meant to be called inside Arrow
batches, never row by row from a Python UDF.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

#: Tags that stand inside a line (fixed by the definition of visible text).
INLINE = frozenset("a b i em strong small font span".split())
#: Elements without a closing tag (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head without ending it (fixed by HTML).
HEAD_ONLY = frozenset("head html title meta link base script style noscript template".split())
#: Elements that group blocks into a box of the page.
BOXES = frozenset("div main article section aside nav header footer center body td ul ol form table".split())

# A quoted value may not hold "<": an unclosed quote then costs no more than its own tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript)\b[^<>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^<>\"']*+(?:(?:\"[^\"<]*\"|'[^'<]*')[^<>\"']*+)*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>"
    r"|<[!?][^<>]*>",
    re.I | re.S,
)
#: Tags without attributes as they are mostly written; they need no pattern.
_BARE = {f"<{close}{name}>": (close, name, "") for close in ("", "/") for name in INLINE | VOID | BOXES | set("p li tr th h1 h2 h3 h4 h5 h6 dl dt dd tbody thead title section button label pre".split())}
_BARE_MOST = max(map(len, _BARE))
_P_OPEN = re.compile(r"<p(?=[\s>/])", re.I)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@lru_cache(10_000)
def _class_words(attrs: str) -> str:
    return " ".join(a or b or c for a, b, c in _CLASS.findall(attrs)).lower()


class Block(NamedTuple):
    """A line of a page. ``box`` numbers the innermost box, ``path`` holds its boxes from the outside."""

    text: str
    link_chars: int
    tag: str
    p_no: int
    box: int


class Page(NamedTuple):
    blocks: list[Block]
    #: Per box: number of the box around it, tag, class and id words in lower case.
    boxes: list[tuple[int, str, str]]
    n_p: int


def blocks(html: str) -> Page:
    """The visible lines of a page in order.

    Head, script, style, noscript and comments are left out, entities decoded, white space
    collapsed. A text of no tags is a page of one line; an empty text has no lines.
    """
    out: list[Block] = []
    boxes: list[tuple[int, str, str]] = [(-1, "", "")]
    stack: list[tuple[str, int]] = []
    buf: list[str] = []
    link: list[str] = []
    pos = n_p = p_no = 0
    box, tag, in_head, in_a = 0, "", False, False

    def flush() -> None:
        text = "".join(buf)
        if "&" in text:
            text = unescape(text)
        text = " ".join(text.split())
        if text:
            # Link text is mostly all there is.
            n = 0 if not link else len(text) if len(link) == len(buf) else len(" ".join(unescape("".join(link)).split()))
            out.append(Block(text, n if n < len(text) else len(text), tag, p_no, box))
        buf.clear()
        link.clear()

    find, match, bare, start = html.find, _TOKEN.match, _BARE.get, html.find("<")
    while start >= 0:
        end = find(">", start, start + _BARE_MOST) + 1
        m, known = None, bare(html[start:end])
        if not known:
            m = match(html, start)
            if not m:
                start = find("<", start + 1)
                continue
            end = m.end()
        # Blanks before a line are no part of it.
        if start > pos and not in_head and (not (s := html[pos:start]).isspace() or buf):
            buf.append(s)
            if in_a:
                link.append(s)
        pos, start = end, find("<", end)
        if known:
            close, name, attrs = known
        else:
            raw, close, name, attrs, close2, name2 = m.groups()
            if not name:
                if not name2:
                    if raw and buf:
                        flush()
                    if "<p" in (whole := m[0]) or "<P" in whole:
                        n_p += len(_P_OPEN.findall(whole))
                    continue
                name, close = name2, close2
            name = name.lower()
        if name in INLINE:
            if name == "a":
                in_a = not close
            continue
        if buf:
            flush()
        if name == "head":
            in_head = not close
            continue
        if in_head and name not in HEAD_ONLY:
            in_head = False
        if name == "p":
            if close:
                p_no, tag = 0, ""
            else:
                n_p += 1
                p_no, tag = n_p, "p"
            in_a = False
        elif name in BOXES:
            p_no, tag, in_a = 0, "" if close else name, False
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                box = stack[-1][1] if stack else 0
            else:
                boxes.append((box, name, _class_words(attrs) if attrs else ""))
                box = len(boxes) - 1
                stack.append((name, box))
        elif name not in VOID:
            p_no, tag, in_a = 0, "" if close else name, False
    if not in_head:
        buf.append(html[pos:])
        if in_a:
            link.append(html[pos:])
    if buf:
        flush()
    return Page(out, boxes, n_p)


def visible_text(html: str | None) -> str:
    """The visible lines joined by line feeds; an empty text for null."""
    return "\n".join(b.text for b in blocks(html).blocks) if html else ""
