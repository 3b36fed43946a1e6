"""Main content of web pages: flat text blocks judged by a decision tree.

A page is a flat run of blocks (``sluice.functions.markup``). Each block is described by its word
count and link density, those of its neighbours, and the run, group and box it stands in; no
feature reads its wording. A decision tree, trained on the small labelled table in
``labelled``, decides whether the block belongs to the page's own document.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from sluice.functions.markup import Page

_WORD = re.compile(r"[^\W\d_]+|0|©|\x00")
_DIGITS = re.compile(r"\d+")
#: Unfilled fields of common template languages.
PLACEHOLDER = re.compile(
    r"\{\{[^{}]*\}\}|\{%[^{}]*%\}|\$\{[^{}]*\}|\{[A-Za-z_][\w .-]*\}|<%[^<>]*%>|\[\[[^\[\]]*\]\]|__[A-Z][A-Z_]+__|«[^«»]{1,40}»"
    r"|#[A-Z][A-Z_]+#|%[A-Z][A-Z_]+%|@@\w+@@|\bX{4,}\b|\((?:insert|enter|add) [a-z ]+\)|\[(?:insert|your|enter|name|date|title)[^\[\]]*\]"
)
_MAYBE = re.compile(r"[{<\[_«#%@(]|XXXX")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Cells and list items are no titles of a group, however short.
_NO_TITLE = frozenset(("li", "td"))
_STOPS = frozenset(".!?:;。…")
#: ``run`` is the unbroken run, in one box, of blocks without links that end like sentences; ``group`` is what follows a heading or title
#: within one box; ``since`` counts from the first h1 of the page, ``since_loose`` the blocks from there that are neither links nor headings nor end like sentences.
FEATURES = "words link prev_words prev_link next_words next_link run_words group_link group_at box_words box_link box_h1 since since_loose to_end prev_heading next_heading cell".split()


def marked(line: str) -> str:
    """The line with a mark in place of every unfilled field."""
    return PLACEHOLDER.sub(" \x00 ", line) if _MAYBE.search(line) else line


def tokens(line: str) -> list[str]:
    """Words in lower case, every number as ``0``, every unfilled field as one mark. No word runs over a blank."""
    return word_tokens(marked(line).lower())


def word_tokens(text: str) -> list[str]:
    """``tokens`` of text in lower case whose unfilled fields are marks already."""
    return _WORD.findall(_DIGITS.sub("0", text))


def features(page: Page) -> list[tuple[float, ...]]:
    """A row of ``FEATURES`` for each block of a page."""
    bl, boxes = page.blocks, page.boxes
    n = len(bl)
    if not n:
        return []
    words = [b.text.count(" ") + 1 for b in bl]
    link = [b.link_chars / len(b.text) if b.link_chars else 0.0 for b in bl]
    end = [b.text[-1] in _STOPS for b in bl]
    head = [float(b.tag in HEADINGS or (w <= 6 and x < 0.5 and not b.p_no and b.tag not in _NO_TITLE and not e)) for b, w, x, e in zip(bl, words, link, end)]
    run, run_words, group, size, linked, group_at = [], [], [], [0], [0], []
    box_words, box_linked, box_h1 = [0] * len(boxes), [0.0] * len(boxes), [0.0] * len(boxes)
    since, since_loose = [], []
    before, after_head, open_run, s, loose = bl[0].box, True, None, 0, 0
    for b, w, x, h, e in zip(bl, words, link, head, end):
        box = b.box
        if e and x < 0.5 and not h:
            if open_run != box:
                run_words.append(0)
                open_run = box
            run_words[-1] += w
            run.append(len(run_words) - 1)
        else:
            open_run = None
            run.append(-1)
        if h:
            size.append(0)
            linked.append(0)
        else:
            if box != before and not (after_head and boxes[before][0] == box):
                size.append(0)
                linked.append(0)
            size[-1] += 1
            linked[-1] += x > 0.5
        group.append(len(size) - 1)
        group_at.append(size[-1])
        box_words[box] += w
        box_linked[box] += w * x
        before, after_head = box, h
        if b.tag == "h1":
            box_h1[box] = 1.0
            if not s:
                s, loose = 1, 0
        since.append(s)
        since_loose.append(loose)
        if s:
            s += 1
            loose += not e and not h and x <= 0.5
    run_words.append(0)
    share = [k / m if m else 0.0 for k, m in zip(linked, size)]
    box_share = [k / m if m else 0.0 for k, m in zip(box_linked, box_words)]
    at = [b.box for b in bl]
    return list(zip(
        words, link, [0, *words[:-1]], [0.0, *link[:-1]], [*words[1:], 0], [*link[1:], 0.0], [run_words[k] for k in run], [share[g] for g in group], group_at,
        [box_words[k] for k in at], [box_share[k] for k in at], [box_h1[k] for k in at], since, since_loose, range(n - 1, -1, -1),
        [0.0, *head[:-1]], [*head[1:], 0.0], [float(b.tag in _NO_TITLE) for b in bl],
    ))


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 1):
    """A CART tree by Gini impurity: nested ``(feature, threshold, below, above)``, leaves are shares of positives."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.arange(1, len(v))
        pos = np.cumsum(t)[:-1]
        right, rpos = len(v) - left, t.sum() - pos
        cost = 2 * pos * (1 - pos / left) + 2 * rpos * (1 - rpos / right)
        ok = (v[1:] > v[:-1]) & (left >= least) & (right >= least)
        if ok.any():
            k = int(np.argmin(np.where(ok, cost, np.inf)))
            if cost[k] < best[0]:
                best = (cost[k], f, float((v[k] + v[k + 1]) / 2))
    _, f, at = best
    if f is None:
        return share
    low = x[:, f] <= at
    return (f, at, fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least))


def judge(tree, row) -> float:
    while type(tree) is tuple:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(1)
def tree():
    """The tree, trained once per process on the labelled table."""
    from sluice.llm.labelled import ROWS

    rows = np.array([[float(v) for v in r.split()] for r in ROWS.strip().splitlines()])
    return fit_tree(rows[:, :-1], rows[:, -1])


def own_blocks(page: Page) -> list[bool]:
    """Which blocks belong to the page's own document."""
    t = tree()
    return [judge(t, row) > 0.5 for row in features(page)]
