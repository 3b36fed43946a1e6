"""Template residue and error-page text: positive-unlabelled naive Bayes fitted by expectation-maximization.

Passages are the blocks of a page; those of its own part (``content``) count as its text, the rest only as evidence of residue. Passages with unfilled placeholders or
with one of the trusted phrases make a record *trusted* when they are most of its text; from the
trusted records the model spreads to passages that share their wording. A record is residue if
residue passages are all of its document but for a rest of ``max_real`` of the words (half, as on pages almost empty the tree takes single teasers for text).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.markup import Page, blocks
from sluice.llm import content, phrases
from sluice.llm.sums import tree_sum
from sluice.operators.scale import scratch

#: Width of the hashed vocabulary: the model is two arrays of this length at any size of corpus.
BUCKETS = 1 << 16
TRUSTED, HEADING, OWN, TITLE = 1, 2, 4, 8
_PRIME = 40_503

_FILLER = frozenset(phrases.RESIDUE[0].split())
#: What fingers type for filler: runs of four letters or more along the rows of a keyboard, either way.
_RUNS = frozenset(r[::way][i:j] for r in ("qwertyuiop", "asdfghjkl", "zxcvbnm") for way in (1, -1) for i in range(len(r)) for j in range(i + 4, len(r) + 1))
#: Trusted phrases by their longest word, with its place in the phrase.
_KEYED: dict[str, list[tuple[int, list[str]]]] = {}
for _p in map(content.tokens, phrases.RESIDUE):
    _k = max(_p, key=len)
    _KEYED.setdefault(_k, []).append((_p.index(_k), _p))
#: Longer passages are not trusted for a phrase.
_MOST = max(6, *(3 * len(p) for ps in _KEYED.values() for _, p in ps))
#: Without any of these words, or in short passages those of phrases, none is trusted.
_TELLING = frozenset(("\x00",)) | _FILLER | _RUNS


def is_trusted(words: list[str]) -> bool:
    """A passage that is certainly residue: a tenth of its words are unfilled fields or several filler words, a quarter are runs of the keyboard, or a trusted phrase is a good part of it."""
    n = len(words)
    marks = words.count("\x00")
    if marks and 10 * marks >= n:
        return True
    if n > 2 and not _FILLER.isdisjoint(words) and 10 * sum(map(_FILLER.__contains__, words)) >= n and len(_FILLER.intersection(words)) > 1:
        return True
    if n > 2 and not _RUNS.isdisjoint(words) and 4 * sum(map(_RUNS.__contains__, words)) >= n:
        return True
    if n <= _MOST and not _KEYED.keys().isdisjoint(words):
        for k, w in enumerate(words):
            for j, p in _KEYED.get(w, ()):
                if k >= j and words[k - j : k - j + len(p)] == p and (n <= 6 or 3 * len(p) >= n):
                    return True
    return False


class Words(dict):
    """Numbers of words as they stand between blanks, in lower case: each is looked into once. Holds for each the buckets of its tokens and whether one of them may make a passage trusted (1) or stands in a trusted phrase (2)."""

    def __init__(self) -> None:
        self.count, self.buckets, self.telling = array("i"), array("i"), array("b")
        self.trusted: dict[str, bool] = {}

    def __missing__(self, word: str) -> int:
        words = content.word_tokens(word)
        self.count.append(len(words))
        self.buckets.extend(zlib.crc32(w.encode()) % BUCKETS for w in words)
        self.telling.append((not _TELLING.isdisjoint(words)) | 2 * (not _KEYED.keys().isdisjoint(words)))
        n = self[word] = len(self)
        return n

    def fit(self) -> None:
        """Forget all when it has grown too large; numbers given before are void."""
        if len(self) > 1_000_000:
            self.clear()
            self.__init__()

    def is_trusted(self, text: str) -> bool:
        """``is_trusted`` of a passage; texts of a line or so are remembered, as sites repeat them."""
        if len(text) >= 120:
            return is_trusted(content.tokens(text))
        got = self.trusted.get(text)
        if got is None:
            if len(self.trusted) > 200_000:
                self.trusted.clear()
            got = self.trusted[text] = is_trusted(content.tokens(text))
        return got


def _lists(n: np.ndarray, values: np.ndarray) -> pa.Array:
    """Rows of ``n`` values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, pa.int32()))


def passages_of(pages: list[Page], words: Words) -> tuple[list[pa.Array], np.ndarray, list[tuple[int, int, int]]]:
    """Of each page lengths, flags and hashed words of its passages (but for link lists), and its own ``p`` elements.

    Further numbers of words, and of each paragraph of own text (headings and links left out) its page and from where to where its words stand among them.
    """
    words.fit()
    of, numbers, ends, texts, page_of, kinds, own_p = words.__getitem__, [], [0], [], [], [], []
    paragraphs, unmarked = [], []
    for k, page in enumerate(pages):
        own_p.append(ps := [])
        for b, mine in zip(page.blocks, content.own_blocks(page)):
            text, tag = b.text, b.tag
            if mine and b.p_no and (not ps or ps[-1] != b.p_no):
                ps.append(b.p_no)
            if (plain := 2 * b.link_chars < len(text)) or mine:
                numbers.extend(map(of, (line := content.marked(text)).lower().split()))
                heading = tag in content.HEADINGS
                if mine and plain and not heading:
                    if line is not text and line != text:
                        unmarked.append((len(paragraphs), text))
                    paragraphs.append((k, ends[-1], len(numbers)))
                ends.append(len(numbers))
                texts.append(text)
                page_of.append(k)
                kinds.append(OWN * mine | HEADING * heading | TITLE * (tag == "h1"))
    n_read = len(numbers)
    for at, text in unmarked:
        start = len(numbers)
        numbers.extend(map(of, text.lower().split()))
        paragraphs[at] = (paragraphs[at][0], start, len(numbers))
    number, end, page, kind = (np.array(x, np.int64) for x in (numbers, ends, page_of, kinds))
    read, count = number[:n_read], np.array(words.count, np.int64)
    total = np.concatenate([[0], np.cumsum(count[read])])
    n = np.diff(total[end])
    telling = np.array(words.telling)[read]
    told, phrase = (np.diff(np.concatenate([[0], np.cumsum((telling & bit) > 0)])[end]) for bit in (1, 2))
    flags = np.where((kind & TITLE == 0) & (n >= 10), kind & ~HEADING, kind)
    for i in np.flatnonzero((told > 0) | ((phrase > 0) & (n <= _MOST))):
        flags[i] |= TRUSTED * words.is_trusted(texts[i])
    place = np.arange(total[-1]) + np.repeat((np.cumsum(count) - count)[read] - total[:-1], count[read])
    some = n > 0
    per_page = np.bincount(page[some], minlength=len(pages))
    cols = [
        _lists(per_page, n[some]), _lists(per_page, flags[some]),
        _lists(np.bincount(page, n, len(pages)).astype(np.int64), np.array(words.buckets)[place]), pa.array(own_p, pa.list_(pa.int32())),
    ]
    return cols, number, paragraphs


PASSAGES = "{key} {kind}, n_words array<int>, flags array<int>, toks array<int>, own_p array<int>"


def passages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each page with the hashed passages of its own part; ``pages`` has unique keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols, _, _ = passages_of(list(map(blocks, part.column(1).to_pylist())), words)
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, "n_words", "flags", "toks", "own_p"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(key, html).filter(F.length(html) > 0)
    return rows.mapInArrow(run, PASSAGES.format(key=f"`{key}`", kind=kind))


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column."""
    col = batch.column(batch.schema.get_field_index(name))
    off = col.offsets.to_numpy()
    return col.values.to_numpy()[off[0] : off[-1]], off - off[0]


def _grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of a batch, and the number of the passage of each."""
    toks, _ = _flat(batch, "toks")
    n, _ = _flat(batch, "n_words")
    at = np.repeat(np.arange(len(n)), n)
    same = at[1:] == at[:-1]
    pairs = (toks[:-1].astype(np.int64) * _PRIME + toks[1:]) % BUCKETS
    return np.concatenate([toks, pairs[same]]), np.concatenate([at, at[1:][same]])


def _sum_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of runs given by offsets, empty runs included."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def _scores(grams: np.ndarray, at: np.ndarray, n: int, weight: np.ndarray, bias: float) -> np.ndarray:
    """Posterior of each of ``n`` passages."""
    z = np.bincount(at, weight[grams], n) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _trusted(batch: pa.RecordBatch, least: float) -> np.ndarray:
    """For each passage whether it is an own or trusted one of a trusted record."""
    words, off = _flat(batch, "n_words")
    flags, _ = _flat(batch, "flags")
    body = words * ((flags & (HEADING | OWN)) == OWN)
    good = _sum_by(words * ((flags & TRUSTED) > 0), off)
    record = (good > 0) & (good >= least * np.maximum(_sum_by(body, off), 1))
    return np.repeat(record, np.diff(off)) & ((flags & (OWN | TRUSTED)) > 0)


def fit(table: DataFrame, rounds: int = 4, trusted_share: float = 0.5, smooth: float = 0.05) -> tuple[np.ndarray, float]:
    """Token weights (log odds) and bias. Each round is one pass over all passages; only sums of ``BUCKETS`` numbers come to the driver."""
    weight, bias, model = None, 0.0, None
    spark = table.sparkSession
    for _ in range(rounds):
        model = None if weight is None else spark.sparkContext.broadcast(weight)

        def run(batches: Iterator[pa.RecordBatch], model=model, bias=bias) -> list[np.ndarray]:
            pos, rest, n = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(2)
            for batch in batches:
                if not batch.num_rows:
                    continue
                sure = _trusted(batch, trusted_share).astype(float)
                grams, at = _grams(batch)
                r = sure if model is None else np.maximum(sure, _scores(grams, at, len(sure), model.value, bias))
                pos += np.bincount(grams, r[at], BUCKETS)
                rest += np.bincount(grams, 1 - r[at], BUCKETS)
                n += r.sum(), (1 - r).sum()
            return [pos, rest, n]

        got = tree_sum(table.select("n_words", "flags", "toks"), run)
        pos, rest, (n_pos, n_rest) = got or (np.zeros(BUCKETS), np.zeros(BUCKETS), (0.0, 0.0))
        if n_pos < 1:
            return np.zeros(BUCKETS), -40.0
        used = np.count_nonzero(pos + rest)
        weight = np.log((pos + smooth) / (pos.sum() + smooth * used)) - np.log((rest + smooth) / (rest.sum() + smooth * used))
        weight[(pos + rest) == 0] = 0.0
        bias = float(np.log(n_pos) - np.log(max(n_rest, 1.0)))
    return weight, bias


def decide(table: DataFrame, key: str, weight: np.ndarray, bias: float, max_real: float = 0.5) -> DataFrame:
    """``key, residue_words, real_words, n_passages, is_residue, own_p`` for each record."""
    model = table.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, off = _flat(batch, "n_words")
            flags, _ = _flat(batch, "flags")
            bad = (_scores(*_grams(batch), len(words), model.value, bias) > 0.5) | ((flags & TRUSTED) > 0)
            residue = _sum_by(words * bad, off)
            real = _sum_by(words * ~bad * ((flags & (HEADING | OWN)) == OWN), off)
            # A title scored like those of residue pages says nothing alone.
            told = _sum_by(words * bad * ((flags & (TITLE | TRUSTED)) != TITLE), off)
            verdict = (told > 0) & (real <= max_real * (residue + real))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(residue.astype("int64")), pa.array(real.astype("int64")), pa.array(np.diff(off).astype("int64")), pa.array(verdict), batch.column(batch.schema.get_field_index("own_p"))],
                [key, "residue_words", "real_words", "n_passages", "is_residue", "own_p"],
            )

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, "n_words", "flags", "toks", "own_p").mapInArrow(
        run, f"`{key}` {kind}, residue_words bigint, real_words bigint, n_passages bigint, is_residue boolean, own_p array<int>"
    )


def residue(pages: DataFrame, key: str = "fetch_id", html: str = "raw_html", rounds: int = 4, max_real: float = 0.5) -> DataFrame:
    """Judge every page with a non-empty ``html``.

    ``pages`` has one row for each ``key``. Null and empty pages give no row; a page without a
    document part is no residue; further columns are ignored; an empty table gives no rows.
    Result: ``key, residue_words, real_words, n_passages, is_residue, own_p`` where ``own_p`` are
    the numbers of the ``p`` elements that belong to the page's own document.
    """
    return judge(scratch(passages(pages, key, html)), key, rounds, max_real)


def judge(table: DataFrame, key: str, rounds: int = 4, max_real: float = 0.5) -> DataFrame:
    """``residue`` of pages already cut into passages, in a table that can be read again and again."""
    weight, bias = fit(table, rounds)
    return decide(table, key, weight, bias, max_real)
