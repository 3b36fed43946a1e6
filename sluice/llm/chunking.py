"""Content-defined chunking: rolling hashes over code points and cuts at their landmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.functions.markup import visible_text

_BREAK = 10
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(c: np.ndarray, window: int, reset: bool = False) -> np.ndarray:
    """Hash of the last ``window`` code points at each place; with ``reset`` a line break empties the window and hashes to 0."""
    x = (c.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    if reset:
        at = np.arange(len(c))
        broken = c == _BREAK
        x[broken] = 0
        since = at - np.maximum.accumulate(np.where(broken, at, -1))
    h = x.copy()
    factor = 1
    for j in range(1, min(window, len(c))):
        factor = factor * 0x100000001B3 % (1 << 64)
        part = x[:-j] * np.uint64(factor)
        if reset:
            part[since[j:] <= j] = 0
        h[j:] += part
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    if reset:
        h[broken] = 0
    return h


def line_chunks(lines: list[str], window: int = 8, bits: int = 6) -> list[list[int]]:
    """Chunk hashes of each of many lines, chunks of about ``2**bits`` code points.

    All lines are hashed as one stream. A chunk ends where the rolling hash has ``bits`` zero bits;
    a line break resets the hash to zero and so is a landmark like any other.
    """
    if not lines:
        return []
    c = codes("\n".join(lines) + "\n")
    h = rolling(c, window, reset=True)
    ends = np.flatnonzero((h & np.uint64((1 << bits) - 1)) == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    # Hash of a chunk: its mixed code points weighted by their place in it.
    at = np.arange(len(c)) - np.repeat(starts, ends - starts + 1)
    x = (c.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(31)
    place = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    place ^= place >> np.uint64(27)
    x = x * (place | np.uint64(1))
    x ^= x >> np.uint64(30)
    x[c == _BREAK] = 0
    total = np.add.reduceat(x, starts)
    empty = (ends == starts) & (c[ends] == _BREAK)
    line_of = np.cumsum(c == _BREAK)[starts] - (c[starts] == _BREAK)
    keep = ~empty
    out: list[list[int]] = [[] for _ in lines]
    for k, v in zip(line_of[keep].tolist(), total[keep].view(np.int64).tolist()):
        out[k].append(v)
    return out


def cut_points(text: str, limit: int, overlap: int, least: int | None = None, window: int = 32) -> list[int]:
    """Ends of the new text of each piece; the last is the length of the text.

    Landmarks are places whose rolling hash has enough zero bits to come about four times between
    the smallest and the largest size. The first landmark in that range is snapped to the nearest
    end of a line, else of a sentence, else of a word in the range; where there is no landmark, the
    last natural boundary before the limit is taken, else the limit itself.
    """
    if limit <= overlap or overlap < 0:
        raise ValueError("limit must be larger than overlap, and overlap not negative")
    n = len(text)
    if n <= limit:
        return [n]
    room = limit - overlap
    least = max(1, room // 3 if least is None else min(least, room))
    bits = max(1, int(np.log2(max(2, (room - least) / 4))))
    c = codes(text)
    marks = np.flatnonzero((rolling(c, window) & np.uint64((1 << bits) - 1)) == 0) + 1
    blank = (c == 32) | (c == 9) | (c == _BREAK)
    stop = np.isin(c, [ord(x) for x in ".!?。！？"])
    after = np.arange(1, n + 1)
    natural = [after[c == _BREAK], after[1:][stop[:-1] & blank[1:]], after[blank]]
    cuts, start = [], 0
    while n - start > (limit if not cuts else room):
        # The first piece repeats nothing and still keeps to the same range, so that cuts depend on content alone.
        low, high = start + least, start + room
        k = np.searchsorted(marks, low)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= high else None
        cut = mark if mark is not None else high
        for ends in natural:
            a, b = np.searchsorted(ends, low), np.searchsorted(ends, high, "right")
            if a == b:
                continue
            if mark is None:
                cut = int(ends[b - 1])
            else:
                near = ends[a:b]
                j = np.searchsorted(near, mark)
                options = near[max(0, j - 1) : j + 1]
                cut = int(options[np.argmin(np.abs(options - mark))])
            break
        cuts.append(cut)
        start = cut
    return [*cuts, n]


def split_text(text: str, limit: int = 12_000, overlap: int = 200, least: int | None = None) -> list[tuple[int, int, int]]:
    """``(start, new_from, end)`` of each piece: ``text[start:end]``, of which ``text[start:new_from]`` repeats the piece before."""
    before, out = 0, []
    for end in cut_points(text, limit, overlap, least):
        out.append((max(0, before - overlap), before, end))
        before = end
    return out


def split(df: DataFrame, key: str, text: str, limit: int = 12_000, overlap: int = 200, html: bool = False, least: int | None = None) -> DataFrame:
    """Pieces of each text of at most ``limit`` code points.

    Result: ``key, piece_no, n_pieces, total_chars, start, new_from, end, piece`` (offsets from 0).
    With ``html`` the visible text of the page is split. Texts within the limit are one piece, an
    empty text is one empty piece, a null text gives no row; repeated rows give repeated pieces;
    further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: list[tuple] = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t = visible_text(t) if html else t
                    pieces = split_text(t, limit, overlap, least)
                    rows += [(k, i, len(pieces), len(t), s, f, e, t[s:e]) for i, (s, f, e) in enumerate(pieces, 1)]
                cols = list(zip(*rows)) or [()] * 8
                types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    names = [key, "piece_no", "n_pieces", "total_chars", "start", "new_from", "end", "piece"]
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).filter(df[text].isNotNull()).mapInArrow(
        run, f"`{key}` {kind}, piece_no int, n_pieces int, total_chars bigint, start bigint, new_from bigint, end bigint, piece string"
    )
