"""Fitting a text into a budget: tails cut, passages kept, head and tail as the last resort."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where minutes stop and standing rules begin (fixed values).
SAFE_TAILS = (
    r"(?i)\bBOARD\s+POLICY\s+MANUAL\b", r"(?i)\bPOLICY\s+MANUAL\b", r"(?i)\bBOARD\s+POLICIES\b", r"(?i)\bSCHOOL\s+BOARD\s+POLICY\s+\d{3,4}\b",
    r"(?im)^\s*POLICY\s+\d{3,4}(?:\.\d+)?\b", r"(?i)\bSTANDARD\s+OPERATING\s+PROCEDURES?\b", r"(?i)\bGLOSSARY\s+OF\s+TERMS?\b", r"(?i)\bADMINISTRATIVE\s+REGULATIONS?\b",
)
#: Where enclosures begin, which may still matter (fixed values).
RISKY_TAILS = (r"(?i)\bAPPENDIX\s+[A-Z]\b", r"(?i)\bEXHIBIT\s+[A-Z]\b", r"(?i)\bATTACHMENT\s+[A-Z0-9]\b")
#: Words of real procurement events (fixed values).
KEEP = (
    r"(?i)\b(?:AUTHORIZE|APPROVE|ADOPT|RATIFY|AWARD|RENEW|EXECUTE)\b(?:[^.\n]{0,80})\b(?:contract|agreement|amendment|purchase\s+order|renewal|RFP|RFQ|grant\s+award|award)\b",
    r"\b(?:Contract|Agreement|Amendment|Renewal|Partnership|MOU)\s+with\s+(?:the\s+)?[A-Z][A-Za-z0-9&.\-]+",
    r"(?i)\bRequest\s+for\s+(?:Proposal|Quotation|Bid|Qualification)s?\b", r"(?i)\b(?:RFP|RFQ|RFB|IFB)[- ]?\d", r"(?i)\bPurchase\s+Order\s+(?:#|No\.?|number)",
    r"\$\s?\d{2,3},\d{3}\b(?!\s*,)", r"\$\s?\d{1,3}(?:,\d{3}){2,}", r"(?i)\bgrant\s+award\b", r"(?i)\bin\s+the\s+amount\s+of\s+\$",
)

META = "text string, original_chars bigint, final_chars bigint, method string, tail_dropped_at bigint, windows_count int, profile string"


@dataclass(frozen=True)
class TruncationProfile:
    """Vocabulary (regular expressions) and sizes. ``safe`` tails are always cut, ``risky`` ones only over budget."""

    name: str = "generic"
    safe: tuple[str, ...] = ()
    risky: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    window: int = 5_000
    tail_from: float = 0.40
    tail_least: int = 5_000
    head_chars: int = 30_000
    tail_chars: int = 10_000
    gap: str = "\n\n\n"

    def sized(self, **sizes) -> TruncationProfile:
        return replace(self, **sizes)


GENERIC = TruncationProfile()
PROCUREMENT = TruncationProfile("procurement", SAFE_TAILS, RISKY_TAILS, KEEP)


def keyword_profile(keep: Iterable[str], tails: Iterable[str] = (), name: str = "keywords", **sizes) -> TruncationProfile:
    """A profile of plain words, matched in any case at word boundaries."""
    whole = lambda ws: tuple(rf"(?i)\b{re.escape(w)}\b" for w in ws)
    return TruncationProfile(name, whole(tails), (), whole(keep)).sized(**sizes)


class Truncator:
    def __init__(self, profile: TruncationProfile, budget: int):
        self.p, self.budget = profile, budget
        self.safe, self.risky, self.keep = ([re.compile(x) for x in ps] for ps in (profile.safe, profile.risky, profile.keep))

    def _tail(self, text: str, patterns: list[re.Pattern]) -> int | None:
        """Earliest marker far enough into the text that saves enough."""
        n = len(text)
        low, high = int(n * self.p.tail_from), n - self.p.tail_least
        starts = [m.start() for p in patterns for m in p.finditer(text) if low <= m.start() <= high]
        return min(starts, default=None)

    def _windows(self, text: str) -> list[str]:
        merged: list[list[int]] = []
        for at in sorted({m.start() for p in self.keep for m in p.finditer(text)}):
            a, b = max(0, at - self.p.window), min(len(text), at + self.p.window)
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [text[a:b] for a, b in merged]

    def run(self, text: str) -> tuple:
        """``META`` of a text. The last step keeps whole head and tail however small the budget is."""
        n, dropped = len(text), None

        def result(out: str, method: str, windows: int | None = None) -> tuple:
            return out, n, len(out), method, dropped, windows, self.p.name

        if (at := self._tail(text, self.safe)) is not None:
            text, dropped = text[:at], at
        if len(text) <= self.budget:
            return result(text, "no_op" if dropped is None else "trimmed_safe_tail")
        if (at := self._tail(text, self.risky)) is not None:
            text, dropped = text[:at], at
            if len(text) <= self.budget:
                return result(text, "trimmed_tail")
        count = None
        if windows := self._windows(text):
            count, text = len(windows), self.p.gap.join(windows)
            if len(text) <= self.budget:
                return result(text, "trimmed_tail+windows", count)
        p = self.p
        room = max(0, self.budget - p.head_chars - p.tail_chars - 2 * len(p.gap))
        end = max(p.head_chars, len(text) - p.tail_chars)
        parts = [text[: p.head_chars], text[p.head_chars : end][:room], text[-p.tail_chars :] if len(text) > p.tail_chars else ""]
        return result(parts[0] + "".join(p.gap + x for x in parts[1:] if x), "head_windows_tail", count)


def truncate(text: str | Column, budget: int, profile: TruncationProfile = PROCUREMENT, only_over: bool = False) -> Column:
    """A struct (``META``) of each text; null for null. ``only_over`` leaves texts within the budget alone, unread."""

    @F.pandas_udf(META)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = Truncator(profile, budget)
        names = [x.split()[0] for x in META.split(", ")]
        for s in batches:
            rows = [(None,) * 7 if x is None else (x, len(x), len(x), "no_op", None, None, profile.name) if only_over and len(x) <= budget else t.run(x) for x in s]
            frame = pd.DataFrame(rows, columns=names)
            for c in ("original_chars", "final_chars", "tail_dropped_at", "windows_count"):
                frame[c] = frame[c].astype("Int64" if c != "windows_count" else "Int32")
            yield frame

    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), run(c))
