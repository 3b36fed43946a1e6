"""Addresses and file names as native column expressions."""

from __future__ import annotations

from urllib.parse import urljoin as _urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Hosts of known publishing platforms, first match wins (fixed values).
KNOWN_HOSTS = [
    ("boarddocs.com", "boarddocs"), ("diligent.com", "boarddocs"), ("granicus.com", "granicus"), ("legistar.com", "legistar"), ("civicclerk.com", "civicclerk"),
    ("civicplus.com", "civicplus"), ("swagit.com", "swagit"), ("boardbook.org", "boardbook"), ("novusagenda.com", "novusagenda"), ("iqm2.com", "iqm2"),
]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url: str | Column) -> Column:
    """Host in lower case without user info and port; empty where there is none, null for null."""
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: str | Column) -> Column:
    """Path of an address, without query and fragment."""
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def platform_of(url: str | Column) -> Column:
    """Name of the publishing platform the host belongs to, else ``unknown``."""
    h, out = host(url), F.lit("unknown")
    for needle, name in reversed(KNOWN_HOSTS):
        out = F.when(h.contains(needle), F.lit(name)).otherwise(out)
    return out


def segments(p: str | Column) -> Column:
    return F.filter(F.split(_c(p), "/"), lambda s: s != "")


def slug_shape(p: str | Column) -> Column:
    """A path with numbers as ``<n>`` and hyphenated words as ``<slug>``; other segments stay."""
    kind = lambda s: F.when(s.rlike(r"^\d+$"), F.lit("<n>")).when(s.rlike(r"(?i)^[a-z0-9]+(-[a-z0-9]+)+$"), F.lit("<slug>")).otherwise(s)
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(p), kind), "/"))


def escape_regex(s: str | Column) -> Column:
    """A literal as a regular expression, with the usual set of special characters escaped."""
    return F.regexp_replace(_c(s), r"([\\.^$*+?{}\[\]|()\-#&~\s])", r"\\$1")


def shape_pattern(shape: str | Column) -> Column:
    """Regular expression of a shape; only the last placeholder captures."""
    parts = segments(shape)
    is_ph = lambda s: s.isin("<n>", "<slug>")
    at = F.size(parts) - F.coalesce(F.array_position(F.reverse(F.transform(parts, is_ph)), True), F.lit(0))
    body = lambda s: F.when(s == "<n>", F.lit(r"\d+")).otherwise(F.lit("[a-zA-Z0-9-]+"))
    one = lambda s, i: F.when(~is_ph(s), escape_regex(s)).otherwise(F.concat(F.when(i == at, F.lit("(")).otherwise(F.lit("(?:")), body(s), F.lit(")")))
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, one), "/"))


def url_skeleton(url: str | Column) -> Column:
    """Anchored pattern of an address: long hexadecimal runs and numbers or dates become classes."""
    s = F.regexp_replace(_c(url), r"(?i)[0-9a-f]{8,}", "\u0001")
    s = F.regexp_replace(s, r"\d{4}-\d{2}-\d{2}|\d{8}|\d+", "\u0002")
    s = F.replace(F.replace(escape_regex(s), F.lit("\u0001"), F.lit("[0-9a-fA-F]+")), F.lit("\u0002"), F.lit("[0-9-]+"))
    return F.concat(F.lit("^"), s, F.lit("$"))


def sanitize_filename(name: str | Column, longest: int = 200, fallback: str = "document") -> Column:
    """A safe file name: query and fragment cut, other characters than letters, digits and ``._-`` replaced."""
    s = F.regexp_replace(_c(name), r"(?s)[?#].*$", "")
    s = F.substring(F.regexp_replace(s, r"[^a-zA-Z0-9._-]", "_"), 1, longest)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(fallback)).otherwise(s)


def is_pdf(url: str | Column, strip_query: bool = False) -> Column:
    """Whether an address ends in ``.pdf``; the probe looks past the query, the adapters do not."""
    u = F.lower(_c(url))
    return F.endswith(F.split_part(u, F.lit("?"), F.lit(1)) if strip_query else u, F.lit(".pdf"))


def common_path_prefix(paths: str | Column) -> Column:
    """Longest shared run of leading segments of an array of paths, as ``/a/b/``; empty where none is shared."""
    all_ = F.transform(_c(paths), segments)
    shortest = F.coalesce(F.array_min(F.transform(all_, F.size)), F.lit(0))
    first = F.try_element_at(all_, F.lit(1))
    agree = lambda i: F.forall(all_, lambda s: F.get(s, i) == F.get(first, i))
    upto = F.when(shortest > 0, F.transform(F.sequence(F.lit(0), F.greatest(shortest, F.lit(1)) - 1), agree)).otherwise(F.array().cast("array<boolean>"))
    n = F.aggregate(upto, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a.n + F.when(a.on & x, 1).otherwise(0)).alias("n"), (a.on & x).alias("on")), lambda a: a.n)
    return F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice(first, F.lit(1), n), "/"), F.lit("/"))).otherwise("")


@F.pandas_udf(StringType())
def url_join(base: pd.Series, ref: pd.Series) -> pd.Series:
    """Absolute address of a reference (RFC 3986), for the cases native expressions cannot express."""

    def one(b: str | None, r: str | None) -> str | None:
        try:
            return None if r is None else _urljoin(b or "", r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)
