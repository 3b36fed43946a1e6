"""Canonical spelling of web addresses, as one native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that do not change where an address leads: campaign, referrer and session marks (fixed values).
TRACKING = r"utm_\w+|gclid|fbclid|msclkid|dclid|yclid|mc_cid|mc_eid|igshid|ref|referrer|sid|session|sessionid|session_id|phpsessid|jsessionid|aspsessionid\w*"


def canonical_url(url: str | Column) -> Column:
    """A key equal for addresses that lead to the same place though spelt otherwise.

    Scheme, ``www.``, default ports, user info, fragments, case of the host, needless percent
    escapes, empty and dot segments, closing slashes, index pages, session marks, tracking
    parameters and the order of parameters are levelled. Null and blank addresses give null.
    """
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    u = F.regexp_replace(u, r"(?s)#.*$", "")
    u = F.regexp_replace(u, r"(?i)^[a-z][a-z0-9+.-]*:", "")
    u = F.regexp_replace(u, r"^//", "")
    host = F.regexp_extract(u, r"^([^/?]*)", 1)
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    host = F.regexp_replace(F.lower(host), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"\.$", ""), r"^www\d?\.", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), r"\+", "%20")
    # A stray % must not fail the decoder.
    decode = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")), c)
    path = decode(F.regexp_replace(path, r"(?i);(jsessionid|phpsessid|sid)=[^/]*", ""))
    path = F.regexp_replace(path, r"/{2,}", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"(/\.)+(?=/|$)", ""), r"/(?!\.\./)[^/]+/\.\.(?=/|$)", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)/(index|default)\.(html?|php|aspx?|jsp)$", "/"), r"/+$", "")
    parts = F.filter(F.split(query, "[&;]"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)"))
    query = F.array_join(F.array_sort(F.array_distinct(F.transform(parts, decode))), "&")
    return F.when(u != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
