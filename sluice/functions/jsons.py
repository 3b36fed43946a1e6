"""JSON strings as native expressions, with key order kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dig(item: str | Column, dotted: str) -> Column:
    """Value at a dotted path as a string; null where it is missing or a step is no object."""
    path = "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in dotted.split("."))
    return F.get_json_object(_c(item), path)


def json_items(payload: str | Column, items_key: str | None = "items") -> Column:
    """The items of a listing as an array of JSON strings, null where there is no such list."""
    body = _c(payload) if items_key is None else dig(payload, items_key)
    return F.transform(F.from_json(body, "array<variant>"), lambda v: F.to_json(v))


def json_kind(payload: str | Column) -> Column:
    """``array``, ``object``, a scalar's kind as named in Python (``str int float bool NoneType``), or null for no JSON."""
    s = F.trim(_c(payload))
    ok = F.try_parse_json(s).isNotNull()
    c = F.substring(s, 1, 1)
    kind = F.when(c == "[", "array").when(c == "{", "object").when(c == '"', "str").when(s.isin("true", "false"), "bool").when(s == "null", "NoneType").when(s.rlike(r"^-?\d+$"), "int").otherwise("float")
    return F.when(ok, kind)


def describe_json(payload: str | Column, keys: int = 12) -> Column:
    """``shape, item_count, item_keys, is_listing``: how a payload lists items.

    An array lists its elements; an object lists the first of its values, in written order, that is an
    array of two or more. Keys are the first item's, sorted, at most ``keys``. No JSON gives null.
    """
    s = F.trim(_c(payload))
    kind = json_kind(s)
    # The object is parsed once, into its entries in written order.
    entries = F.map_entries(F.from_json(F.when(kind == "object", s), "map<string,string>"))
    listed = F.get(F.filter(entries, lambda e: F.coalesce(F.json_array_length(e["value"]), F.lit(0)) >= 2), 0)
    key = listed["key"]
    items = F.when(kind == "array", s).when(key.isNotNull(), listed["value"])
    first = F.get_json_object(items, "$[0]")
    of = F.coalesce(F.json_object_keys(F.when(items.isNotNull(), first).otherwise(F.when(kind == "object", s))), F.array().cast("array<string>"))
    count = F.when(items.isNotNull(), F.json_array_length(items)).otherwise(0)
    shape = F.when(kind == "object", F.when(key.isNotNull(), F.concat(F.lit("object with '"), key, F.lit("' array"))).otherwise("object")).otherwise(kind)
    return F.when(kind.isNotNull(), F.struct(shape.alias("shape"), count.alias("item_count"), F.slice(F.array_sort(of), 1, keys).alias("item_keys"), (count >= 2).alias("is_listing")))


#: Values longer than this stand under their label.
LONG_VALUE = 120


def item_text(fields: list[tuple[str, object]]) -> str:
    """``synthesize`` for values at hand."""
    lines = []
    for label, value in fields:
        v = "" if value is None else str(value).strip()
        lines.append(f"\n{label}:\n{v}" if "\n" in v or len(v) > LONG_VALUE else f"{label}: {v}")
    return "<html><body><pre>" + "\n".join(lines) + "</pre></body></html>"


def synthesize(item: str | Column, fields: list[tuple[str, str]]) -> Column:
    """A text document of an item: ``LABEL: value`` lines, long or broken values under their label, in a ``pre``."""

    def line(label: str, dotted: str) -> Column:
        v = F.regexp_replace(F.coalesce(dig(item, dotted), F.lit("")), r"(?U)^\s+|\s+$", "")
        own = F.concat(F.lit(f"\n{label}:\n"), v)
        return F.when(v.contains("\n") | (F.length(v) > LONG_VALUE), own).otherwise(F.concat(F.lit(f"{label}: "), v))

    return F.concat(F.lit("<html><body><pre>"), F.concat_ws("\n", *(line(*f) for f in fields)), F.lit("</pre></body></html>"))


def strip_fence(answer: str | Column) -> Column:
    """A model's answer without a code fence around it."""
    s = F.trim(_c(answer))
    inner = F.regexp_replace(F.regexp_replace(s, r"(?s)^```[^\n]*\n?", ""), r"(?s)\s*```\s*$", "")
    return F.when(s.startswith("```"), F.trim(inner)).otherwise(s)
