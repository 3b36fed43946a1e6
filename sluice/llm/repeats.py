"""Lines repeated across one site's documents, found through content-defined chunks.

Every page's visible lines are cut by rolling hashes (``chunking.line_chunks``); chunks are counted
by distinct documents within their source, and lines made of nothing but excessively repeated
chunks are candidates, whose own counts then decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.markup import blocks
from sluice.llm.chunking import line_chunks
from sluice.operators.scale import lookup, scratch

_DIGITS = re.compile(r"\d+")
_LETTER = re.compile(r"[^\W\d_]")


def normal_line(line: str) -> str:
    """A line in lower case, each run of digits written as one 0."""
    return _DIGITS.sub("0", line.lower())


def page_lines(pages: DataFrame, source: str, key: str, html: str) -> DataFrame:
    """``source, key, lines`` with, in page order, each line's text, its normal form and its chunks (none for lines of under three letters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.struct([("text", pa.string()), ("line", pa.string()), ("chunks", pa.list_(pa.int64()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [[b.text for b in blocks(h).blocks] for h in part.column(2).to_pylist()]
                normal = [normal_line(t) for ts in texts for t in ts]
                real = [len(_LETTER.findall(n)) >= 3 for n in normal]
                chunks = iter(line_chunks([n for n, r in zip(normal, real) if r]))
                flat = zip(normal, real)
                rows = []
                for ts in texts:
                    rows.append([{"text": t, "line": n, "chunks": next(chunks) if r else []} for t, (n, r) in zip(ts, flat)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.list_(line))], [source, key, "lines"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (source, key)}
    return (
        pages.select(source, key, html)
        .filter(F.col(source).isNotNull() & (F.length(html) > 0))
        .mapInArrow(run, f"`{source}` {kinds[source]}, `{key}` {kinds[key]}, lines array<struct<text:string,line:string,chunks:array<bigint>>>")
    )


def _often(n: str, docs: str, least: int, share: float) -> Column:
    return (F.col(n) >= least) & (F.col(n) >= F.col(docs) * F.lit(share) - 1e-9)


def repeated_lines(lines: DataFrame, source: str, key: str, least: int = 5, share: float = 0.2) -> DataFrame:
    """``source, line, n_docs, source_docs``: lines in at least ``least`` documents and at least ``share`` of the source's.

    ``lines`` comes from ``page_lines`` and is read twice; counts are pre-aggregated before each
    shuffle, keyed by source and chunk or line, so a source of any size spreads over all tasks.
    """
    docs = lookup(lines.groupBy(source).agg(F.count("*").alias("source_docs")))
    chunk = lines.select(source, F.explode(F.array_distinct(F.flatten("lines.chunks"))).alias("chunk"))
    often = chunk.groupBy(source, "chunk").agg(F.count("*").alias("n")).join(docs, source).filter(_often("n", "source_docs", least, share)).select(source, "chunk")
    often = lookup(scratch(often))
    each = lines.select(source, key, F.explode(F.array_distinct(F.expr("transform(filter(lines, l -> size(l.chunks) > 0), l -> struct(l.line, l.chunks))"))).alias("l"))
    # A line whose chunks are all repeated: the inner join keeps repeated chunks only.
    parts = each.select(source, key, "l.line", F.size(F.array_distinct("l.chunks")).alias("size"), F.explode(F.array_distinct("l.chunks")).alias("chunk"))
    whole = parts.join(often, [source, "chunk"]).groupBy(source, key, "line", "size").agg(F.count("*").alias("n")).filter("n = size")
    return (
        whole.groupBy(source, "line").agg(F.count("*").alias("n_docs")).join(docs, source).filter(_often("n_docs", "source_docs", least, share)).select(source, "line", "n_docs", "source_docs")
    )


def without_repeated(lines: DataFrame, repeated: DataFrame, source: str, key: str) -> DataFrame:
    """``source, key, text, n_cut``: each page's lines but the repeated ones of its source, joined by line feeds.

    A source has few repeated lines (at most the mean number of lines of a page over ``share``), so
    they travel as one array for each source and no page is shuffled while there are few sources.
    """
    per = lookup(repeated.groupBy(source).agg(F.collect_set("line").alias("_cut")))
    kept = F.expr("filter(lines, l -> not array_contains(coalesce(_cut, array()), l.line))")
    return lines.join(per, source, "left").select(
        source, key, F.array_join(F.transform(kept, lambda l: l["text"]), "\n").alias("text"), (F.size("lines") - F.size(kept)).alias("n_cut")
    )
