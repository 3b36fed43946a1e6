"""Queries over the whole tables, one family for each problem, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import chunking, history, inputs, mixture, repeats, residue, scans, subjects, tokens
from sluice.operators.scale import scratch


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold residue, filler, an error message or a script notice in place of a document."""
    return residue.residue(inputs.fetched(spark, d, "raw_html")).filter("is_residue").select("fetch_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated in at least 5 and a fifth of the pages of their source."""
    lines = scratch(repeats.page_lines(inputs.pages_of_sources(spark, d), "source_id", "fetch_id", "raw_html"))
    return repeats.repeated_lines(lines, "source_id", "fetch_id").select("source_id", "line")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each page's text without the repeated lines of its source."""
    lines = scratch(repeats.page_lines(inputs.pages_of_sources(spark, d), "source_id", "fetch_id", "raw_html"))
    return repeats.without_repeated(lines, repeats.repeated_lines(lines, "source_id", "fetch_id"), "source_id", "fetch_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The ``p`` elements of each page's own document."""
    pages = residue.residue(inputs.fetched(spark, d, "raw_html"))
    return pages.filter("not is_residue").select("fetch_id", F.explode("own_p").alias("p_no"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be cut: their second piece is there. Markup only shortens, so shorter pages need no parse."""
    pages = inputs.fetched(spark, d, "raw_html").filter(F.length("raw_html") > 12_000)
    return chunking.split(pages, "fetch_id", "raw_html", html=True).filter("piece_no = 2").select("fetch_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every page's visible text."""
    pages = inputs.fetched(spark, d, "raw_html").filter(F.length("raw_html") > 0)
    return chunking.split(pages, "fetch_id", "raw_html", html=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned pages that are furniture, end in a broken word or hold a misread one."""
    return scans.analyse(inputs.page_texts(spark, d))[0].select("page_id", "line_no", "kind")


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """Repaired text of every scanned page."""
    return scans.repair(inputs.page_texts(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of later batches whose document an earlier batch had already brought."""
    return history.repeated_documents(inputs.fetched(spark, d, "batch_no", "source_url", "raw_html"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(inputs.table(spark, d, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = inputs.table(spark, d, "documents").withColumn("text_hash", F.xxhash64("text"))
    sized = tokens.encode(documents, "doc_id", "text", extra=("source", "text_hash"), count_only=True)
    return mixture.mixture(scratch(sized), inputs.table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares the sources reach in the mixture."""
    return _mixture(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Subject areas of every document."""
    t = lambda n: inputs.table(spark, d, n)
    return subjects.subjects_of(t("documents"), t("subject_labels"), t("subjects")).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and characters each source has of each subject."""
    found = p9_found(spark, d).join(inputs.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return found.groupBy("source", "subject").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
