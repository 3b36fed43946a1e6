"""The harvest tables as the operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.scale import first_rows, lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetched(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rows of ``fetched``, repeated rows once."""
    return first_rows(table(spark, sf_dir, "fetched"), "fetch_id", *columns)


def sources_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, source_id``: stray blanks and capitals removed, spelt as in ``recipes`` where it is there."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))
    runs = table(spark, sf_dir, "run_journal").filter(F.col("source_id").isNotNull()).groupBy("run_id").agg(F.min(clean("source_id")).alias("_source"))
    known = table(spark, sf_dir, "recipes").groupBy(clean("source_id").alias("_source")).agg(F.min("source_id").alias("_spelt"))
    return runs.join(lookup(known), "_source", "left").select("run_id", F.coalesce("_spelt", "_source").alias("source_id"))


def pages_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id, fetch_id, raw_html`` of pages with a non-empty ``raw_html``."""
    pages = fetched(spark, sf_dir, "run_id", "raw_html").filter(F.length("raw_html") > 0)
    return pages.join(lookup(sources_of_runs(spark, sf_dir)), "run_id").select("source_id", "fetch_id", "raw_html")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, source_id, file, page_no, page_text, scanned``: repeated rows once, scanned if the file was read by ocr."""
    file = lambda c: F.regexp_replace(c, r"^(\./)+", "")
    records = table(spark, sf_dir, "doc_records").filter("local_path is not null and extract_method is not null")
    files = records.groupBy(file("local_path").alias("file")).agg(F.bool_or(F.lower(F.trim("extract_method")) == "ocr").alias("scanned"))
    pages = first_rows(table(spark, sf_dir, "page_texts"), "page_id", "source_id", "local_path", "page_no", "page_text")
    pages = pages.select("page_id", "source_id", file("local_path").alias("file"), "page_no", "page_text")
    return pages.join(lookup(files), "file", "left").select("page_id", "source_id", "file", "page_no", "page_text", F.coalesce("scanned", F.lit(False)).alias("scanned"))
