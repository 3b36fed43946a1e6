"""Harvests of many sources in one job: documents, the journal of their runs, and what the book remembers of them."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import dates, html, truncate
from sluice.operators import runs
from sluice.sources.adapters import open_source
from sluice.sources.files import MEMORY

RUNS = "source_id string, source_type string, started_at timestamp, config_error string"
#: What a run that brought nothing or failed most likely means.
DIAGNOSES = {
    "empty": "The adapter ran and found nothing to fetch: the site may have changed, or the options do not fit it.",
    "partial": "Some documents gave no usable text: they may be scans, stubs or error pages.",
    "error": "The source could not be read at all.",
}


def harvest(spark: SparkSession, recipes: list[dict], profile: dates.DateProfile, limit: int = 3, replay: str | None = None, max_chars: int = 0, extract: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(runs, documents)`` of recipes (``id, source_type, config``), all sources read by one job.

    A recipe with a wrong configuration is a run with ``config_error``; an address that fails is a document row of
    ``content_type`` error with the reason in ``error``. Without ``extract`` texts are neither read nor dated.
    """
    now, told, parts = datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None), [], []
    for r in recipes:
        try:
            parts.append(open_source(spark, r["source_type"], **r["config"], source_id=r["id"], limit=limit, replay=replay, on_error="row", year=profile.as_of_year))
            told.append((r["id"], r["source_type"], now, None))
        except (ValueError, KeyError) as e:
            told.append((r["id"], r["source_type"], now, f"{type(e).__name__}: {e}"))
    journal = spark.createDataFrame(told, RUNS)
    columns = "source_id string, source_url string, title string, content_type string, file_name string, doc_date date, date_source string, text_chars bigint, text string, truncation string, extract_method string, error string"
    if not parts:
        return journal, spark.createDataFrame([], columns)
    d = reduce(DataFrame.unionByName, parts)
    failed = F.col("content_type") == "error"
    d = d.withColumn("error", F.when(failed, F.col("title"))).withColumn("title", F.when(~failed, F.col("title")))
    if not extract:
        none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
        return journal, d.select("source_id", "source_url", "title", "content_type", "file_name", "doc_date", F.when(F.col("doc_date").isNotNull(), "adapter").alias("date_source"), none("text_chars", "bigint"), none("text"), none("truncation"), none("extract_method"), "error")
    d = d.withColumn("text", html.html_text("raw_html"))
    day, where = dates.date_with_source(F.col("doc_date"), F.col("title"), F.col("source_url"), F.col("text"), profile)
    cut = truncate.truncate("text", max_chars or 10**12, only_over=True)
    d = d.select("source_id", "source_url", "title", "content_type", "file_name", day.alias("doc_date"), where.alias("date_source"), cut.alias("t"), F.when(F.col("text").isNotNull(), "html").otherwise("none").alias("extract_method"), "error")
    return journal, d.select(
        "source_id", "source_url", "title", "content_type", "file_name", "doc_date", "date_source", F.length("t.text").cast("bigint").alias("text_chars"), "t.text", F.col("t.method").alias("truncation"), "extract_method", "error"
    )


def statuses(journal: DataFrame, documents: DataFrame, extract: bool = True) -> DataFrame:
    """``source_id, source_type, started_at, status, error, diagnosis, n_documents, n_usable``: a row for each run.

    A run without documents is an error if an address failed, else empty. Without ``extract`` every document counts as usable.
    """
    real = F.col("error").isNull()
    usable = F.coalesce(F.col("text_chars"), F.lit(0)) >= runs.USEFUL_CHARS if extract else F.lit(True)
    by = documents.groupBy("source_id").agg(F.count_if(real).alias("n"), F.count_if(real & usable).alias("u"), F.min("error").alias("why"))
    x = journal.join(by, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("u", F.coalesce("u", F.lit(0)))
    error = F.coalesce("config_error", F.when(F.col("n") == 0, F.col("why")))
    status = F.when(error.isNotNull(), "error").when(F.col("n") == 0, "empty").when(F.col("n") == F.col("u"), "ok").otherwise("partial")
    known = F.create_map(*(F.lit(v) for kv in DIAGNOSES.items() for v in kv))
    return x.select("source_id", "source_type", "started_at", status.alias("status"), error.alias("error"), F.try_element_at(known, status).alias("diagnosis"), F.col("n").alias("n_documents"), F.col("u").alias("n_usable"))


def remember(book: DataFrame, ran: DataFrame, documents: DataFrame) -> DataFrame:
    """``source_id, MEMORY..., shape_changed`` of the sources that ran: the book's memory (``id, memory``) with these runs folded in.

    ``shape_changed`` says that a run was ok though an address does not match the pattern known before it.
    """
    good = documents.filter("error is null")
    learned = runs.learned_pattern(good, "source_id", "source_url")
    before = book.filter("memory is not null").select(F.col("id").alias("source_id"), *(F.col(f"memory.{c}").alias(c) for c in MEMORY))
    before = before.withColumns({c: F.to_timestamp(c) for c in ("last_ok_at", "last_run_at")})
    known = before.filter("doc_url_pattern is not null").select("source_id", F.col("doc_url_pattern").alias("pattern"))
    keeps = runs.keeps_shape(good, known, "source_id", "source_url")
    told = ran.join(learned, "source_id", "left").withColumn("run_id", F.lit(0)).withColumn("error", F.coalesce("error", "diagnosis"))
    folded = runs.fold_memory(told, pattern="pattern", before=before.join(ran.select("source_id"), "source_id", "left_semi"))
    changed = ran.filter("status = 'ok'").join(keeps.filter("not keeps"), "source_id").select("source_id", F.lit(True).alias("shape_changed"))
    return folded.join(changed, "source_id", "left").withColumn("shape_changed", F.coalesce("shape_changed", F.lit(False)))
