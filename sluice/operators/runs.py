"""Runs of sources: status of a run from its documents, summaries of many, and what is remembered of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.urls import url_skeleton
from sluice.operators.scale import lookup

#: A text of so many characters is usable; after so many failures in a row a source rests.
USEFUL_CHARS, QUARANTINE_AFTER = 500, 3


def run_status(documents: DataFrame, run: str = "run_id", chars: str = "text_chars") -> DataFrame:
    """``run, n_documents, n_usable, status`` from the documents of each run: ok if all are usable, else partial."""
    n, usable = F.count("*"), F.count_if(F.coalesce(F.col(chars), F.lit(0)) >= USEFUL_CHARS)
    return documents.groupBy(run).agg(n.alias("n_documents"), usable.alias("n_usable"), F.when(usable == n, "ok").otherwise("partial").alias("status"))


def statuses(runs: DataFrame, documents: DataFrame, run: str = "run_id", error: str = "error", chars: str = "text_chars") -> DataFrame:
    """The status of every run: error if it failed, empty without documents, else by them."""
    by = run_status(documents, run, chars).withColumnRenamed("status", "_status")
    failed = F.col(error).isNotNull()
    return runs.select(run, error).join(by, run, "left").select(
        run, F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_usable", F.lit(0)).alias("n_usable"),
        F.when(failed, "error").when(F.col("_status").isNull(), "empty").otherwise(F.col("_status")).alias("status"),
    )


def summary(runs: DataFrame, by: str = "status") -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("n_runs"))


def all_clean(runs: DataFrame) -> DataFrame:
    """One row: runs, clean runs, whether all were, and the exit code (2 needs attention)."""
    ok = F.count_if(F.col("status") == "ok")
    return runs.agg(F.count("*").alias("n_runs"), ok.alias("n_ok"), (ok == F.count("*")).alias("all_clean"), F.when(ok == F.count("*"), 0).otherwise(2).alias("exit_code"))


def learned_pattern(urls: DataFrame, group: str, url: str) -> DataFrame:
    """``group, pattern``: the pattern all addresses of a group agree on; none for under two addresses or no agreement."""
    s = urls.filter(F.col(url).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(url_skeleton(url)).alias("lo"), F.max(url_skeleton(url)).alias("hi"))
    return s.filter("n >= 2 and lo = hi").select(group, F.col("lo").alias("pattern"))


def keeps_shape(urls: DataFrame, patterns: DataFrame, group: str, url: str) -> DataFrame:
    """``group, keeps``: whether all addresses of a group match its learned pattern; true where either is missing."""
    joined = urls.join(lookup(patterns.select(group, "pattern")), group, "left")
    return joined.groupBy(group).agg(F.coalesce(F.bool_and(F.coalesce(F.regexp_like(url, F.col("pattern")), F.lit(True))), F.lit(True)).alias("keeps"))


def _reason(failures: Column, successes: Column, last_ok: Column) -> Column:
    return F.when(successes == 0, F.concat(failures.cast("string"), F.lit(" runs, never succeeded"))).otherwise(
        F.concat(failures.cast("string"), F.lit(" consecutive failures since "), F.date_format(last_ok, "yyyy-MM-dd'T'HH:mm:ss"))
    )


def fold_memory(runs: DataFrame, source: str = "source_id", at: str = "started_at", tie: str = "run_id", pattern: str | None = None, before: DataFrame | None = None) -> DataFrame:
    """Memory of each source after its runs (``source, at, tie, status, error``), in order of time and then ``tie``.

    A run that is ok clears failures and quarantine; every other is a failure. Runs without a time
    come first. ``pattern`` names a column with the pattern a run's addresses agree on. ``before`` is the
    memory earlier runs left (columns as in the result), which the runs continue. Closed form over
    conditional aggregates: a source's runs are never gathered, only their last ok and what follows it.
    """
    key = F.struct(F.col(at), F.col(tie))
    ok = F.col("status") == "ok"
    last_ok = runs.filter(ok).groupBy(source).agg(F.max(key).alias("_ok"), *([F.max_by(pattern, F.when(F.col(pattern).isNotNull(), key)).alias("_pattern")] if pattern else [F.lit(None).cast("string").alias("_pattern")]))
    after = F.col("_ok").isNull() | (key > F.col("_ok"))
    # Nulls sort first in structs as in the order of runs. There is a row for each source, far fewer than runs.
    got = runs.join(lookup(last_ok), source, "left").groupBy(source).agg(
        F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"), F.count_if(~ok & after).alias("consecutive_failures"),
        F.max_by("status", key).alias("last_status"), F.max(F.when(F.col("_ok").isNotNull(), F.col("_ok")[at])).alias("last_ok_at"), F.max_by(F.col(at), key).alias("last_run_at"),
        F.max_by(F.when(~ok, F.col("error")), key).alias("last_error"), F.first("_pattern").alias("doc_url_pattern"),
    )
    if before is not None:
        old = before.select(F.col(source), *(F.col(c).alias(f"_{c}") for c in ("success_count", "failure_count", "consecutive_failures", "last_status", "last_ok_at", "last_run_at", "last_error", "doc_url_pattern")))
        x = got.join(old, source, "full")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        ran = F.col("last_status").isNotNull()
        got = x.select(
            source, (zero("success_count") + zero("_success_count")).alias("success_count"), (zero("failure_count") + zero("_failure_count")).alias("failure_count"),
            (zero("consecutive_failures") + F.when(zero("success_count") == 0, zero("_consecutive_failures")).otherwise(0)).alias("consecutive_failures"),
            F.coalesce("last_status", "_last_status").alias("last_status"), F.coalesce("last_ok_at", "_last_ok_at").alias("last_ok_at"), F.coalesce("last_run_at", "_last_run_at").alias("last_run_at"),
            F.when(ran, F.col("last_error")).otherwise(F.col("_last_error")).alias("last_error"), F.coalesce("doc_url_pattern", "_doc_url_pattern").alias("doc_url_pattern"),
        )
    rests = F.col("consecutive_failures") >= QUARANTINE_AFTER
    return got.withColumn("quarantined", rests).withColumn("quarantine_reason", F.when(rests, _reason(F.col("consecutive_failures"), F.col("success_count"), F.col("last_ok_at"))))


def streaks(runs: DataFrame, source: str = "source_id", at: str = "started_at", tie: str = "run_id", per: str = "day") -> DataFrame:
    """Every run with the failures in a row up to it and the status of the run before.

    Two levels keep a source of any number of runs out of one task: runs are ordered within each stretch of time (``per``) only, and what
    a stretch takes over from those before comes from one row for each stretch. Runs without a time are a stretch of their own, the first.
    """
    x = runs.withColumn("_part", F.date_trunc(per, at))
    key, ok = F.struct(F.col(at), F.col(tie)), F.col("status") == "ok"
    by = [F.col(source).eqNullSafe(F.col("_s")), F.col("_part").eqNullSafe(F.col("_p"))]
    named = lambda df: df.withColumnRenamed(source, "_s").withColumnRenamed("_part", "_p")
    ends = x.groupBy(source, "_part").agg(F.max(F.when(ok, key)).alias("_ok"), F.max_by("status", key).alias("_last"))
    # Failures of a stretch behind its last ok (all where it has none).
    tail = x.join(named(ends.select(source, "_part", "_ok")), by).groupBy(source, "_part").agg(F.count_if(~ok & (F.col("_ok").isNull() | (key > F.col("_ok")))).alias("_tail"))
    w = Window.partitionBy(source).orderBy(F.col("_part").asc_nulls_first())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = ends.join(named(tail), by).select(source, "_part", "_last", "_tail", F.col("_ok").isNotNull().cast("int").alias("_some"))
    parts = parts.withColumn("_run", F.sum("_some").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.coalesce(F.sum("_tail").over(before), F.lit(0)))
    # What lies before the last stretch with an ok no longer counts.
    parts = parts.withColumn("_gone", F.max(F.when(F.col("_some") == 1, F.col("_total"))).over(before))
    parts = parts.select(source, "_part", (F.col("_total") - F.coalesce("_gone", F.lit(0))).alias("_carry"), F.lag("_last").over(w).alias("_before"))
    inner = Window.partitionBy(source, "_part").orderBy(F.col(at).asc_nulls_first(), tie)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    y = x.withColumn("_island", F.sum(ok.cast("int")).over(upto)).withColumn("_prev", F.lag("status").over(inner)).withColumn("_n", F.row_number().over(inner))
    y = y.withColumn("_fails", F.sum((~ok).cast("int")).over(Window.partitionBy(source, "_part", "_island").orderBy(F.col(at).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0)))
    y = y.join(named(parts), by)
    return y.select(
        *runs.columns, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_prev")).alias("previous_status"),
        (F.col("_fails") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)).alias("failures_in_a_row"),
    )


def select_recipes(recipes: DataFrame, memory: DataFrame, only: list[str] | None = None, include_quarantined: bool = False, key: str = "source_id") -> DataFrame:
    """Every recipe with whether it runs, and why not: ``key, runs, skipped_because``."""
    x = recipes.select(key, "enabled").join(memory.select(key, "quarantined", "quarantine_reason"), key, "left")
    rests = F.coalesce("quarantined", F.lit(False)) & F.lit(not include_quarantined)
    because = F.when(~F.coalesce("enabled", F.lit(False)), "disabled")
    if only is not None:
        because = because.when(~F.col(key).isin(only), "not selected")
    because = because.when(rests, F.concat(F.lit("quarantined: "), F.col("quarantine_reason")))
    return x.select(key, because.isNull().alias("runs"), because.alias("skipped_because"))


def upsert_recipes(book: DataFrame, changes: DataFrame, key: str = "source_id", memory: str | None = None) -> DataFrame:
    """The book after adding or replacing recipes by id, with what happened to each (kept, updated, added).

    A replaced recipe keeps its old ``memory`` (a column) where the new one is null or ``{}``, and its place (``pos``, if
    there is such a column); added ones come after all others in the order of their own ``pos``. Of changes of one
    id the last given counts only if they are unique: callers make them so.
    """
    rest = [c for c in book.columns if c not in (key, "pos")]
    place = "pos" in book.columns
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in [*rest, *(["pos"] if place else [])]), F.lit(True).alias("_new"))
    x = book.withColumn("_old", F.lit(True)).join(new, key, "full")
    kept = lambda c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "{}", F.col(f"_{c}")), c)
    pick = lambda c: F.when(F.col("_new"), kept(c) if c == memory else F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    at = [F.coalesce(F.col("pos").cast("bigint"), F.lit(1 << 40) + F.col("_pos")).alias("pos")] if place else []
    return x.select(key, *at, *map(pick, rest), F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "added").otherwise("updated").alias("change"))


def sparse_json(columns: list[Column | str]) -> Column:
    """JSON of a struct without nulls, zeros, falses and empty texts, as recipe files keep memory; null where nothing is left."""
    return F.nullif(F.to_json(F.struct(*map(sparse, columns)), {"ignoreNullFields": "true"}), F.lit("{}"))


def sparse(column: Column | str) -> Column:
    """A column under its own name, null where it is zero, false or empty."""
    name = column if isinstance(column, str) else column._jc.toString()
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~c.cast("string").isin("0", "0.0", "false", ""), c).alias(name.rsplit(".", 1)[-1])
