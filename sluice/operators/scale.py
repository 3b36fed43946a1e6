"""Helpers that keep plans safe at scale: keep-first without moving payload, checked broadcasts, durable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that ``lookup`` and ``first_rows`` broadcast (of a few narrow columns each).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where all tasks run on this machine (``local`` masters, as in tests) an unset folder is replaced by one of
    its own; a cluster without the setting is refused, as each machine would write to a disk of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark.sparkContext, "_sluice_dir", None)
        if base is None:
            base = spark.sparkContext._sluice_dir = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def scratch(df: DataFrame) -> DataFrame:
    """Write a DataFrame once as Parquet in the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but stays columnar; the files outlive lost executors and are
    deleted when the driver's JVM ends.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``max_rows`` rows; beyond that as it is, for a shuffled join."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def first_rows(df: DataFrame, key: str, *columns: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each ``key``, for tables in which whole rows are repeated.

    Over files only keys are shuffled: rows beyond the first of a key are found by their place in
    the files and taken out by anti joins with broadcast places. Where there are more than ``most`` of them, files are read in
    groups that have so many (or one file's) each, so that no other column is shuffled at any number. Other
    DataFrames use ``dropDuplicates``. Rows with a null key count as one key.
    """
    wanted = [key, *(c for c in columns if c != key)]
    try:
        if not df.inputFiles():
            raise ValueError("no files")
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
        placed = df.select(key, *place)
        placed.schema  # noqa: B018 - analysis fails here where the source has no row index
    except Exception:
        return df.select(*wanted).dropDuplicates([key])
    first = placed.groupBy(key).agg(F.min(F.struct("_file", "_row")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    first = scratch(first.select(F.col(key).alias("_key"), "_first"))
    if first.isEmpty():
        return df.select(*wanted)
    more = scratch(placed.join(first, placed[key].eqNullSafe(first["_key"])).filter(F.struct("_file", "_row") != F.col("_first")).select("_file", "_row"))
    counts = {r._file: r.n for r in more.groupBy("_file").agg(F.count("*").alias("n")).collect()}  # a row for each file at most
    without = lambda rows, out: rows.select(*wanted, *place).join(F.broadcast(out), ["_file", "_row"], "left_anti").select(*wanted)
    if sum(counts.values()) <= most:
        return without(df, more)
    spark = df.sparkSession
    read = lambda files: spark.read.schema(df.schema).parquet(*files)
    plain = lambda p: re.sub(r"^(\w+):/+", r"\1:/", unquote(p))
    names = {plain(p) for p in counts}
    clean = [f for f in df.inputFiles() if plain(f) not in names]
    parts, now, held = [], [], 0
    for f, n in sorted(counts.items()):
        if now and held + n > most:
            parts.append(now)
            now, held = [], 0
        now, held = [*now, f], held + n
    parts.append(now)
    out = [without(read(files), more.filter(F.col("_file").isin(files))) for files in parts]
    return reduce(DataFrame.unionByName, [*out, *([read(clean).select(*wanted)] if clean else [])])
