"""Local files and recipe books as DataFrames, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.html import html_text
from sluice.functions.urls import sanitize_filename
from sluice.operators.runs import sparse

RECIPES = (
    "version int, sources array<struct<id:string,source_type:string,config:string,enabled:boolean,notes:string,"
    "memory:struct<success_count:int,failure_count:int,consecutive_failures:int,last_status:string,last_ok_at:string,last_run_at:string,last_error:string,doc_url_pattern:string,quarantined:boolean,quarantine_reason:string>>>"
)


#: What a recipe remembers of its runs.
MEMORY = ["success_count", "failure_count", "consecutive_failures", "last_status", "last_ok_at", "last_run_at", "last_error", "doc_url_pattern", "quarantined", "quarantine_reason"]


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, kind, text, method, error`` of files: pages and plain texts are read here, PDF files by ``operators.analysis.read_pdfs``."""
    f = spark.read.format("binaryFile").load(list(paths))
    p = F.lower("path")
    kind = F.when(p.rlike(r"\.html?$"), "html").when(p.rlike(r"\.(txt|md)$") | ~F.element_at(F.split("path", "/"), -1).contains("."), "text").otherwise("pdf")
    f = f.select("path", kind.alias("kind"), "content")
    body = F.decode("content", "UTF-8")
    pages = f.filter("kind = 'html'").select("path", "kind", html_text(body).alias("text"), F.lit("html").alias("method"), F.lit(None).cast("string").alias("error"))
    texts = f.filter("kind = 'text'").select("path", "kind", body.alias("text"), F.lit("text").alias("method"), F.lit(None).cast("string").alias("error"))
    from sluice.operators.analysis import read_pdfs

    pdfs = read_pdfs(f.filter("kind = 'pdf'")).select("path", F.lit("pdf").alias("kind"), "text", "method", "error")
    return pages.unionByName(texts).unionByName(pdfs)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes of a JSON book in their order; a missing file is an empty book. A file without ``sources``, or a recipe without id or type, is an error."""
    try:
        raw = spark.read.json(path, schema=RECIPES, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], RECIPES)
    sound = F.when(F.col("sources").isNull(), F.raise_error(F.lit("not a recipe file: expected 'sources'"))).otherwise(F.col("sources"))
    x = raw.select(F.posexplode(sound).alias("pos", "r")).select("pos", "r.*")
    need = F.when(F.col("id").isNull() | F.col("source_type").isNull(), F.raise_error(F.lit("a recipe needs id and source_type"))).otherwise(F.col("id"))
    return x.withColumn("id", need).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def recipe_json(recipes: DataFrame) -> DataFrame:
    """One row ``json``: the book of recipes in their order, without nulls; memory is sparse, and left out where a source has none. A book is as long as it has sources."""
    memory = [sparse(f"memory.{c}") for c in MEMORY]
    kept = F.greatest(*(m.isNotNull() for m in memory))
    memory_column = [F.when(kept, F.struct(*memory)).alias("memory")] if "memory" in recipes.columns else []
    row = F.to_json(F.struct("id", "source_type", F.try_parse_json("config").alias("config"), "enabled", "notes", *memory_column), {"ignoreNullFields": "true"})
    return recipes.agg(F.concat(F.lit('{"version":1,"sources":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("j")))), lambda x: x["j"]), ","), F.lit("]}")).alias("json"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Downloaded files as Parquet by source; the key is the address, so equal file names do not meet."""
    documents.withColumn("file_name", sanitize_filename("file_name", fallback="document.pdf")).withColumn("file_key", F.sha2("source_url", 256)).write.mode("append").partitionBy("source_id").parquet(folder)
