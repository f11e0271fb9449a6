"""Tables kept between runs: catalogs, answers by key, vectors, and pools of a tournament."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.items import first_by, upsert
from ..streaming.session import numbered

CACHE_HOURS, FRESH_DAYS, KEPT = 24, 7, 5  # fixed values


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the whole versions of a table, rising."""
    return numbered(spark, f"{folder}/versions", "version")


def save(df: DataFrame, folder: str, keep: int = KEPT) -> int:
    """Writes a new version of a table beside the others, one number higher, so that readers see a whole version or the one
    before; the last `keep` versions stay for readers that began with them."""
    spark = df.sparkSession
    before = versions(spark, folder)
    number = before[-1] + 1 if before else 0
    df.write.mode("overwrite").parquet(f"{folder}/versions/version={number}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [*before, number][:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/version={old}"), True)
    return number


def load(spark: SparkSession, folder: str, fill: dict[str, Column] | None = None) -> DataFrame | None:
    """The latest version of a table, or None if there is none; `fill` gives what older versions lack or left null."""
    there = versions(spark, folder)
    if not there:
        return None
    table = spark.read.parquet(f"{folder}/versions/version={there[-1]}")
    return table.withColumns({k: F.coalesce(F.col(k), c) if k in table.columns else c for k, c in (fill or {}).items()})


def newest(files: DataFrame, keep: int = KEPT) -> DataFrame:
    """The files (path, modified) last written; of equal times, the first by path."""
    return files.orderBy(F.desc("modified"), "path").limit(keep)


def is_fresh(modified: Column, now: Column, days: int = FRESH_DAYS) -> Column:
    return F.coalesce(modified > now - F.make_dt_interval(F.lit(days)), F.lit(False))


def answer_key(query: Column, domains: Column, megapixels: Column, version: int = 1) -> Column:
    """The key under which a stage's answer is kept: the same for any case of the query and any order of domains."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), F.lower(F.trim(query)).alias("query"), F.array_sort(domains).alias("domains"), megapixels.alias("megapixels"))), 256)


def answers(cache: DataFrame, keys: DataFrame, now: Column, hours: int = CACHE_HOURS) -> DataFrame:
    """`keys` (key) with the last answer (answer) of each that isn't too old, else null."""
    young = cache.where(F.col("at") > now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    last = first_by(young, ["key"], [-F.col("at").cast("double")])
    return keys.join(last.select("key", "answer"), "key", "left")


def found_id(given: Column, url: Column) -> Column:
    """A found image's id: 20 hex digits of the id it came with, else of its address without scheme, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), "^https?://", ""), r"[?#].*$|/+$", "")
    return F.substring(F.sha1(F.coalesce(F.nullif(F.trim(given), F.lit("")), bare)), 1, 20)


def fold_stages(stages: list[Callable[[], DataFrame]], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """Stages in order, each merged into what the ones before gave. The first stage's error is raised, later ones are told."""
    out, errors = stages[0](), []
    for stage in stages[1:]:
        try:
            out = merge(out, stage())
        except Exception as e:  # a later stage only adds
            errors.append(str(e))
    return out, errors


def vectors_of(store: DataFrame, items: DataFrame, model: str) -> DataFrame:
    """`items` (url) with the stored vector of each by this model, else null."""
    own = store.where(F.col("model") == model).select("url", "vector")
    return items.join(own, "url", "left")


def store_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors (url, model, vector) replace those of the same address and model; of several new ones the first by value."""
    key = ["url", "model"]
    one = first_by(new, key, [F.col("vector")])
    return upsert(store.withColumn("__k", F.struct(*key)), one.withColumn("__k", F.struct(*key)), "__k").select(*store.columns)


def csv_pool(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """A pool (sample, title, source, local_image) from a CSV file, of rows whose image is among `files` (path), by number."""
    rows = spark.read.option("header", True).csv(path).withColumn("sample", F.col("sample").try_cast("int"))
    have = rows.where("sample is not null").join(files.select(F.col("path").alias("local_image")).distinct(), "local_image", "left_semi")
    return have.select("sample", "title", "source", "local_image").orderBy("sample")


def first_annotations(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One annotation a key: the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
